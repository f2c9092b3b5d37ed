"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
a conjunction of alternatives of strings that any match must contain. Per batch
of texts, postings (trigram -> texts) are built for the trigrams that the rules
ask for, the query intersects and unites them, and only candidates are verified
with the regular expression. A rule without mandatory trigrams scans all texts.

Defined results: null text counts as empty and has no span. Texts of any length
are scanned whole. Offsets count code points, end exclusive. Repeated rows are
scanned each on their own; extra columns are kept, and results go to one column,
``secrets``, with as many ``_`` behind as make its name free. Spans that start
together come in the order of the rules. No rows give no rows.
A private key goes from its BEGIN to its END line, or to where its base64 lines end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from re import _constants as sre  # the parsed form of a pattern
from re import _parser as sre_parse

from paperloom.llm.common import free_name, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    base: bool = False
    #: Group and least length of it (or of the whole match, group 0); shorter matches are dropped.
    group: int = 0
    least: int = 1

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base rules, in the order in which ties are listed, then those that the method adds.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, True, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, True, 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----(?:BEGIN|END) )[\x00-\x7f])*-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\\[nr]|[\s\x22'+,>])*(?:(?:Proc-Type|DEK-Info):[^\r\n]*|[A-Za-z0-9+/=]{16,}))*(?:(?:\\[nr]|\s)+[A-Za-z0-9+/]*={1,2})?)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", True),
]
KINDS = [r.kind for r in RULES]

#: Strings that a sub-pattern can match, at most so many; else it is taken as any string.
EXPANSIONS = 32


@dataclass
class _Info:
    """exact: all strings that match, if they are few; else None, and needs holds sets of strings, one of each of which a match contains."""

    exact: set[str] | None
    needs: list[set[str]] = field(default_factory=list)


def _analyse(node) -> _Info:  # noqa: ANN001
    known, needs = {""}, []

    def close() -> None:
        nonlocal known
        if known and all(len(s) >= 3 for s in known):
            needs.append(known)
        known = {""}

    for op, arg in node:
        part = _Info(None)
        if op is sre.LITERAL:
            part = _Info({chr(arg)})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            part = _Info({chr(c) for _, c in arg})
        elif op is sre.SUBPATTERN:
            part = _analyse(arg[-1])
        elif op is sre.BRANCH:
            ways = [_analyse(x) for x in arg[1]]
            if all(w.exact is not None for w in ways):
                part = _Info(set().union(*(w.exact for w in ways)))
            elif all(w.exact is not None and min(map(len, w.exact)) >= 3 or w.needs for w in ways):
                part = _Info(None, [set().union(*(w.exact if w.exact is not None else w.needs[0] for w in ways))])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _analyse(inner)
            if one.exact is not None and high <= 6 and len(one.exact) ** int(high) <= EXPANSIONS:
                part, grown = _Info(set()), {""}
                for k in range(int(high) + 1):
                    part.exact |= grown if k >= low else set()
                    grown = {a + b for a in grown for b in one.exact}
            elif low >= 1:
                part = _Info(None, one.needs or ([one.exact] if one.exact and min(map(len, one.exact)) >= 3 else []))
        if part.exact is not None and len(known) * len(part.exact) <= EXPANSIONS:
            known = {a + b for a in known for b in part.exact}
        else:
            close()
            needs += part.needs
            if part.exact is not None:
                known = part.exact
    if not needs:
        return _Info(known)
    close()
    return _Info(None, needs)


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """All of the outer items must hold; an item holds if all trigrams of one of its sets are there.

    Trigrams are of the text with A-Z lower-cased. An empty list: the rule has no mandatory trigram.
    """
    info = _analyse(sre_parse.parse(rule.pattern))
    needs = info.needs if info.exact is None else [info.exact]
    out = []
    for strings in needs:
        if all(len(s) >= 3 and s.isascii() for s in strings):
            out.append(sorted({frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))
    return out


class TrigramIndex:
    """Postings of the asked trigrams in a batch of texts."""

    #: Bytes looked at in one go; some 30 times as many are held meanwhile.
    CHUNK = 500_000

    def __init__(self, queries: list[list[list[frozenset[str]]]]):
        self.queries = queries
        self.grams = sorted({g for q in queries for item in q for s in item for g in s})
        self.code = np.zeros(1 << 21, np.int16)
        for i, g in enumerate(self.grams):
            a, b, c = g.encode()
            self.code[a << 14 | b << 7 | c] = i + 1
        lower = np.minimum(np.arange(256), 127).astype(np.uint32)  # a byte over 127 is in no asked trigram
        lower[65:91] += 32
        lower[128:] = 0
        self.lower = lower

    def postings(self, texts: list[bytes]) -> dict[str, set[int]]:
        found: dict[str, set[int]] = {g: set() for g in self.grams}
        a = 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b]) < self.CHUNK):
                held += len(texts[b]) + 1
                b += 1
            x = self.lower[np.frombuffer(b"\n".join(texts[a:b]), np.uint8)]
            if len(x) > 2:
                hit = self.code[x[:-2] << 14 | x[1:-1] << 7 | x[2:]]
                at = np.flatnonzero(hit)
                base = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
                doc = np.searchsorted(base, at, "right") - 1 + a
                for key in np.unique(doc * (len(self.grams) + 1) + hit[at]).tolist():
                    d, g = divmod(key, len(self.grams) + 1)
                    found[self.grams[g - 1]].add(d)
            a = b
        return found

    def candidates(self, texts: list[bytes]) -> list[set[int] | None]:
        """For each query the texts that may match; None: all."""
        found = self.postings(texts)
        return [
            set.intersection(*(set().union(*(set.intersection(*(found[g] for g in grams)) for grams in item)) for item in query)) if query else None
            for query in self.queries
        ]


def scanner(rules: list[Rule] = RULES) -> Callable[[list[str | None]], list[list[tuple[int, int, int]]]]:
    """A function from texts to spans (start, end, number of the rule), sorted by start, then rule."""
    index, compiled = TrigramIndex([trigram_query(r) for r in rules]), [r.compiled() for r in rules]

    def scan(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        texts = [t or "" for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, some in enumerate(index.candidates([t.encode("utf-8", "surrogatepass") for t in texts])):
            rule = rules[k]
            # A run of at least n characters of one class is the same as a run that is dropped if shorter.
            verify = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", re.ASCII) if some is None and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and not rule.ignore_case else compiled[k]
            for d in range(len(texts)) if some is None else some:
                out[d] += [(*m.span(), k) for m in verify.finditer(texts[d]) if len(m[rule.group]) >= rule.least]
        return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in out]

    return scan


#: The scanner of the rules that this Python worker has seen last.
_scanner: list = [None, None]


def _scanner_of(rules: list[Rule]) -> Callable[[list[str | None]], list[list[tuple[int, int, int]]]]:
    if _scanner[0] != rules:
        _scanner[:] = rules, scanner(rules)
    return _scanner[1]


def find_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with a column ``secrets``: an array of (kind, start, end), by start, then by the order of ``rules``."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan_batch(texts):  # noqa: ANN001
        import pandas as pd

        scan = _scanner_of(rules)
        return pd.Series([[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in scan(texts.tolist())])

    return docs.withColumn(free_name("secrets", docs.columns), scan_batch(F.col(text)))


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mask``; overlapping spans become one mask. Null text stays null."""

    @F.pandas_udf("string")
    def masked(texts):  # noqa: ANN001
        import pandas as pd

        scan, out = _scanner_of(rules), []
        given = texts.tolist()
        for t, spans in zip(given, scan(given)):
            if spans:
                parts, at, upto = [], 0, 0
                for a, b, _ in spans:
                    if a >= upto:
                        parts += [t[at:a], mask]
                        upto = b
                    upto = max(upto, b)
                    at = upto
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, masked(F.col(text)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *map(count, base),
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}
