"""Language identification: script ranges narrow the candidate languages of a
word, and a Viterbi pass over per-word scores with a switching penalty labels
spans of mixed-language text.

Per-word scores come from hashed character trigrams and whole words, whose
counts by language are summed by Spark over a bounded sample of labelled rows
(``docs_per_language`` rows for each language at most, chosen by a hash of the
id). The MOST_LANGUAGES labels with the most rows are learned. A language is a
candidate for words of those scripts that a share of SCRIPT_SHARE of its words
is written in; only candidates are scored, the others get FOREIGN_SCRIPT.
Prediction runs over whole texts, a batch at a time, in numpy.

Defined results: null text, empty text and text without a letter give ``und``
with score 0 and no span. Repeated rows are predicted each on their own. With
no labelled row at all every text is ``und``. Ties between languages go to the
one that sorts first. Texts of any length are labelled whole. Extra columns are
kept by ``label_languages``; its results go to one struct column, ``language``,
with as many ``_`` behind as make its name free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import free_name, table

#: First and last code points of the scripts that are told apart.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]

#: Size of the model: features are hashed to so many bits, fewer if languages x features would be more than MOST_WEIGHTS,
#: but not under LEAST_BITS. All labels are learnt, up to the number that these leave room for (the frequent ones first).
BITS, LEAST_BITS = 18, 11
MOST_WEIGHTS = 1 << 24
MOST_LANGUAGES = MOST_WEIGHTS >> LEAST_BITS
#: Code points handled at once; bounds the memory of a task whatever the batch.
CHUNK = 250_000
SWITCH_PENALTY = 12.0
#: What a word costs in a language that does not use its script.
FOREIGN_SCRIPT = -20.0
#: A language uses a script if so large a share of its letters is of it.
SCRIPT_SHARE = 0.01

_tables: dict[str, np.ndarray] = {}


def _code_tables() -> dict[str, np.ndarray]:
    if not _tables:
        n = 0x110000
        letter, lower, script = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
        for cp in range(0x41, 0x33480):
            c = chr(cp)
            if c.isalpha():
                letter[cp] = True
                if len(low := c.lower()) == 1:
                    lower[cp] = ord(low)
        for name, a, b in SCRIPT_RANGES:
            script[a : b + 1] = SCRIPTS.index(name)
        _tables.update(letter=letter, lower=lower, script=script)
    return _tables


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words (runs of letters) of some texts laid end to end."""

    start: np.ndarray  # offsets in the code points
    end: np.ndarray
    doc: np.ndarray  # the text that a word is in
    base: np.ndarray  # where each text starts
    script: np.ndarray
    feature: np.ndarray  # of each letter, then of each word
    owner: np.ndarray  # the word that a letter is in


def words_of(texts: list[str], bits: int = BITS) -> Words:
    tab = _code_tables()
    joined = "\n".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    letter = tab["letter"][cps]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = np.where(letter, tab["lower"][cps], 0).astype(np.uint64)
    padded = np.concatenate(([0], low, [0])).astype(np.uint64)
    at = np.flatnonzero(letter)
    tri = padded[at] | (padded[at + 1] << np.uint64(21)) | (padded[at + 2] << np.uint64(42))
    owner = np.repeat(np.arange(len(start)), end - start)
    # A word's hash is a sum over its letters, each mixed with its place in the word.
    place = (at - start[owner]).astype(np.uint64)
    each = _mix(low[at] * np.uint64(0x9E3779B97F4A7C15) + place + np.uint64(1))
    whole = np.add.reduceat(each, np.searchsorted(at, start)) if len(start) else np.zeros(0, np.uint64)
    mask = np.uint64((1 << bits) - 1)
    feature = np.concatenate((_mix(tri) & mask, _mix(whole + np.uint64(0x51ED27)) & mask)).astype(np.int64)
    return Words(start, end, np.searchsorted(base, start, "right") - 1, base, tab["script"][cps[start]], feature, owner)


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of texts that together are about CHUNK code points."""
    a = held = 0
    for b, t in enumerate(texts):
        if b > a and held + len(t) > CHUNK:
            yield slice(a, b)
            a, held = b, 0
        held += len(t)
    if a < len(texts):
        yield slice(a, len(texts))


@dataclass
class LanguageModel:
    languages: list[str]
    bits: int
    weights: np.ndarray  # [2**bits, languages]: log likelihoods, centred; 0 where nothing was seen
    uses: np.ndarray  # [scripts, languages]: whether a language is written in a script

    def candidates(self, script: int) -> np.ndarray:
        """The languages that a word of a script may be of; all if none is known to use it."""
        some = np.flatnonzero(self.uses[script])
        return some if len(some) else np.arange(len(self.languages))

    def word_scores(self, w: Words) -> np.ndarray:
        """[words, languages]. The words of a script are scored in its candidates only."""
        n, letters = len(w.start), len(w.owner)
        out = np.full((n, len(self.languages)), FOREIGN_SCRIPT)
        if not n:
            return out
        first = np.searchsorted(w.owner, np.arange(n))
        for script in np.unique(w.script).tolist():
            words, some = np.flatnonzero(w.script == script), self.candidates(script)
            if len(words) == n:
                of_letters, starts = w.feature[:letters], first
            else:
                of_letters = w.feature[:letters][w.script[w.owner] == script]
                sizes = np.diff(np.append(first, letters))[words]
                starts = np.cumsum(sizes) - sizes
            table = self.weights if len(some) == len(self.languages) else self._narrow(script, some)
            scores = np.add.reduceat(table[of_letters], starts, axis=0, dtype=np.float64) + table[w.feature[letters + words]]
            out[words[:, None], some] = scores
        return out

    def _narrow(self, script: int, some: np.ndarray) -> np.ndarray:
        """The weights of the candidates of a script; kept, since the same few sets come again and again."""
        held = self.__dict__.setdefault("_held", {})
        if script not in held:
            held[script] = np.ascontiguousarray(self.weights[:, some])
        return held[script]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best sequence of labels when each change costs ``penalty``. Ties go to no change, then to the smaller label."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(np.concatenate((np.zeros((1, k)), scores - scores[:, [best]])), axis=0)
    # No interval gains more than half of what one change costs: then each stretch off the best label, which has a change
    # at an end at least, and as many changes as labels if it is inside, gains no more than its changes cost.
    if 2 * (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(n, best)
    back, rows = [], scores.tolist()
    value, labels = rows[0], range(k)
    for row in rows[1:]:
        top = max(value)
        arg = value.index(top)
        stay = [v >= top - penalty for v in value]
        back.append([j if stay[j] else arg for j in labels])
        value = [(value[j] if stay[j] else top - penalty) + row[j] for j in labels]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def label_texts(texts: list[str | None], model: LanguageModel, penalty: float = SWITCH_PENALTY) -> list[dict]:
    """For each text: lang, score and spans (start, end, lang), in code points, end exclusive."""
    texts, out = [t or "" for t in texts], []
    for part in _chunks(texts):
        some = texts[part]
        w = words_of(some, model.bits)
        scores = model.word_scores(w) if model.languages else None
        edges = np.searchsorted(w.doc, np.arange(len(some) + 1))
        for d in range(len(some)):
            a, b = edges[d], edges[d + 1]
            if a == b or scores is None:
                out.append({"lang": "und", "score": 0.0, "spans": []})
                continue
            path = viterbi(scores[a:b], penalty)
            start, end = w.start[a:b] - w.base[d], w.end[a:b] - w.base[d]
            share = np.bincount(path, end - start, len(model.languages))
            top = int(share.argmax())
            total = scores[a:b].sum(0)
            sure = 1 / np.exp(np.minimum(total - total[top], 50)).sum()
            cut = np.flatnonzero(np.diff(path, prepend=-1))
            stop = np.append(cut[1:], len(path)) - 1
            spans = [{"start": int(start[i]), "end": int(end[j]), "lang": model.languages[path[i]]} for i, j in zip(cut, stop)]
            out.append({"lang": model.languages[top], "score": float(share[top] / share.sum() * sure), "spans": spans})
    return out


def fit_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", docs_per_language: int = 3000) -> LanguageModel:
    """Counts of features by language over a bounded sample: about ``docs_per_language`` rows of each language.

    The counts that reach the driver are bounded by languages x 2**BITS.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(ident).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], BITS, np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    bits = min(BITS, int(np.log2(MOST_WEIGHTS / len(languages))))
    spark = docs.sparkSession
    rate = F.broadcast(spark.createDataFrame([(l, min(1.0, docs_per_language / sizes[l])) for l in languages], "l string, rate double"))  # MOST_LANGUAGES rows
    sample = known.join(rate, "l").where(F.pmod(F.xxhash64("k", "t"), F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("t", "l")
    number = {l: i for i, l in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array([number[l] for l in batch.column(1).to_pylist()], np.int64)
            for part in _chunks(texts):
                w, own = words_of(texts[part], bits), labels[part]
                of_word = own[w.doc]
                key = np.concatenate((of_word[w.owner], of_word)) * (1 << bits) + w.feature
                k, n = np.unique(key, return_counts=True)
                s, m = np.unique(of_word * len(SCRIPTS) + w.script, return_counts=True)
                yield pa.RecordBatch.from_pydict({"f": np.concatenate((k, -1 - s)), "n": np.concatenate((n, m)).astype(np.int64)})

    counts = sample.mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    size = len(languages)
    seen, script = np.zeros((size, 1 << bits)), np.zeros((size, len(SCRIPTS)))
    f, n = counts["f"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    seen.reshape(-1)[f[f >= 0]] = n[f >= 0]
    script.reshape(-1)[-1 - f[f < 0]] = n[f < 0]
    alpha = 0.5
    logs = np.log((seen + alpha) / (seen.sum(1, keepdims=True) + alpha * (1 << bits)))
    logs = np.where(seen.sum(0) > 0, logs - logs.mean(0), 0)
    uses = script / np.maximum(script.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
    return LanguageModel(languages, bits, logs.T.astype(np.float32).copy(), uses.T.copy())


def label_languages(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with a struct column ``language``: lang, score, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def label(texts):  # noqa: ANN001
        import pandas as pd

        return pd.DataFrame(label_texts([None if t is None else t for t in texts.tolist()], shared.value, penalty), columns=["lang", "score", "spans"])

    # Else a filter on the result would run it once more.
    return docs.withColumn(free_name("language", docs.columns), label.asNondeterministic()(F.col(text)))


def held_out(ident: Column) -> Column:
    return F.pmod(F.crc32(ident.cast("string")), F.lit(3)) == 1


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return label_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").cast("long").alias("n_spans")
    )


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
