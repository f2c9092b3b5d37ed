"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The tokenizer's own words are merged once and compiled into an automaton whose
common suffixes are shared; the numbers on its arcs add up to a word's place
among the outputs, so a walk yields the word's token ids. Tasks map it into
memory; all new words of a slice of text walk it together. Words that it lacks
are merged exactly, those of about the same length at once; a worker remembers
them, up to MOST_WORDS, then begins anew.

The tokenizer's file (a parameter) gives vocabulary, merges and special tokens.
The pipeline that is followed: special tokens are cut out of the raw text; the
rest is NFC-normalised and lower-cased; pieces are taken by the split pattern;
bytes become visible characters; the last one of a piece carries the end mark.

The lexicon follows from the tokenizer's file alone and only saves work: any
other one, and any state of what a worker remembers, gives the same ids.

Defined results: null text counts as empty and has no ids; its decoded text is
empty. Texts of any length are encoded whole. Repeated rows are encoded each on
their own; extra columns are kept (or those that ``keep`` names), and results go
to one struct column, ``bpe``, with as many ``_`` behind as make its name free.
No rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from paperloom.llm.common import free_name, table

BPE_TYPE = StructType([StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", LongType()), StructField("decoded", StringType())])

#: A worker remembers so many words that the lexicon lacks, of so many bytes each, at most.
MOST_WORDS, LONGEST_WORD = 50_000, 64
#: Bytes of text that a task handles at once.
SLICE = 1_000_000
#: Pieces of more symbols are merged with a queue, one by one.
SHORT = 64
#: Rank of a pair that no merge has.
NO_MERGE = np.int32(2**31 - 1)

#: Fixed value: the split pattern of the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The visible character of each byte: itself where printable, else one counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _class(members: str) -> str:
    """The inside of a character class, as ranges."""
    cps, out, a = sorted(map(ord, members)), [], 0
    for b in range(1, len(cps) + 1):
        if b == len(cps) or cps[b] != cps[b - 1] + 1:
            out.append(f"{re.escape(chr(cps[a]))}-{re.escape(chr(cps[b - 1]))}")
            a = b
    return "".join(out)


def split_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The split pattern for lower-case ASCII, and for texts below U+10000, with its classes written out."""
    out = []
    for most in (0x80, 0x10000):
        every = "".join(chr(c) for c in range(most) if not 0xD800 <= c < 0xE000)
        letters, numbers, spaces = (_class("".join(regex.findall(c, every))) for c in (r"\p{L}", r"\p{N}", r"\s"))
        out.append(re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^{spaces}{letters}{numbers}]+"))
    return out[0], out[1]


class Merger:
    """Exact BPE merges of pieces."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        by = np.argsort(keys)
        #: Pairs of symbols in order, and the rank of each; what a pair of a rank becomes.
        self.keys, self.ranks = keys[by], by.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        chars = byte_characters()
        self.first_ids = np.array([vocab[c] for c in chars], np.int32)
        self.last_ids = np.array([vocab[c + end] for c in chars], np.int32)
        steps = spec["normalizer"]["normalizers"] if "normalizers" in (spec["normalizer"] or {}) else [spec["normalizer"]]
        assert [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"], "another normalizer"
        splits = spec["pre_tokenizer"]["pretokenizers"]
        assert [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["invert"], "another pre-tokenizer"
        self.pattern = splits[0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        self._rank: dict[int, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_MERGE)

    def ids(self, piece: str) -> list[int]:
        return self.batch([piece.encode("utf-8", "surrogatepass")])[0].tolist()

    def batch(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces laid end to end, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        place = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of pieces, their symbols (-1: none)
        low = 0
        for high in (4, 8, 16, 32, SHORT):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                at = np.arange(high)
                inside = at < size[rows][:, None]
                byte = data[np.minimum(place[rows][:, None] + at, len(data) - 1)]
                symbols = np.where(inside, self.first_ids[byte], np.int32(-1))
                every = np.arange(len(rows))
                symbols[every, size[rows] - 1] = self.last_ids[byte[every, size[rows] - 1]]
                done += self._merge(rows, symbols)
            low = high
        for row in np.flatnonzero(size > SHORT):
            some = self.first_ids[data[place[row] : place[row] + size[row]]].tolist()
            some[-1] = int(self.last_ids[data[place[row] + size[row] - 1]])
            done.append((np.array([row]), np.array([self._merge_long(some)], np.int32)))
        count = np.zeros(len(pieces), np.int64)
        for rows, symbols in done:
            count[rows] = (symbols >= 0).sum(1)
        start, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int32)
        for rows, symbols in done:
            held = symbols >= 0
            out[(start[rows][:, None] + np.arange(symbols.shape[1]))[held]] = symbols[held]
        return out, count

    def _merge(self, rows: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each round merges, in every row, the first pair of the lowest rank; rows without one are done."""
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while True:
            width = symbols.shape[1]
            if width < 2:
                yield rows, symbols
                return
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            over = low == NO_MERGE
            if over.any():
                yield rows[over], symbols[over]
                rows, symbols, ranks, at, low = rows[~over], symbols[~over], ranks[~over], at[~over], low[~over]
                if not len(rows):
                    return
            every, after = np.arange(len(rows)), np.arange(width - 1) > at[:, None]
            symbols = np.where(after, symbols[:, 1:], symbols[:, :-1])
            symbols[every, at] = self.merged[low]
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.rank(symbols[left, at[left] - 1], symbols[left, at[left]])
            ranks[right, at[right]] = self.rank(symbols[right, at[right]], symbols[right, at[right] + 1])

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same of one piece, in n log n."""
        if not self._rank:
            self._rank = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        n, rank = len(symbols), self._rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            low, i, a, b = heapq.heappop(queue)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            new = symbols[i] = int(self.merged[low])
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(new << 32 | symbols[k])) is not None:
                    heapq.heappush(queue, (r, i, new, symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] << 32 | new)) is not None:
                heapq.heappush(queue, (r, h, symbols[h], new))
        return [s for s in symbols if s >= 0]


def compile_transducer(words: Iterable[bytes], outputs: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of ``words``, serialised with their outputs.

    Words come sorted. States that are complete are looked up among those made before (same finality, same arcs),
    so each suffix is stored once. An arc holds the number of words that its earlier sisters lead to.
    """
    made: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]], int]] = []  # final, arcs, words from here

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in made:
            made[key] = len(states)
            states.append((node[0], node[1], node[0] + sum(states[t][2] for _, t in node[1])))
        return made[key]

    path: list[list] = [[False, []]]  # open nodes: final, arcs; the last arc's target is open
    last = b""
    ordered = list(words)
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        if word is not None:
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
    root = settle(path[0])
    arcs, targets, skips, final = [], [], [], bytearray()
    for state, (is_final, out, _) in enumerate(states):
        final.append(is_final)
        seen = int(is_final)
        for label, target in out:
            arcs.append(state << 8 | label)
            targets.append(target)
            skips.append(seen)
            seen += states[target][2]
    flat, starts = [], [0]
    for w in ordered:
        flat += outputs[w]
        starts.append(len(flat))
    parts = [bytes(final), struct.pack(f"<{len(arcs)}Q", *arcs), *(struct.pack(f"<{len(x)}I", *x) for x in (targets, skips, starts, flat))]
    padded = [p + bytes(-len(p) % 8) for p in parts]
    return struct.pack("<8Q", root, len(states), *map(len, parts)) + b"".join(padded)


class Transducer:
    """A compiled lexicon in mapped memory, walked by many words at once."""

    def __init__(self, data: bytes):
        self.map = mmap.mmap(-1, max(len(data), 1))  # belongs to no file, so nothing is left behind
        self.map.write(data)
        self.root, _, *sizes = struct.unpack_from("<8Q", self.map)
        at, views = 64, []
        for size, kind in zip(sizes, (np.uint8, np.int64, np.uint32, np.uint32, np.uint32, np.uint32)):
            views.append(np.frombuffer(self.map, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        #: Arcs are (state, label) in order.
        self.final, self.arcs, self.targets, self.skips, self.starts, self.flat = views

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the outputs, or -1."""
        size = np.array([len(w) for w in words], np.int64)
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.arcs) else np.zeros(0, np.int64)
        found, step = np.full(len(words), -1, np.int64), 0
        while len(live):
            over = live[size[live] == step]
            ends = over[self.final[state[over]] == 1]
            found[ends] = number[ends]
            live = live[size[live] > step]
            asked = state[live] << 8 | data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, asked), len(self.arcs) - 1)
            known = self.arcs[at] == asked
            live, at = live[known], at[known]
            number[live] += self.skips[at]
            state[live] = self.targets[at]
            step += 1
        return found

    def output(self, place: int) -> np.ndarray:
        return self.flat[self.starts[place] : self.starts[place + 1]].astype(np.int32)

    def lookup(self, word: bytes) -> list[int] | None:
        place = int(self.places([word])[0])
        return None if place < 0 else self.output(place).tolist()


class Codec:
    """Encodes and decodes texts. Remembers the ids of the words of the lexicon that it has met, and of MOST_WORDS others at most."""

    def __init__(self, merger: Merger, lexicon: bytes | Transducer | None = None):
        self.merger, self.lexicon = merger, Transducer(lexicon) if isinstance(lexicon, bytes) and lexicon else lexicon or None
        self.find = regex.compile(merger.pattern).findall
        self.find_ascii, self.find_plane = (p.findall for p in split_patterns()) if merger.pattern == PATTERN else (self.find, self.find)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, merger.special)) + ")").split if merger.special else None
        #: The slot of a piece; where a slot's ids start, and how many they are; its tokens.
        self.slot: dict[str, int] = {}
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.shown: list[str] = []
        self.others = 0  # words remembered that the lexicon lacks
        self._add(list(merger.special), np.array(list(merger.special.values()), np.int32), np.ones(len(merger.special), np.int64))

    def _add(self, pieces: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first, text = len(self.shown), self.merger.text
        self.slot.update(zip(pieces, range(first, first + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
        self.counts, self.flat = np.concatenate((self.counts, counts)), np.concatenate((self.flat, flat))
        ids, at = flat.tolist(), 0
        for n in counts.tolist():
            self.shown.append(text[ids[at]] if n == 1 else " ".join([text[i] for i in ids[at : at + n]]))
            at += n

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.find_plane if max(text) < "\U00010000" else self.find)(text)

    def all_pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text or not self.split_special:
            return self.pieces(text)
        return [p for part in self.split_special(text) for p in ([part] if part in self.merger.special else self.pieces(part))]

    def encode_batch(self, texts: list[str | None], decoded: bool = True) -> tuple[np.ndarray, np.ndarray, list[str] | None]:
        """The ids of all texts laid end to end, how many each has, and their decoded texts."""
        split = [self.all_pieces(t) for t in texts]
        if self.others >= MOST_WORDS:
            self.__init__(self.merger, self.lexicon)
        new = list(set(chain.from_iterable(split)).difference(self.slot))
        data = [p.encode("utf-8", "surrogatepass") for p in new]
        places = self.lexicon.places(data).tolist() if self.lexicon else [-1] * len(new)
        known = [i for i, x in enumerate(places) if x >= 0]
        if known:
            outputs = [self.lexicon.output(places[i]) for i in known]
            self._add([new[i] for i in known], np.concatenate(outputs), np.array([len(x) for x in outputs], np.int64))
        lacked = [i for i, x in enumerate(places) if x < 0]
        often = [i for i in lacked if len(data[i]) <= LONGEST_WORD][: MOST_WORDS - self.others]
        if often:
            self._add([new[i] for i in often], *self.merger.batch([data[i] for i in often]))
            self.others += len(often)
        keep, kept = len(self.shown), len(self.flat)
        rare = [i for i in lacked if new[i] not in self.slot]
        if rare:
            self._add([new[i] for i in rare], *self.merger.batch([data[i] for i in rare]))
        size = np.array([len(p) for p in split], np.int64)
        slots = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        counts = self.counts[slots]
        upto = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[slots] - upto + counts, counts) + np.arange(int(counts.sum()))]
        ends = np.concatenate(([0], upto))[np.cumsum(size)]
        shown = None
        if decoded:
            told, shown, a = list(map(self.shown.__getitem__, slots.tolist())), [], 0
            for n in size.tolist():
                shown.append(" ".join(told[a : a + n]))
                a += n
        # Long words, and those beyond MOST_WORDS, are not kept.
        for i in rare:
            del self.slot[new[i]]
        del self.shown[keep:]
        self.starts, self.counts, self.flat = self.starts[:keep], self.counts[:keep], self.flat[:kept]
        return ids, np.diff(ends, prepend=0), shown

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """Ids and decoded text of one text."""
        ids, _, shown = self.encode_batch([text])
        return ids.tolist(), shown[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the tokenizer's file, tokens are joined by a space."""
        return " ".join(self.merger.text[i] for i in ids if 0 <= i < len(self.merger.text) and self.merger.text[i])


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE bytes of text (or one longer text), so that what a task holds does not follow the size of a batch."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def whole_words(merger: Merger) -> list[str]:
    """The tokenizer's own words: what its tokens that end a piece spell, sorted. No text is looked at."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    found = set()
    for token in merger.text:
        if merger.end and token.endswith(merger.end) and token not in merger.special:
            with suppress(KeyError, UnicodeDecodeError):
                found.add(bytes(byte[c] for c in token[: -len(merger.end)]).decode())
    return sorted(w for w in found if len(w) > 1)


def build_lexicon(words: list[str], merger: Merger) -> bytes:
    keys = sorted({w.encode("utf-8", "surrogatepass") for w in words if w})
    flat, counts = merger.batch(keys)
    ends = np.cumsum(counts)
    return compile_transducer(keys, {k: flat[b - n : b].tolist() for k, b, n in zip(keys, ends.tolist(), counts.tolist())})


#: The codec of the last lexicon that this Python worker has seen.
_codec: list = [None, None]


def _codec_of(shared: Broadcast) -> Codec:
    merger, lexicon = shared.value
    if _codec[0] is not merger:
        _codec[:] = None, None
        _codec[:] = merger, Codec(merger, lexicon)
    return _codec[1]


def encode_texts(docs: DataFrame, path: str, text: str = "text", lexicon: bytes | None = None, keep: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """``docs`` (only the columns in ``keep``, if given) with a struct column ``bpe``: ids, n_tokens, decoded (null unless asked for)."""
    merger = Merger(load_spec(path))
    if lexicon is None:
        lexicon = build_lexicon(whole_words(merger), merger)
    shared = docs.sparkSession.sparkContext.broadcast((merger, lexicon))

    # The text goes last, so that it need not come back.
    last = free_name("_text", docs.columns)
    asked = docs.select(*(["*"] if keep is None else keep), F.col(text).alias(last))
    fields = asked.schema.fields[:-1]
    into = free_name("bpe", [f.name for f in fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared)
        for batch in batches:
            for rows in slices(batch, len(fields)):
                ids, counts, shown = codec.encode_batch(rows.column(len(fields)).to_pylist(), decoded)
                told = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                found = pa.StructArray.from_arrays([told, pa.array(counts, pa.int64()), pa.array(shown if decoded else [None] * len(counts), pa.string())], ["ids", "n_tokens", "decoded"])
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], found], names=[*(f.name for f in fields), into])

    return asked.mapInArrow(encode, StructType([*fields, StructField(into, BPE_TYPE)]))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep=["doc_id"])
    ids = F.array_join(F.col("bpe.ids").cast("array<string>"), " ")
    return docs.select("doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
