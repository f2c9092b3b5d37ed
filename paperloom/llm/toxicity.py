"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter.

Both dictionaries are trained on a bounded sample of labelled rows. The one of
ordinary text is trained on windows of ordinary documents. The one of toxic text
has the same content, and before it what is trained on the words that set toxic
documents apart: those with many different words before and after them (so that
copies and passages that documents share don't count for more than once) and in
far more toxic documents than ordinary ones. A window of ordinary words is as long
with either; what the toxic dictionary saves is the distance. The numbers of
windows beyond thresholds of it, and their shares, become a probability by a
logistic curve, calibrated on labelled rows that the dictionaries have not seen.
Each text is scored whole, in windows of ``WORDS`` words.

Defined results: null text counts as empty; a text without words has no windows
and the probability of one without any distance. Without labels of both kinds
every score is the share of toxic labels, drawn to 0.1 where there are none.
Labels other than 0 and 1, of a null id, or of ids that aren't in the documents,
teach nothing; of several labels of an id the greatest counts. Equal texts have
equal scores. Rows without an id are scored and not held out; repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import delete_table, table, write_table

#: Words of a window, and characters of a word (a longer one is cut into several).
WORDS, LONGEST_WORD = 8, 48
#: Labelled rows that are learnt from, about, of toxic and ordinary documents.
MOST_TOXIC, MOST_ORDINARY = 3_000, 12_000
#: Of a word, or first STEM characters of words, of the toxic dictionary: different words before and after it, its share of toxic documents to that of ordinary ones.
SUPPORT, CONTRAST, STEM = 6, 8.0, 5
#: Words and windows that are given to the training of a dictionary at most, the frequent words first.
MOST_MARKS, MOST_WINDOWS = 20_000, 100_000
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 2_048, 32_768, 12
#: Each window follows so many bytes of the ordinary dictionary's end, so that zstandard never leaves a short one uncompressed.
LEAD = 48
#: A document is toxic from this score on.
TOXIC_FROM = 0.3
#: Thresholds of the distance, in bytes, above which windows are counted.
BYTES = (1, 2, 3, 5)
_WORD = re.compile(r"\w{1,%d}" % LONGEST_WORD)


def windows(text: str | None, words: int = WORDS) -> Iterator[bytes]:
    """All words of a text in lower case, so many at a time."""
    held: list[str] = []
    for m in _WORD.finditer((text or "").lower()):
        held.append(m[0])
        if len(held) == words:
            yield f" {' '.join(held)} ".encode()
            held = []
    if held:
        yield f" {' '.join(held)} ".encode()


@dataclass
class ToxicityModel:
    """Dictionaries of toxic and ordinary text, and the curve that turns distances into a probability."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (2 * len(BYTES) + 2))
    prior: float = 0.1

    def __post_init__(self):
        self._pair: list[zstandard.ZstdCompressor] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"} | {"_pair": []}

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes of each window that the toxic dictionary saves beyond the ordinary one."""
        if not self._pair:
            for content in (self.toxic + self.ordinary, self.ordinary):
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        (toxic, ordinary), lead = self._pair, self.ordinary[-LEAD:]
        return np.fromiter((len(ordinary.compress(lead + w)) - len(toxic.compress(lead + w)) for w in windows(text)), np.int32)

    def features(self, text: str | None) -> np.ndarray:
        d = self.distances(text) if self.toxic and self.ordinary else np.zeros(0, np.int32)
        if not len(d):
            return np.zeros(2 * len(BYTES) + 1)
        beyond = np.array([(d >= b).sum() for b in BYTES], float)
        return np.concatenate((np.log1p(beyond), np.sqrt(beyond / len(d)), [d.max() / 8]))

    def score(self, text: str | None) -> float:
        if not (self.toxic and self.ordinary):
            return self.prior
        z = float(np.dot(self.weights[1:], self.features(text)) + self.weights[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content; of too few samples to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32 if size < 8_192 else 64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def calibrated(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a logistic curve (the first is the offset), by Newton's method with a small penalty."""
    design = np.concatenate((np.ones((len(x), 1)), x), 1)
    at, penalty = np.zeros(design.shape[1]), np.full(design.shape[1], 0.3)
    penalty[0] = 0.01
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty), design.T @ (y - p) - penalty * at)
        at = at + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return at.tolist()


def held_out(ident: Column) -> Column:
    """Rows whose labels are not learnt from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _share(value: Column, share: Column | float) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(13)), F.lit(1_000_000)) < F.lit(1_000_000) * share


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, ident: str, label: str) -> tuple[DataFrame, float]:
    """(text, toxic) of about MOST_TOXIC and MOST_ORDINARY labelled rows, each text once, and the share of toxic labels.

    Ids are chosen by hash, so few that they may be broadcast; rows of an id that has many are thinned by their texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & ~held_out(F.col(ident))).groupBy(F.col(ident).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    bounds = {1: MOST_TOXIC, 0: MOST_ORDINARY}

    def thinned(rows: DataFrame, value: str, counts: dict[int, int]) -> DataFrame:
        share = F.when(F.col("toxic") == 1, min(1.0, bounds[1] / max(counts.get(1, 0), 1))).otherwise(min(1.0, bounds[0] / max(counts.get(0, 0), 1)))
        return rows.where(_share(F.col(value), share))

    counted = lambda rows: {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # noqa: E731 (two rows)
    total = counted(known)
    chosen = F.broadcast(thinned(known, "_id", total))  # MOST_TOXIC + MOST_ORDINARY ids, about
    met = counted(docs.select(F.col(ident).alias("_id")).join(chosen, "_id"))
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("text")).join(chosen, "_id").where("text is not null")
    rows = thinned(rows, "text", met).groupBy("text").agg(F.max("toxic").alias("toxic"))
    return rows, total.get(1, 0) / (sum(total.values()) or 1) if total else 0.1


def _marks_of(text: str) -> Iterator[tuple[str, str, str]]:
    """(mark, word before, word after) for the words of a text and for their stems; marks have the spaces beside them."""
    found = _WORD.findall(text.lower())
    for before, word, after in zip(["", *found], found, [*found[1:], ""]):
        yield f" {word} ", before, after
        if len(word) > STEM:
            yield f" {word[:STEM]}", before, after


def marks(sample: DataFrame, n: dict[int, int]) -> list[tuple[str, int]]:
    """(mark, support) of the words, and the stems of words, that set toxic documents apart.

    Those that are in far more toxic documents than ordinary ones come first; of these, the ones with many different
    words before them and many after: each word of a passage that documents share has one of them only.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [Counter(), Counter()]
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[toxic].update({m for m, _, _ in _marks_of(t)})
            words = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_pydict({"mark": pa.array(words, pa.string()), "t": pa.array([sums[1][w] for w in words], pa.int64()), "o": pa.array([sums[0][w] for w in words], pa.int64())})

    counted = sample.select("text", "toxic").mapInArrow(documents, "mark string, t long, o long").groupBy("mark").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    apart = counted.where((F.col("t") >= SUPPORT) & (F.col("t") / n[1] > CONTRAST * (F.col("o") + 1) / n[0]))
    chosen = {r["mark"] for r in apart.orderBy(F.desc("t"), "mark").limit(MOST_MARKS).collect()}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(m, side, zlib.crc32(w.encode())) for t in batch.column(0).to_pylist() for m, *beside in _marks_of(t) if m in chosen for side, w in enumerate(beside)}
            yield pa.RecordBatch.from_pydict({"mark": pa.array([f[0] for f in found], pa.string()), "side": pa.array([f[1] for f in found], pa.int32()), "word": pa.array([f[2] for f in found], pa.int64())})

    met = sample.where("toxic = 1").select("text").mapInArrow(neighbours, "mark string, side int, word long").distinct()
    support = met.groupBy("mark", "side").agg(F.count("*").alias("n")).groupBy("mark").agg(F.min("n").alias("n"))
    return [(r["mark"], r["n"]) for r in support.where(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "mark").collect()]  # MOST_MARKS at most


def ordinary_windows(sample: DataFrame) -> list[bytes]:
    """About MOST_WINDOWS different windows of ordinary documents, chosen and ordered by their hash."""
    ordinary = sample.where("toxic = 0")
    total = ordinary.agg(F.sum(F.length("text") / (6 * WORDS) + 1)).head()[0] or 0
    limit = int((1 << 32) * min(1.0, MOST_WINDOWS / max(total, 1)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in windows(t) if zlib.crc32(w) < limit}
            yield pa.RecordBatch.from_pydict({"w": pa.array(sorted(found), pa.binary())})

    return [bytes(r["w"]) for r in ordinary.select("text").mapInArrow(some, "w binary").distinct().orderBy(F.xxhash64("w"), "w").limit(2 * MOST_WINDOWS).collect()]


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """What is trained on toxic and on ordinary rows of ``sample``; empty where one of the two kinds has no rows, or nothing sets them apart."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        return b"", b""
    words = sorted(marks(sample, n), key=lambda w: (zlib.crc32(w[0].encode()), w))
    # A word as often as different words stand before it, so that the frequent ones are kept.
    repeats = [w.encode() for k in range(max((t for _, t in words), default=0)) for w, t in words if t > k]
    toxic = trained(repeats[: 5 * MOST_MARKS], TOXIC_BYTES) if words else b""
    for w, _ in sorted(words, key=lambda w: (-w[1], w)):
        # The training may leave frequent words out for pieces of several; they follow while there is room.
        if w.encode() not in toxic and len(toxic) + len(w.encode()) <= TOXIC_BYTES:
            toxic += w.encode()
    return toxic, trained(ordinary_windows(sample), ORDINARY_BYTES)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """The curve is calibrated on a third of the sample, with dictionaries of the rest; the model's own dictionaries are those of all of it."""
    spark = docs.sparkSession
    rows, prior = labelled_sample(docs, labels, text, ident, label)
    path = write_table(rows, "toxicity")
    sample = spark.read.schema("text string, toxic int").parquet(path)
    tune = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(3)) == 0
    model = ToxicityModel(*dictionaries(sample.where(~tune)), prior=prior)
    if model.toxic and model.ordinary:

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"x": pa.array([model.features(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), "y": batch.column(1)})

        got = sample.where(tune).select("text", "toxic").mapInArrow(measured, "x array<double>, y int").collect()  # a third of the sample, some numbers each
        order = sorted((list(r["x"]), r["y"]) for r in got)
        if order:
            toxic, ordinary = dictionaries(sample)
            model = ToxicityModel(toxic, ordinary, calibrated(np.array([x for x, _ in order]), np.array([y for _, y in order], float)), prior)
        else:
            model = ToxicityModel(prior=prior)
    delete_table(spark, path)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, score) of each row."""

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001
        import pandas as pd

        return pd.Series([model.score(t) for t in texts.tolist()], dtype="float64")

    return docs.select(*keep, scored(F.col(text)).alias("score"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLES: dict[str, str] = {}
