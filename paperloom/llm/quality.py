"""Quality classification by hierarchical empirical Bayes.

A document classifier (naive Bayes over hashed words and marks, fitted on a
bounded sample of labelled rows) gives each document's log odds; their slope and
offset come from labelled rows that the weights have not seen. Labels and
these odds are summed by host and by path below it; a path's rate of good
documents shrinks towards its host's, a host's towards the global one, by so
many pseudo-documents as the spread between hosts (or paths) suggests. A
document's own label, or odds, are taken out of the rates that it meets. The
posterior adds the site's log odds, relative to the global ones, to the
document's.

Defined results: null text is scored as empty (its log odds are those of the
site); null host or path is a group of its own. Without labels every
probability is 0.5 and every document is kept. Repeated rows are scored each on
their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, skew_join, table

BITS = 14
#: Labelled rows that the classifier is fitted on, about; a document is dropped below KEEP.
MOST_LABELLED = 20_000
KEEP = 0.2
#: The slope of the log odds where no held-out rows tell.
SLOPE = 8.0
FEATURES = re.compile(r"\w+|[^\w\s]")


def _features(text: str | None) -> np.ndarray:
    """Hashed features of a text: words by case, length class and marks; not the words of a language themselves."""
    import zlib

    known: dict[str, int] = {}
    out = []
    for w in FEATURES.findall(text or ""):
        f = known.get(w)
        if f is None:
            shape = "U" if len(w) > 1 and w.isupper() else "T" if w[:1].isupper() else "d" if w.isdigit() else "l" if w.isalpha() else w
            known[w] = f = (zlib.crc32(f"{shape}{min(len(w), 12)}".encode()) % 512) * 2, 2 * (512 + zlib.crc32(w.lower().encode()) % ((1 << BITS) // 2 - 512)) + 1
        out.append(f)
    return np.array(out, np.int64).ravel() % (1 << BITS)


def fit_classifier(labelled: DataFrame, text: str, good: str, most: int = MOST_LABELLED) -> tuple[np.ndarray, float, float]:
    """Weights of features; slope and offset that turn a document's mean weight into log odds."""
    n = labelled.count()
    sample = labelled.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < 1_000_000 * min(1.0, most / max(n, 1))).select(text, F.col(good).cast("int").alias("g"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, 1 << BITS), np.int64)
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Once a document, so that a long one has one voice.
                np.add.at(sums[g], np.unique(_features(t)), 1)
            at = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_pydict({"f": at, "n": sums.ravel()[at]})

    held_out = F.pmod(F.xxhash64(text, F.lit(3)), F.lit(3)) == 0
    sums = np.zeros(2 << BITS)
    pdf = sample.where(~held_out).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    sums[pdf["f"].to_numpy(np.int64)] = pdf["n"]
    bad, fine = sums.reshape(2, -1)
    totals = {r.g: r["count"] for r in sample.groupBy("g").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    weights = np.log((fine + 1) / (2 * n1 / 3 + 2)) - np.log((bad + 1) / (2 * n0 / 3 + 2))
    weights[(fine + bad) < 2] = 0
    weights = weights.astype(np.float32)
    prior = float(np.log((n1 + 1) / (n0 + 1)))

    def mean_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"m": pa.array([_mean_weight(weights, t) for t in batch.column(0).to_pylist()], pa.float64()), "g": batch.column(1)})

    told = sample.where(held_out).mapInArrow(mean_weights, "m double, g int").toPandas()
    return weights, *_calibrated(told["m"].to_numpy(float), told["g"].to_numpy(float), prior)


def _calibrated(x: np.ndarray, good: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the log odds over held-out rows, by Newton's method; drawn to SLOPE and the prior where rows are few."""
    at = np.array([SLOPE, prior])
    if not 0 < good.sum() < len(good):
        return SLOPE, prior
    design, least = np.stack((x, np.ones(len(x))), 1), np.array([1 / SLOPE**2, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(least), design.T @ (good - p) - least * (at - (SLOPE, prior)))
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(at[0], 0.0)), float(at[1])


def _mean_weight(weights: np.ndarray, text: str | None) -> float:
    f = _features(text)
    return float(weights[f].mean()) if len(f) else 0.0


def _log_odds(weights: np.ndarray, slope: float, text: str | None) -> float:
    return float(np.clip(slope * _mean_weight(weights, text), -12, 12))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, good, n, h_good, h_n, s_host, s_path, mean) from (host, path, p): sums of p, and by how many pseudo-documents they shrink.

    p is the label where it is known, else the classifier's. ``shrunken`` makes rates of these.
    """
    path = scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n"))
    host = path.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("n").alias("h_n"))
    told = host.agg(F.sum("h_good").alias("g"), F.sum("h_n").alias("n"), F.sum(F.pow("h_good", F.lit(2)) / F.col("h_n")).alias("s"), F.count("*").alias("k")).head()
    mean = (told["g"] / told["n"]) if told["n"] else 0.5

    def strength(between: float, groups: int, n: float) -> float:
        """Pseudo-documents, by moments: a small spread between groups beyond chance means strong shrinkage."""
        spread = max(between / max(n, 1) - mean * mean, 0.0) - mean * (1 - mean) * groups / max(n, 1)
        return float(np.clip(mean * (1 - mean) / max(spread, 1e-4) - 1, 2, 1000))

    s_host = strength(told["s"] or 0.0, told["k"] or 0, told["n"] or 0)
    inner = path.agg(F.sum(F.pow("good", F.lit(2)) / F.col("n")).alias("s"), F.count("*").alias("k")).head()
    s_path = strength(inner["s"] or 0.0, inner["k"] or 0, told["n"] or 0)
    same = F.coalesce(F.concat(F.lit("s"), F.col("host")), F.lit("n"))
    joined = path.withColumn("hk", same).join(host.select(same.alias("hk"), "h_good", "h_n"), "hk")
    return joined.select("host", "path", "good", "n", "h_good", "h_n", F.lit(s_host).alias("s_host"), F.lit(s_path).alias("s_path"), F.lit(mean).alias("mean"))


def shrunken(own: Column | None = None) -> tuple[Column, Column]:
    """(host_rate, path_rate) of a row of ``site_posteriors``; without the document that has ``own`` for p."""
    less, one = (F.lit(0.0), 0) if own is None else (own, 1)
    host = (F.col("h_good") - less + F.col("s_host") * F.col("mean")) / (F.col("h_n") - one + F.col("s_host"))
    return host, (F.col("good") - less + F.col("s_path") * host) / (F.col("n") - one + F.col("s_path"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def classify_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", ident: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, host, path, doc_log_odds, host_rate, path_rate, quality, keep) for each row of ``docs``."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), host.alias("host"), path.alias("path"))
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(ident).alias("doc_id")).agg(F.max(label).alias("good"))
    weights, slope, offset = fit_classifier(rows.join(known, "doc_id").where("text is not null"), "text", "good")
    shared = docs.sparkSession.sparkContext.broadcast((weights, slope))

    @F.pandas_udf("double")
    def odds(texts):  # noqa: ANN001
        import pandas as pd

        return pd.Series([_log_odds(*shared.value, t) for t in texts.tolist()])

    scored = materialize(rows.withColumn("doc_log_odds", odds("text") + F.lit(offset)).select("doc_id", "host", "path", "doc_log_odds").join(known, "doc_id", "left"), "quality")
    scored = scored.withColumn("p", F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-F.col("doc_log_odds"))))).drop("good")
    key = F.concat_ws("/", *[F.coalesce(F.concat(F.lit("s"), F.hex(c)), F.lit("n")) for c in ("host", "path")])
    sites = materialize(site_posteriors(scored.select("host", "path", "p")).withColumn("site", key).drop("host", "path"), "sites")
    joined = skew_join(scored.withColumn("site", key), sites.withColumn("size", F.col("n")), "site", "size")
    host_rate, path_rate = shrunken(F.col("p"))
    joined = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    quality = 1 / (1 + F.exp(-(F.col("doc_log_odds") + _logit(F.col("path_rate")) - _logit(F.col("mean")))))
    return joined.select("doc_id", "host", "path", "doc_log_odds", "host_rate", "path_rate", quality.alias("quality")).withColumn("keep", F.col("quality") >= KEEP)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have a source for a host, and sections of it by language for paths."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
