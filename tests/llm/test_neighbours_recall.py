"""Recall on vectors without clusters, of a table that the first blocks cover a small part of."""

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import neighbours


def test_recall_of_uniform_vectors(spark):
    n = 8_000
    x = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = {}
    for r in neighbours.nearest(rows, "vec_id", "embedding", F.pmod(F.col("vec_id"), F.lit(100)) == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, n, 100))
