"""Recall where single precision, an offset, overflow or vanishing squares would lose neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import neighbours

N = 3_000
NORMAL = np.random.default_rng(9).standard_normal((N, 64))
CENTRES = np.random.default_rng(8).standard_normal((40, 64))
CASES = {
    "shifted": NORMAL + 3_000, "large": NORMAL * 1e20, "small": NORMAL * 1e-25, "clusters": CENTRES[np.arange(N) % 40] + NORMAL * 1e-3,
    "far": np.where(np.arange(N)[:, None] % 500 == 499, 1e12, NORMAL), "lattice": np.round(NORMAL[:, :64] * 0.6),
}


@pytest.mark.parametrize("kind", list(CASES))
def test_recall(spark, kind):
    x = CASES[kind].astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = {}
    for r in neighbours.nearest(rows, "vec_id", "embedding", F.pmod(F.col("vec_id"), F.lit(100)) == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide, hits, asked = x.astype(np.float64), 0, range(0, N, 100)
    for q in asked:
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        worst = np.sort(d)[9]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and len({v for _, v, _ in found}) == 10
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in found)
        hits += sum(d[v] <= worst for _, v, _ in found)
    assert hits >= 0.95 * 10 * len(asked)
