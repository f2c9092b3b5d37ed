"""Near copies of 14 to 60 shingles close to the threshold, against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import jaccard_join


def _groups(rng, groups):
    texts = []
    for g in range(groups):
        n = int(rng.integers(14, 61))
        base = [f"g{g}w{i}" for i in range(n + 4)]
        for k in range(int(rng.integers(5, 12))):
            a, b = (int(x) for x in rng.integers(0, max(2, n // 6), 2))
            w = base[a : len(base) - b] + [f"g{g}k{k}e{i}" for i in range(int(rng.integers(0, max(2, n // 8))))]
            if rng.random() < 0.5:
                w[int(rng.integers(0, len(w)))] = f"g{g}k{k}x"
            texts.append((g, w))
    return texts


def _components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        j = i - 1
        while j >= 0 and texts[j][0] == texts[i][0]:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
            j -= 1
    return {i: find(i) for i in range(len(sets))}


def test_near_the_threshold(spark):
    texts = _groups(np.random.default_rng(11), 3000)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(rows).collect()}
    want = _components(texts)
    assert sum(got[i] != want[i] for i in want) == 0


def test_bound_holds_between(spark):
    rows = spark.range(1, 121).select(F.col("id").alias("n")).crossJoin(spark.range(1, 161).select(F.col("id").alias("m"))).where("100 * least(n, m) >= 75 * greatest(n, m)")
    exact = {(r.n, r.m): r.e for r in rows.select("n", "m", jaccard_join._least_shared(F.col("n"), F.col("m")).alias("e")).collect()}
    bound = jaccard_join._least_shared_between(F.col("n"), F.col("m"), F.col("high")).alias("b")
    for r in rows.withColumn("high", F.explode(F.sequence("m", F.floor(F.col("n") * 4 / 3)))).select("n", "m", "high", bound).collect():
        assert r.b <= min(exact[r.n, m] for m in range(r.m, r.high + 1)) and r.high <= math.floor(r.n * 4 / 3)


def test_hot_keys_null_ids_and_shared_hashes(spark, monkeypatch):
    """The same components when keys count as hot, when sets share a half of their hash, and for rows without an id."""
    from paperloom.llm import common

    texts = _groups(np.random.default_rng(3), 60)
    rows = [(i if i % 9 else None, " ".join(w)) for i, (_, w) in enumerate(texts)]
    rows += [(1000 + i, " ".join(texts[0][1])) for i in range(50)] + [(2000 + i, t) for i, t in enumerate([None, "", " \t"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def groups():
        got = jaccard_join.near_duplicates(df).collect()
        assert len(got) == len(rows) and all(r.component_id == r.doc_id for r in got if not r.n_shingles)
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in got)

    want = groups()
    ids = {i: r[0] for i, r in enumerate(rows)}
    brute = _components(texts)
    members = {}
    for i, root in brute.items():
        members.setdefault(root, []).append(i)
    least = {i: min((ids[j] for j in members[root] if ids[j] is not None), default=None) for i, root in brute.items()}
    assert {r[1]: r[3] for r in want if not r[0] and r[1] < 1000} == {ids[i]: least[i] for i in brute if ids[i] is not None}
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert groups() == want
    monkeypatch.setattr(jaccard_join, "_shared_hashes", lambda told: frozenset(r.c for r in told.where("kind = 0 and pmod(c, 3) = 0").select("c").distinct().collect()))
    assert groups() == want
