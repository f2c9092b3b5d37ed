"""op11 and op12 against brute force in Python's own integers, on given and on odd tables; their SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from paperloom.llm import centroids, vector_codes

SF = "/root/testdata/sf0.001"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(entries))


def lloyd(points, start, rounds):
    entries = [list(e) for e in start]
    for _ in range(rounds):
        own = [[] for _ in entries]
        for v in points:
            own[nearest(v, entries)[1]].append(v)
        entries = [[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, entries)]
    return entries


def brute_codes(rows, parts=8, entries=16):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if usable(v)]
    size = len(kept[0][2]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [lloyd([cut(v, p) for _, _, v in kept], [cut(v, p) for _, _, v in start], 6) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def brute_clusters(rows, k=40):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if usable(v) and len(v) == 64]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    found = lloyd([v for _, v in kept], [v for _, v in hashed[:k]], 5)
    near = [(i, *nearest(v, found)) for i, v in kept]
    own = {}
    for _, d, c in near:
        own[c] = own.get(c, 0) + d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return sorted(((i, c, d, own[c], sum(own.values()), hashes[c]) for i, d, c in near), key=str)


def odd_rows(kind):
    r = random.Random(kind)
    scale, shift = {"plain": (1, 0), "shifted": (1, 3000.0), "large": (6_000, 0), "far": (1, 1e6)}[kind]
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(r.gauss(0, 1) * scale + shift) for _ in range(64)], r.choice([0, 1, None])) for i in range(120)]
    rows += [(200 + i, rows[3][1], 7) for i in range(60)]  # a hot vector
    rows += [rows[5]] * 3 + [(5, rows[9][1], 1), (None, rows[11][1], None), (None, rows[12][1], 2)]
    return rows + [(300, None, 1), (301, [None] * 64, 1), (302, [float("nan")] + [0.0] * 63, 1), (303, [float("inf")] + [0.0] * 63, None)]


def frame(spark, rows):
    made = spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, cluster int, code int, ident string")
    return made.repartition(5)


@pytest.mark.parametrize("kind", ["plain", "shifted", "large", "far"])
def test_codes(spark, tmp_path, kind):
    rows = odd_rows(kind)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_codes(rows)


@pytest.mark.parametrize("kind", ["plain", "shifted", "large", "far"])
def test_clusters(spark, tmp_path, kind):
    rows = odd_rows(kind) + [(400, [1.0] * 63, 1), (401, [], 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in centroids.op12_centroids(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_clusters(rows)


def test_vectors_of_other_lengths_have_no_code(spark, tmp_path):
    rows = odd_rows("plain")
    frame(spark, [*rows, (400, [1.0] * 63, 5), (401, [], 5), (402, [1.0] * 72, 1)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()}
    want = brute_codes(rows)
    digest = want[0][4]
    assert {r for r in got if r[1] is not None} == set(want)
    total = next(r[3] for r in got if r[0] == 402)
    assert {r for r in got if r[1] is None} == {(400, None, None, None, digest), (401, None, None, None, digest), (402, None, None, total, digest)}


def test_few_and_no_rows(spark, tmp_path):
    rows = odd_rows("plain")[:3]
    frame(spark, rows).write.parquet(f"{tmp_path}/few/embeddings.parquet")
    assert sorted((tuple(r) for r in vector_codes.op11_vector_codes(spark, f"{tmp_path}/few").collect()), key=str) == brute_codes(rows)
    assert sorted((tuple(r) for r in centroids.op12_centroids(spark, f"{tmp_path}/few").collect()), key=str) == brute_clusters(rows)
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, f"{tmp_path}/none").collect() == [] == centroids.op12_centroids(spark, f"{tmp_path}/none").collect()


def test_values_beyond_a_long_end_without_failing(spark, tmp_path):
    rows = [(i, [(-1.0) ** i * 3e38] * 64, 1) for i in range(50)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, str(tmp_path)).count() == 50 == centroids.op12_centroids(spark, str(tmp_path)).count()


@pytest.mark.parametrize("module, name", [(vector_codes, "op11_vector_codes"), (centroids, "op12_centroids")])
def test_sql(spark, module, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = module.QUERIES[name](spark, SF)
    want = duck.execute(module.ORACLES[name])
    assert [d[0] for d in want.description] == found.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)
