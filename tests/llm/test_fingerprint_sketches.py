"""Sketches are peeled to what differs, at every size; odd rows through the whole operator."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import common, fingerprints


def _likeness(a, b):
    sets = [{p.rstrip(" ") for p in re.findall(fingerprints.PARAGRAPH, t)} for t in (a, b)]
    both, d = len(sets[0]) + len(sets[1]), len(sets[0] ^ sets[1])
    return 1.0 if not both else (both - d) / (both + d)


def test_peeled_digests_are_what_differs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        keys = rng.integers(-(1 << 62), 1 << 62, 80).tolist()
        cut = int(rng.integers(0, 12))
        rows.append((i, keys[cut:60], keys[: 60 - cut] + keys[60 : 60 + cut]))
    df = spark.createDataFrame(rows, "i long, a array<bigint>, b array<bigint>")
    got = df.select("i", fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a"), 32), fingerprints.sketch(F.col("b"), 32)), 32).alias("d")).collect()
    assert sum(r.d is None for r in got) <= 1
    assert all(r.d is None or sorted(r.d) == sorted(set(rows[r.i][1]) ^ set(rows[r.i][2])) for r in got)


def test_blocks_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i, n in enumerate((0, 1, 3, 130, 700, 5_000)):
        keys = rng.integers(-(1 << 62), 1 << 62, 3 * n).tolist()
        rows.append((i, sorted(keys[: 2 * n]), sorted(keys[n:])))
    df = spark.createDataFrame(rows, "id long, a array<bigint>, b array<bigint>")
    got = {r.id: r.d for r in fingerprints.block_differences(df).collect()}
    assert got == {i: len(set(a) ^ set(b)) for i, a, b in rows if a or b}


def test_texts_of_many_lines(spark):
    texts = ["\n".join(f"line {j} of {i % 2}" for j in range(40_000)) + f"\nown {i}" for i in range(3)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert math.isclose(got[i].near_edited, _likeness(t, edited)) and math.isclose(got[i].near_next, _likeness(t, after))


def test_null_and_repeated_ids(spark):
    rows = [(None, "alpha\nbeta", 1), (None, "gamma", 1), (7, "same\ntext", 1), (7, "same\ntext", 1), (7, "other", 1), (3, None, 1), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digests long")
    got = fingerprints.fingerprint_pairs(df).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert all(len(v) == 1 for k, v in prints.items() if k in (0, 9))
    by = {r.doc_id: r for r in got if r.doc_id in (2, 3)}
    assert by[3].near_next == 1.0 and by[3].fingerprint == by[2].fingerprint
    chain = fingerprints.with_next(df).collect()
    assert sorted(r.text for r in chain) == sorted(r.next_text for r in chain)  # a ring
    alone = fingerprints.with_next(df.where("doc_id is null")).collect()
    assert {r.text: r.next_text for r in alone} == {"alpha\nbeta": "gamma", "gamma": "alpha\nbeta"}
    assert fingerprints.with_next(df.where("doc_id = 3")).head().next_text == ""
    assert fingerprints.fingerprint_pairs(df.where("doc_id < 0")).count() == 0


def test_next_over_many_buckets(spark):
    ids = np.unique(np.random.default_rng(8).integers(0, 1 << 40, 12_000)).tolist()
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df).select("doc_id", "next_text").collect()}
    assert got == {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}
    cuts = ids[::7]
    value = df.select("doc_id", common.cuts_below(cuts, F.col("doc_id")).alias("n")).collect()
    assert all(r.n == sum(c < r.doc_id for c in cuts) for r in value[:300])
