"""Documents without an id, and different ones that share one, stay."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = {k: " ".join(f"{k}word{i}" for i in range(40)) for k in "abcdef"}


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_near_copies_by_row(spark):
    rows = [(None, TEXT["a"]), (None, TEXT["b"]), (1, TEXT["c"]), (2, TEXT["c"]), (2, TEXT["d"]), (3, TEXT["e"]), (3, TEXT["e"]), (None, TEXT["f"]), (4, TEXT["f"])]
    got = corpus_pipeline.drop_near_copies(spark, _docs(spark, rows), "").collect()
    want = [(None, TEXT["a"]), (None, TEXT["b"]), (1, TEXT["c"]), (2, TEXT["d"]), (3, TEXT["e"]), (4, TEXT["f"])]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_mix_by_row(spark):
    docs = _docs(spark, [(None, TEXT["a"]), (None, TEXT["b"]), (1, TEXT["c"]), (1, TEXT["d"]), (2, TEXT["e"]), (2, TEXT["e"])])
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id, r.text_hash] += r.epochs
    got = corpus_pipeline.mix(spark, docs, "").selectExpr("doc_id", "xxhash64(text) as text_hash").collect()
    assert sum(want.values()) and Counter((r.doc_id, r.text_hash) for r in got) == +want


def test_rows_of_one_key_get_another(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "c"), (3, None)], "key long, text string")
    got = corpus_pipeline._distinct_keys(rows, F.xxhash64(F.lit(1), "text")).collect()
    keys = {(r.text, r.key) for r in got}
    assert len(got) == 6 and len(keys) == 4 == len({k for _, k in keys}) and {("c", 2), (None, 3)} <= keys
