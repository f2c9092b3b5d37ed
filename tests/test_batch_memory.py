"""Python workers hold a small part of their input at once, and packages of one size cost the same at any count."""

import tracemalloc

import pyarrow as pa

from paperloom.plans import catalogue, files, records  # noqa: F401
from paperloom.sources import delimited


def test_delimited_slices():
    texts = ['user,"it said ""so"" and went"\r\nx,"y"' * 20, None, "", "a,b"] * 5_000
    tracemalloc.start()
    try:
        got = delimited.parse_texts(pa.array(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(texts) and peak < 60_000_000
    assert got.slice(len(texts) - 4).to_pylist() == delimited.parse_texts(pa.array(texts[:4])).to_pylist() and got[1].as_py() is None


def test_queries_bound_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    catalogue.QUERIES["word_text"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == catalogue.BATCH_ROWS
