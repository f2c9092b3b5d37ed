"""What a task of the pipeline holds at once is small, whoever reads the documents."""

import tracemalloc

import corpus_pipeline
from paperloom.llm import common, secrets


def test_stages_bound_batches(spark):
    docs = spark.createDataFrame([(1, "token = abcdef123", "en", "a", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        stage(spark, docs, "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == common.BATCH_ROWS, name


def test_scan_memory():
    index = secrets.TrigramIndex([secrets.trigram_query(r) for r in secrets.RULES])
    texts = [b"some words without any of them " * 100] * 1_300
    tracemalloc.start()
    try:
        index.postings(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20_000_000
