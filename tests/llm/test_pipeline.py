"""The pipeline against a plain version of its stages."""

import re
from collections import Counter

import corpus_pipeline
from paperloom.llm import bpe, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    a = stage["language_id"](spark, docs, SF)
    assert a.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in a.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    b = stage["jaccard_join"](spark, docs, SF)
    texts = Counter(" ".join(r.text.lower().split()) for r in b.collect())
    assert max(texts.values()) == 1 and b.columns == corpus_pipeline.COLUMNS
    c = {r.doc_id: r.text for r in stage["secret_scan"](spark, docs, SF).collect()}
    assert set(c) == set(rows) and not any(secrets.scanner()(list(c.values()))[i] for i in range(len(c)) if re.search("AKIA", c[list(c)[i]]))
    assert all(c[i] == r.text for i, r in rows.items() if not secrets.scanner()([r.text])[0])
    d = stage["mix_sources"](spark, docs, SF)
    assert max(Counter(r.doc_id for r in d.collect()).values()) <= 3 and d.columns == corpus_pipeline.COLUMNS
    codec = bpe.Codec(bpe.Merger(bpe.load_spec(bpe.tokenizer_path())))
    for r in stage["bpe"](spark, docs.limit(50), SF).collect():
        assert r.ids == codec.encode(rows[r.doc_id].text)[0] and r.n_tokens == len(r.ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 100
