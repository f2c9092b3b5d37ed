"""Hundreds of labels are learnt and predicted, and rows without an id are sampled by their texts."""

import random

from pyspark.sql import functions as F

from paperloom.llm import language_id


def _words(k):
    r = random.Random(k)
    letters = r.sample("abcdefghijklmnopqrstuvwxyz", 7)
    return ["".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(60)]


def test_three_hundred_labels(spark):
    vocabulary = {f"l{k:03}": _words(k) for k in range(300)}
    r = random.Random(1)
    said = lambda lang: " ".join(r.choice(vocabulary[lang]) for _ in range(60))
    rows = [(i, said(lang), lang) for i, lang in enumerate(list(vocabulary) * 6)]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    asked = spark.createDataFrame([(lang, said(lang)) for lang in vocabulary], "lang string, text string")
    got = language_id.label_languages(asked, model).select("lang", F.col("language.lang").alias("p")).collect()
    assert sum(x.lang == x.p for x in got) >= 297


def test_rows_without_an_id_are_bounded(spark):
    rows = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    model = language_id.fit_language_model(rows, docs_per_language=100)
    assert model.languages == ["en"] and language_id.label_texts(["some words"], model)[0]["lang"] == "en"
