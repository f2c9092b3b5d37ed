"""Toxicity: held-out accuracy on given tables and on made ones, copies, odd rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from paperloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def auc(y, s):
    y, r = y.to_numpy(), s.rank().to_numpy()
    return (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_rows_of_the_given_table(spark):
    got = toxicity.op13_toxicity(spark, SF).toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all() and len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    met = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    unseen = met[met["held_out"]]
    assert auc(unseen["toxic"], unseen["score"]) > 0.9
    caught = unseen[unseen["predicted"] == 1]
    assert caught["toxic"].mean() > 0.65 and caught["toxic"].sum() > 0.75 * unseen["toxic"].sum()


def made(n, seed):
    r = random.Random(seed)
    syllables = ["ba", "ko", "li", "ne", "su", "ra", "mi", "to", "ve", "da"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(20, 200))], int(i % 8 == 0)
        if toxic:
            for _ in range(2 + len(words) // 40):
                words[r.randrange(len(words))] = r.choice(["grumph", "snorkle", "blightix", "wretchy"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_labels_are_learnt_from_others_only_and_copies_do_not_mislead(spark):
    rows, labels = made(1_600, 3)
    # A passage that many toxic documents share says nothing about its words.
    passage = " zebra quagga okapi tapir bongo kudu eland gnu oryx"
    rows = [(i, t + passage if y and i % 3 == 0 else t) for (i, t), (_, y) in zip(rows, labels)] + [(5_000, "basura nevelida" + passage)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model).toPandas()
    met = got.merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]), on="doc_id")
    assert auc(met["toxic"], met["score"]) > 0.97
    assert got.set_index("doc_id")["score"][5_000] < 0.3
    flipped = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_toxicity(docs, flipped)
    assert (again.toxic, again.ordinary, again.weights) == (model.toxic, model.ordinary, model.weights)


def test_odd_rows_and_tables(spark, tmp_path):
    rows, labels = made(600, 4)
    odd = [(None, "grumph snorkle " * 30, "x"), (9_001, None, "x"), (9_002, "", "x"), (9_003, "!?", "x"), (9_004, "a" * 200_000, "x"), (9_005, "grumph wretchy bako " * 40, "x"), (9_005, "grumph wretchy bako " * 40, "x"), (9_006, "한글 \U0001f600", "x")]
    docs = spark.createDataFrame([*((*r, "x") for r in rows), *odd], "doc_id long, text string, score string")
    marked = spark.createDataFrame([*labels, (None, 1), (9_001, 1), (9_002, None), (777_777, 1), (3, 5)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    marked.write.parquet(f"{tmp_path}/a/labels.parquet")
    got = toxicity.op13_toxicity(spark, f"{tmp_path}/a").collect()
    assert len(got) == 608 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[9_001] == score[9_002] == score[9_003] and not next(r for r in got if r.doc_id is None).held_out
    assert [r.score for r in got if r.doc_id == 9_005] == [score[9_005]] * 2 and score[9_005] >= 0.3 > score[9_004]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    marked.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert toxicity.op13_toxicity(spark, f"{tmp_path}/none").collect() == []
    docs.write.parquet(f"{tmp_path}/unmarked/documents.parquet")
    marked.where("toxic = 0").write.parquet(f"{tmp_path}/unmarked/labels.parquet")
    assert {r.score for r in toxicity.op13_toxicity(spark, f"{tmp_path}/unmarked").collect()} == {0.0}
