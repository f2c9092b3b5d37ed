"""A corpus from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) over all that the stage
before kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.bpe import encode_texts, tokenizer_path
from paperloom.llm.common import bound_batches, delete_table, table, write_table
from paperloom.llm.jaccard_join import near_duplicates
from paperloom.llm.language_id import fit_language_model, held_out, label_languages
from paperloom.llm.mixing import mix_sources
from paperloom.llm.secrets import mask_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # models, tokenizers and hashes; tests hold it against a brute-force version


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Batches are small in a stage that is given its documents, too."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``: null text, or no letter) go; the others get the predicted one."""
    model = fit_language_model(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    labelled = label_languages(docs.select("doc_id", "text", "source", "n_chars"), model)
    return labelled.withColumn("lang", F.col("language.lang")).where("lang <> 'und'").select(COLUMNS)


#: Keys that different rows share: above this the hashes themselves are at fault.
MOST_SHARED = 10_000


def _distinct_keys(rows: DataFrame, other: Column) -> DataFrame:
    """``rows`` with ``other`` as key wherever rows of different ``other`` share a key."""
    seen = rows.select("key", other.alias("other")).groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    shared = [r.key for r in seen.where("low < high").select("key").limit(MOST_SHARED + 1).collect()]
    if len(shared) > MOST_SHARED:
        raise RuntimeError("hashes of rows collide")
    return rows.withColumn("key", F.when(F.col("key").isin(shared), other).otherwise(F.col("key"))) if shared else rows


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, one without an id only if all are.

    Rows are told apart by id and text, so rows that share an id, or have none, stay if their texts are no near copies.
    A row's key has 64 bits; different rows of one key, of which n * n / 2**65 are expected, take a second one.
    """
    of = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    keyed = _distinct_keys(docs.withColumn("key", F.xxhash64(*of)), F.xxhash64(F.lit(1), *of))
    component = near_duplicates(keyed, ident="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key"))
    kept = keyed.select("doc_id", "key").distinct().join(component, "key").groupBy("component_id").agg(first.alias("first")).select("first.key")
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(COLUMNS)


@_stage
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    # Rows that share id, source and text are one here, with the epochs of all.
    taken = mix_sources(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("epochs").cast("int").alias("epochs")).where("epochs > 0").alias("t")
    rows = docs.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "text_hash"]).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "text_hash")]
    found = rows.join(taken, same[0] & same[1] & same[2]).select(*[F.col(f"d.{c}") for c in COLUMNS], "t.epochs")
    return found.withColumn("epoch", F.explode(F.sequence(F.lit(1), "epochs"))).select(COLUMNS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; a null or empty text has none."""
    done = encode_texts(docs, tokenizer_path(), keep=["doc_id", "lang", "source"], decoded=False)
    return done.select("doc_id", "lang", "source", "bpe.n_tokens", "bpe.ids")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("mix_sources", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. A stage's table is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = write_table(stage(spark, docs, sf_dir), name)
        docs = spark.read.parquet(path)
        if before:
            delete_table(spark, before)
        before = path
    return docs
