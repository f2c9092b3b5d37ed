"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / quality with u a hash of its id in (0, 1);
sorted by key within its source, sizes are prefix-summed to the budget. A
source whose target is e times its size and a rest takes e complete epochs
first; the rest is a fractional selection: the documents whose middle lies
within it.

Prefix sums are taken in two steps, so that a source with most of the rows is
no single task: keys fall into global quantile buckets, sums of (source,
bucket) give each bucket's offset, and a window runs within (source, bucket).

Defined results: null text has size 0; null is a source of its own, the last
one. Documents of size 0 are never taken (taken 0). Equal keys and repeated
rows are ordered by id, then text; each row counts. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cuts_below, materialize, table, word_count

#: Fixed value: weights of sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
LEAST_QUALITY = 1e-3
#: Rows of a window task, about; keys are cut at MOST_BUCKETS quantiles at most.
ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 4_096


def text_quality(text: Column) -> Column:
    """Between 0.25 and 1, where no quality is known: less for texts with many symbols for their length."""
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'()-]"))
    return F.coalesce(F.greatest(F.lit(0.25), 1 - 5 * odd / F.greatest(F.length(text), F.lit(1))), F.lit(0.25))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with weight and target: the sum of all sizes shared by weight, no target above ``most`` times its source's size.

    The excess of capped sources is shared again by weight. With sources sorted by cap / weight the capped ones
    come first, so running sums find the level at which no further one is above its cap. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    level = (
        ranked.withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") <= F.col("ratio"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    )
    return level.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, seed: int = 7, quality: Column | None = None) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken, epochs for every row of ``docs``.

    ``quality`` is a positive weight of each row, such as the probability that ``classify_quality`` gives; a document
    of twice the weight is as likely to be taken first as two others. Null, zero, NaN or less count as LEAST_QUALITY. Without it
    ``text_quality`` is the weight.
    """
    given = text_quality(F.col(text)) if quality is None else F.when(quality.isNull() | F.isnan(quality), LEAST_QUALITY).otherwise(F.greatest(quality, F.lit(LEAST_QUALITY)))
    hashed = F.xxhash64(F.col(ident).cast("string"), F.lit(seed))
    u = (F.pmod(hashed, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = materialize(
        docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_hash"), (-F.log(u) / given).alias("key")),
        "mix",
    )
    n = rows.count()
    buckets = max(8, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    cuts = rows.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 50_000)).head()[0] or []
    cuts = sorted(set(cuts))
    bucket = cuts_below(cuts, F.col("key")) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    same = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # so that null is a key like others
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    offsets = sums.select(same.alias("s"), "bucket", F.coalesce(F.sum("bucket_size").over(Window.partitionBy(same).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets.select(same.alias("s"), "source_size", "target"), "s")
    within = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("s", same).join(offsets, ["s", "bucket"]).withColumn("upto", F.col("offset") + F.sum("size").over(within))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    chosen = (F.col("full") < MOST_EPOCHS) & (F.col("size") > 0) & (F.col("upto") - F.col("size") / 2 <= rest)
    return placed.withColumn("full", full).withColumn("epochs", F.when(F.col("size") > 0, F.col("full") + chosen.cast("int")).otherwise(0).cast("int")).select(
        "doc_id", "source", "text_hash", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("epochs") * F.col("size")).cast("long").alias("taken"), "epochs"
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES: dict[str, str] = {}
