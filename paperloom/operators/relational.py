"""Operators on documents, pictures, archives and caches as DataFrame joins, windows and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import round3


def duplicates_of(rows: DataFrame, scope: list[str], fingerprint: Column, order: str, ident: Column) -> DataFrame:
    """``rows`` with duplicate_of: the first id of the same fingerprint in its scope; null for the first itself."""
    first = Window.partitionBy(*scope, fingerprint).orderBy(order)
    return rows.withColumn("duplicate_of", F.when(F.row_number().over(first) > 1, F.first(ident).over(first)))


def content_key(schema: str, variant: Column, md5: Column, file_id: Column, modified: Column) -> Column:
    """What a cached result is known by: the content's hash, else the file's id and time; null without either."""
    return F.when(md5.isNotNull(), F.concat(F.lit(schema), F.lit("|"), variant, F.lit("|md5:"), md5)).when(
        file_id.isNotNull() & modified.isNotNull(), F.concat(F.lit(schema), F.lit("|"), variant, F.lit("|drive:"), file_id, F.lit("@"), modified)
    )


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the cache has, and rows that must be read."""
    keys = cache.select(key)
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def survivors(accesses: DataFrame, key: str, time: Column, most: int) -> DataFrame:
    """The ``most`` keys that were used last."""
    last = accesses.groupBy(key).agg(F.max(time).alias("last_access"))
    return last.orderBy(F.desc("last_access"), key).limit(most)


def roll_up_text(children: DataFrame, group: str, name: Column, text: str, order: str) -> DataFrame:
    """One text a group: its non-empty children under headings, in order."""
    parts = children.where(F.col(text) != "").groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), name.alias("name"), F.col(text).alias("text")))).alias("parts"))
    return parts.select(group, F.array_join(F.transform("parts", lambda p: F.concat(F.lit("## "), p["name"], F.lit("\n\n"), p["text"])), "\n\n").alias("text"), F.size("parts").cast("long").alias("n_children"))


def admitted(entries: Column, most: int) -> Column:
    """How many of an array of sizes are taken while the sum of those taken stays within ``most``."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("taken"))
    fold = lambda s, n: F.when(s["sum"] + n <= most, F.struct((s["sum"] + n).alias("sum"), (s["taken"] + 1).alias("taken"))).otherwise(s)
    return F.aggregate(entries, zero, fold, lambda s: s["taken"])


def runs(rows: DataFrame, group: str, block: str) -> DataFrame:
    """Runs of consecutive block numbers: (group, first, last, blocks)."""
    island = F.col(block) - F.row_number().over(Window.partitionBy(group).orderBy(block))
    return rows.select(group, block).distinct().withColumn("island", island).groupBy(group, "island").agg(F.min(block).alias("first_block"), F.max(block).alias("last_block"), F.count("*").alias("blocks")).drop("island")


def provider_metrics(analyses: DataFrame, by: list[str]) -> DataFrame:
    """Aggregates over analyses (parsed, latency, tokens_in, tokens_out, elements, confidence) by file and provider."""
    return analyses.groupBy(*by).agg(
        F.count("*").alias("n"), round3(F.avg(F.col("parsed").cast("double"))).alias("parse_rate"),
        F.floor(F.sum(F.coalesce("latency", F.lit(0))) / F.count("*") + 0.5).cast("long").alias("avg_latency"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).cast("long").alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).cast("long").alias("tokens_out"),
        round3(F.avg(F.coalesce("elements", F.lit(0)).cast("double"))).alias("avg_elements"), F.count_if(F.col("confidence") == "low").alias("n_low"),
        *([round3(F.avg(F.coalesce("tables", F.lit(0)).cast("double"))).alias("avg_tables")] if "tables" in analyses.columns else []),
    )


def chart_pivot(points: DataFrame, category: str, series: str, value: str, names: list[str]) -> DataFrame:
    """A chart as a table: categories by series."""
    return points.groupBy(category).pivot(series, names).agg(F.sum(value))
