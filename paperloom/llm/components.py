"""Connected components by alternating large and small stars, as Spark joins.

Each round is two joins of the edges with the smallest neighbour of each node;
no neighbourhood is gathered, and each round is written to the shared folder,
where the round before it is deleted. Nodes of very many neighbours are skewed
keys of these joins, which Spark splits at run time.

Edges with a null end are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import delete_table, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node u to the smaller v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; the component is its smallest node.

    Loops are ignored, repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession

    def written(now: DataFrame, before: str | None) -> tuple[DataFrame, str]:
        path = write_table(now, "cc")
        if before:
            delete_table(spark, before)
        return spark.read.schema(now.schema).parquet(path), path

    now, path = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), None)
    sign = None
    for _ in range(most_rounds):
        now, path = written(_small_star(_large_star(now)), path)
        was, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if sign == was or not sign[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
