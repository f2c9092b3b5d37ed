"""Centroid clustering in Spark's own expressions: k-means over integer vectors.

Components become integers, so that sums and distances are exact and no result
depends on the order in which rows are added. A vector's distances to all
centroids are one expression, ``zip_with`` and ``aggregate`` over the literal
centroids, and ``array_min`` of (distance, number) chooses the cluster. A round
is one scan with a map-side sum of each column by cluster: a task sends at most
one row a cluster, so neither a hot vector nor a hot cluster loads one task. The
driver holds the centroids only (``k`` times ``dim`` numbers).

Defined results: rows whose vector is null, of another length, or holds null or
non-finite components take no part. Rows without an id can't be a start; they
get a cluster as all others do. Rows that share an id or a vector count each;
starts with equal hashes go by their components. Fewer rows than ``k`` give as
many centroids, none an empty result. Integers end at +-2^61, differences at
+-2^28 in a distance, and sums of distances at the largest long: only vectors
for which a long could not hold the distance are affected. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, table

#: Integers end here.
LARGEST = 1 << 61
MOST_LONG = (1 << 63) - 1


def longest(dim: int) -> int:
    """Differences of two integers end here: ``dim`` squares of it still fit a long."""
    return isqrt(MOST_LONG // dim)


def integers(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))


def finite(v: Column) -> Column:
    """All components are numbers."""
    return F.coalesce(F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def literal(centroids: list[list[int]]) -> Column:
    """An array of arrays, written as SQL: a call for each number would take seconds a round."""
    return F.expr("array(" + ",".join("array(" + ",".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")


def nearest(v: Column, centroids: list[list[int]], wide: bool) -> Column:
    """(distance, cluster) of the nearest centroid, the smaller number among equal ones. ``wide``: differences may need an end."""
    end = longest(len(centroids[0]))

    def square(a: Column, b: Column) -> Column:
        gap = F.greatest(F.least(a - b, F.lit(end)), F.lit(-end)) if wide else a - b
        return gap * gap

    def one(c: Column, i: Column) -> Column:
        return F.struct(F.aggregate(F.zip_with(v, c, square), F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"), i.cast("int").alias("cluster"))

    return F.array_min(F.transform(literal(centroids), one))


def updated(points: DataFrame, centroids: list[list[int]], wide: bool) -> list[list[int]]:
    """The centroids after a round over ``points`` (v)."""
    dim = len(centroids[0])
    own = points.select(nearest(F.col("v"), centroids, wide)["cluster"].alias("cluster"), "v")
    kind = "decimal(20,0)" if wide else "long"
    sums = own.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(dim)]).collect()  # a row a cluster
    out = list(centroids)
    for row in sums:
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
    return out


def cluster_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", *, k: int = 40, dim: int = 64, scale: int = 256, rounds: int = 5, salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of each vector with ``dim`` finite components, and the centroids.

    The start is the ``k`` vectors with the smallest SHA-256 of ``salt`` and id.
    """
    kept = vectors.where(finite(F.col(vector)) & (F.size(vector) == dim)).select(F.col(ident).alias("id"), integers(F.col(vector), scale).alias("v"))
    hashed = kept.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    centroids = [list(r["v"]) for r in hashed.orderBy("h", "v").select("v").limit(k).collect()]
    if not centroids:
        return kept.select(F.col("id").alias(ident), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), []
    size = kept.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("top")).head()
    wide = 2 * size["top"] > longest(dim) or size["top"] * size["n"] > MOST_LONG
    for _ in range(rounds):
        centroids = updated(kept.select("v"), centroids, wide)
    found = kept.withColumn("near", nearest(F.col("v"), centroids, wide))
    return found.select(F.col("id").alias(ident), "near.cluster", "near.distance"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    if not centroids:
        return found.select("vec_id", "cluster", "distance", F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    found = materialize(found, "clusters")  # read twice below
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a cluster
    own = [min(sums.get(i, 0), MOST_LONG) for i in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(
        "vec_id", "cluster", "distance", F.get(F.lit(own).cast("array<long>"), F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST_LONG)).cast("long").alias("inertia"), F.get(F.lit(hashes), F.col("cluster")).alias("centroid_sha256"),
    )


def _sql(k: int = 40, dim: int = 64, scale: int = 256, rounds: int = 5) -> str:
    """The same for DuckDB, a step of the rounds after the other."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, [floor({scale} * x::DOUBLE)::HUGEINT for x in embedding] AS v FROM embeddings WHERE len(embedding) = {dim} AND len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS w FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        near = "SELECT row_number() OVER () AS row, vec_id, v FROM kept"
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS near FROM (SELECT row, vec_id, v, c, list_sum([(v[i] - w[i]) * (v[i] - w[i]) for i in range(1, {dim + 1})])::HUGEINT AS d FROM ({near}), c{r}) GROUP BY row)")
        if r < rounds:
            sums = f"SELECT c, list(floored ORDER BY i) AS w FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS floored FROM (SELECT near[2] AS c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY ALL)) GROUP BY c"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(u.w, o.w) AS w FROM c{r} o LEFT JOIN ({sums}) u USING (c))")
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, near[2]::INT AS cluster, near[1]::BIGINT AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia,"
        f" (sum(near[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = near[2]"
    )


QUERIES = {"op12_centroids": op12_centroids}
ORACLES = {"op12_centroids": _sql()}
