"""Vector codes by member-resident Lloyd: parts of vectors live with the codebook entry that they belong to.

A vector's components become integers and are cut into parts, and a table holds
the parts (equal ones of a batch as one row with a weight), partitioned by
position, entry and salt: the residents of an owner are in one file. An owner
updates its entry from its residents, a sum that needs no shuffle of parts, only
of one row a task and owner. Then residents look for the nearest of the new entries: those that keep
theirs are written where they are, and only those that change it go through a
shuffle to the files of their new owner. Salts split an entry with many members.
At the end each vector is coded where it is, with the final codebooks: a scan.
The driver holds the codebooks only.

Defined results: rows whose vector is null, or holds null or non-finite
components, take no part. Vectors of another length than most (of equally
frequent lengths the greatest), or whose length is no multiple of the number of
parts, stay with a null code and error. Ids that are null come last among the
starts; rows that share an id go by their components, and repeated rows count
each. Fewer rows than entries give as many entries. Integers end at +-2^61,
differences where a part's distance would not fit a long, and sums of distances
at the largest long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.centroids import MOST_LONG, finite, integers
from paperloom.llm.common import delete_table, materialize, skew_join, table, write_table

#: Parts of one position that share a salt, about, if one entry had all of them.
RESIDENTS = 500_000
MEMBERS = "position int, entry int, salt int, weight long, part array<long>, moved boolean"


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry nearest to each row of ``parts``, the lower index among equal ones.

    Differences end where a sum of their squares would no longer fit a long.
    """
    longest = isqrt(MOST_LONG // entries.shape[1])
    d = np.stack([(np.clip(parts - e, -longest, longest) ** 2).sum(1) for e in entries], 1) if len(parts) else np.zeros((0, len(entries)), np.int64)
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _members(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, weight: np.ndarray, part: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), pa.array(weight, pa.int64()), _lists(part), pa.array(moved, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["position", "entry", "salt", "weight", "part", "moved"])


def _settle(vectors: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Parts of ``vectors`` (v) with their first entry, equal parts of a batch as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            v = _rows(batch.column(0), books.shape[0] * books.shape[2]).reshape(-1, books.shape[0], books.shape[2])
            for p in range(books.shape[0]):
                part, weight = np.unique(v[:, p], axis=0, return_counts=True)
                entry, _ = nearest(part, books[p])
                n = len(part)
                yield _members(np.full(n, p), entry, (at + np.arange(n)) % salts, weight, part, np.ones(n, bool))
            at += len(v)

    return vectors.mapInArrow(run, MEMBERS)


def _look(members: DataFrame, books: np.ndarray) -> DataFrame:
    """``members`` with their nearest entry, and whether it is a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, old, salt, weight = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            part = _rows(batch.column(4), books.shape[2])
            entry = old.copy()
            for p in np.unique(position):
                own = position == p
                entry[own], _ = nearest(part[own], books[p])
            yield _members(position, entry, salt, weight, part, entry != old)

    return members.select("position", "entry", "salt", "weight", "part").mapInArrow(run, MEMBERS)


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks by their residents' means: every task adds up what it holds of each entry, in halves that can't overflow."""
    size = books.shape[2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * books.shape[1] + batch.column(1).to_numpy()
            weight, part = batch.column(2).to_numpy().astype(np.int64), _rows(batch.column(3), size)
            found, place = np.unique(key, return_inverse=True)
            sums = np.zeros((len(found), 2 * size + 1), np.int64)
            np.add.at(sums, place, np.concatenate((weight[:, None], (part >> 32) * weight[:, None], (part & 0xFFFFFFFF) * weight[:, None]), 1))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[pa.array(sums[:, i]) for i in range(2 * size + 1)]], names=["key", *[f"s{i}" for i in range(2 * size + 1)]])

    names = [f"s{i}" for i in range(2 * size + 1)]
    held = members.select("position", "entry", "weight", "part").mapInArrow(add, "key long, " + ", ".join(f"{n} long" for n in names))
    out = books.copy()
    for row in held.groupBy("key").agg(*[F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names]).collect():  # a row an entry
        n = int(row["s0"])
        out[row["key"] // books.shape[1], row["key"] % books.shape[1]] = [((int(row[f"s{1 + i}"]) << 32) + int(row[f"s{1 + size + i}"])) // n for i in range(size)]
    return out


def _homes(rows: DataFrame, label: str) -> tuple[str, DataFrame]:
    """A table of members, those that moved apart from those that stayed, a file for the owners of a task: its path and its rows."""
    path = write_table(rows, label, "moved")
    return path, rows.sparkSession.read.schema(MEMBERS).parquet(path)


def fit_codebooks(vectors: DataFrame, n: int, start: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Codebooks (position, entry, component) after ``rounds`` of Lloyd's method over ``n`` ``vectors`` (v), from ``start``."""
    salts = max(1, -(-n // RESIDENTS))
    dealt = lambda rows: rows.repartition("position", "entry", "salt")
    path, members = _homes(dealt(_settle(vectors, start, salts)), "residents")
    paths, books = [path], start
    for left in reversed(range(rounds)):
        books = _updated(members, books)
        if left:
            # Who stays is written by the task that has read it; who moves is all that the shuffle gets.
            looked, told = _homes(_look(members, books), "looked")
            arrived, new = _homes(dealt(told.where("moved")), "residents")
            members = told.where("not moved").unionByName(new)
            for path in paths:
                delete_table(vectors.sparkSession, path)
            paths = [looked, arrived]
    for path in paths:
        delete_table(vectors.sparkSession, path)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (v, of integers) with a code and an error; null for vectors of another length than the codebooks'."""
    parts, _, size = books.shape
    schema = rows.drop("v").withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")).schema
    for name in ("code", "error"):
        schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            fits = np.array([len(x) == parts * size for x in column], bool)
            v = _rows(column.filter(pa.array(fits)), parts * size).reshape(-1, parts, size)
            found = [nearest(v[:, p], books[p]) for p in range(parts)]
            codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
            if len(v):
                codes[fits] = [bytes(c).hex() for c in np.stack([f[0] for f in found], 1).astype(np.uint8)]
                errors[fits] = [min(sum(e), MOST_LONG) for e in zip(*(f[1].tolist() for f in found))]
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "v"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], names=[*[n for n, _ in kept], "code", "error"])

    return rows.mapInArrow(run, schema)


def compress_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", *, parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """(ident, label, code, error) of each vector of finite components, and the codebooks.

    The start of each codebook is the parts of the ``entries`` (256 at most) smallest ids.
    """
    kept = vectors.where(finite(F.col(vector))).select(F.col(ident).alias("ident"), F.col(label).alias("label"), integers(F.col(vector), scale).alias("v"))
    length = kept.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).where(F.col("length") > 0).orderBy(F.desc("n"), F.desc("length")).head()
    named = lambda rows: rows.select(F.col("ident").alias(ident), F.col("label").alias(label), "code", "error")
    if length is None or length["length"] % parts:
        return named(kept.withColumn("code", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("long"))), np.zeros((parts, 0, 0), np.int64)
    whole = kept.where(F.size("v") == length["length"])
    first = whole.orderBy(F.col("ident").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = fit_codebooks(whole.select("v"), length["n"], start, rounds)
    return named(encode(kept, books)), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    found = materialize(found.withColumn("same", F.to_json(F.struct("label"))), "codes")
    sums = found.groupBy("same").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("sum"), F.count("*").alias("size"))
    sums = sums.select("same", F.when(F.col("sum") > MOST_LONG, MOST_LONG).otherwise(F.col("sum")).cast("long").alias("label_error"), "size")
    joined = skew_join(found, materialize(sums, "labels"), "same", "size")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> str:
    """The same for DuckDB, for vectors of one length, a step of the rounds after the other."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"part AS MATERIALIZED (SELECT row, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w FROM kept, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, e, w AS c FROM part JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {entries}) USING (row))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, p, any_value(w) AS w, min((d, e)) AS near FROM (SELECT row, p, e, w, list_sum([(w[i] - c[i]) * (w[i] - c[i]) for i in range(1, len(w) + 1)])::HUGEINT AS d FROM part JOIN c{r} USING (p)) GROUP BY row, p)")
        if r < rounds:
            sums = f"SELECT p, e, list(floored ORDER BY i) AS c FROM (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS floored FROM (SELECT p, near[2] AS e, i, sum(w[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, len(w) + 1) t(i) GROUP BY ALL)) GROUP BY p, e"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(u.c, o.c) AS c FROM c{r} o LEFT JOIN ({sums}) u ON u.p = o.p AND u.e = o.e)")
    steps.append(f"coded AS (SELECT row, string_agg(printf('%02x', near[2]::INT), '' ORDER BY p) AS code, sum(near[1])::BIGINT AS error FROM a{rounds} GROUP BY row)")
    digest = f"SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}"
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), ({digest})"


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _sql()}
