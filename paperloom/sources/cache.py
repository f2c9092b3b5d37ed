"""A cache of results as a table: upserts by key that may be repeated, compaction behind a pointer.

Below the root lie ``runs/run=<id>``, a folder for each upsert, and ``versions/<id>``,
whole tables; the file ``pointer`` names the version that holds and the runs that are in
it. A run that is tried again replaces its own folder, and a pointer is replaced in
one step, so a reader sees a table before or after a change, and two tries of a
run leave one row a key. Rows lie in folders by a hash of their key, so a join by
key and ``bucket`` reads only those that its keys are in.
"""

from __future__ import annotations

import json
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _place(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = root if "://" in root else f"file://{root.removeprefix('file:')}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def _folders(root: str, below: str) -> list[str]:
    system, inner = _place(root)
    found = system.get_file_info(pyarrow.fs.FileSelector(f"{inner}/{below}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory)


def _pointer(root: str) -> dict:
    system, inner = _place(root)
    if system.get_file_info(f"{inner}/pointer").type == pyarrow.fs.FileType.NotFound:
        return {"version": None, "runs": []}
    with system.open_input_stream(f"{inner}/pointer") as f:
        return json.loads(f.read())


def upsert(rows: DataFrame, root: str, run: str, key: str = "key") -> None:
    """Rows of one run, one a key; those without a key are left out. The same run again replaces what it has written."""
    by = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", bucket_of(F.col(key)))
    by.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/runs/run={run}")


def current(spark: SparkSession, root: str, schema: str, key: str = "key") -> DataFrame:
    """(schema, bucket): one row a key, that of the latest run. What can't be read any more is not there, so its keys are read anew."""
    told = _pointer(root)
    later = [r for r in _folders(root, "runs") if r.removeprefix("run=") not in told["runs"]]
    read = lambda path: spark.read.schema(f"{schema}, bucket int").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    found = [read(f"{root}/versions/{told['version']}").withColumn("_run", F.lit(""))] if told["version"] else []
    found += [read(f"{root}/runs/{r}").withColumn("_run", F.lit(_ordered(r))) for r in later]
    if not found:
        return spark.createDataFrame([], f"{schema}, bucket int")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    names = [c for c in rows.columns if c != "_run"]
    # Within (bucket, key), whose folders a task reads: a row a key and run, so no group is large.
    place = F.row_number().over(Window.partitionBy("bucket", key).orderBy(F.desc("_run")))
    return rows.withColumn("_at", place).where("_at = 1").select(names)


def _ordered(run: str) -> str:
    """Numbers sort as numbers."""
    name = run.removeprefix("run=")
    return name.zfill(20) if name.isdigit() else name


def lookup(wanted: DataFrame, root: str, schema: str, key: str = "key") -> DataFrame:
    """Rows of the cache for the keys of ``wanted``; only their buckets are read."""
    keys = wanted.where(F.col(key).isNotNull()).select(key).distinct().withColumn("bucket", bucket_of(F.col(key)))
    buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # BUCKETS at most
    held = current(wanted.sparkSession, root, schema, key).where(F.col("bucket").isin(buckets))
    return held.join(keys, [key, "bucket"]).drop("bucket")


def compact(spark: SparkSession, root: str, schema: str, key: str = "key") -> None:
    """All runs become a version; then the pointer names it, and the runs are left to be deleted when no reader has them."""
    runs, version = _folders(root, "runs"), uuid.uuid4().hex
    current(spark, root, schema, key).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/versions/{version}")
    system, inner = _place(root)
    with system.open_output_stream(f"{inner}/pointer.{version}") as f:
        f.write(json.dumps({"version": version, "runs": [r.removeprefix("run=") for r in runs]}).encode())
    system.move(f"{inner}/pointer.{version}", f"{inner}/pointer")


def clean(spark: SparkSession, root: str) -> None:
    """Delete the runs and versions that the pointer has left behind; call it when no reader of an earlier pointer runs."""
    told, (system, inner) = _pointer(root), _place(root)
    for run in _folders(root, "runs"):
        if run.removeprefix("run=") in told["runs"]:
            system.delete_dir(f"{inner}/runs/{run}")
    for version in _folders(root, "versions"):
        if version != told["version"]:
            system.delete_dir(f"{inner}/versions/{version}")
