"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it: [\x20\x09-\x0D]
BLANKS = r"[\x20\x09-\x0D]+"


#: Rows and bytes that Spark sends to Python at once; Spark's own bounds are 10,000 rows and 64 MB or more.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches in this session: off-heap buffers and Python workers hold one batch each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where Spark is one process a temporary one does, if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_table(df: DataFrame, label: str, *by: str) -> str:
    """The path of a new table in the shared folder, in folders ``by`` columns if there are any."""
    path = f"{shared_dir(df.sparkSession)}/paperloom-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_table`` has written."""
    if "/paperloom-" in path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps don't
    recompute it, and a lost executor takes none of it along."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


#: Rows of one key above which the key counts as hot: the hot keys of n rows are n / HOT_ROWS at most.
HOT_ROWS = 50_000


def skew_join(rows: DataFrame, small: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined by ``key`` with ``small``, which has one row for each key and, in ``size``, how many of ``rows`` have it.

    The few keys that are hot, if any, are broadcast, so that their rows stay where they are. ``small`` is read twice: give a table.
    """
    hot = F.col(size) > HOT_ROWS
    if not small.where(hot).head(1):
        return rows.join(small.drop(size), key)
    often, rest = small.where(hot).drop(size), small.where(~hot).drop(size)
    return rows.join(F.broadcast(often), key).unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files that nothing refers to any more.

    It does so when the driver collects its garbage, which an almost idle driver rarely does on its own.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many ``_`` behind as make it differ from the names that are taken (in any case)."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


def cuts_below(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are less than a value: found among groups of cuts first, then within one."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    less = lambda some: F.size(F.filter(some, lambda c: c < value))
    found = F.transform(F.array(less(F.lit([g[0] for g in groups]))), lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + less(F.get(F.lit(groups), g - 1))))
    return F.element_at(found, 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
