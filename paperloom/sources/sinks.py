"""Results as files: a JSON document of each record, a report."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import safe_name
from paperloom.operators.comparison import base_name
from paperloom.options import PaperloomError


def write_documents(records: DataFrame, folder: str, name: Column | None = None, provider: Column | None = None) -> None:
    """One JSON line a record, in ``folder/name=<safe name>/`` (and ``provider=<...>/`` below it); failed records are left out.

    The safe name is that of the path's last part; records whose names are the same share a folder. Nulls are written, so
    that each document has all fields.
    """
    name = safe_name(base_name(F.col("path"))) if name is None else name
    by = {"name": name} | ({} if provider is None else {"provider": provider})
    rows = records.where("error is null")
    rows.select(*[c.alias(k) for k, c in by.items()], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy(*by).text(folder)


def write_report(lines: DataFrame, folder: str) -> None:
    """The lines of a report (place, line), in order, as one text file; a report has a line for each file and provider."""
    lines.orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(folder)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise PaperloomError("MISSING_INPUT", "set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    return f"{base.rstrip('/')}/paperloom-{label}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Each row of ``files`` (path, content) as a file ``folder/path``, written by the tasks: a table of (path, length), the paths those of the files.

    The names are the caller's to keep apart. A task that is tried again writes the same files again, and the list of them
    is a table in the folder, so no later step writes anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])
        system.create_dir(f"{inner}/files", recursive=True)
        for batch in batches:
            lengths = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                with system.open_output_stream(f"{inner}/files/{name}") as out:
                    out.write(data)
                lengths.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/files/{n}" for n in batch.column(0).to_pylist()], "length": pa.array(lengths, pa.int64())})

    written = files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, length long")
    written.write.parquet(f"{folder}/list")
    return files.sparkSession.read.schema("path string, length long").parquet(f"{folder}/list")
