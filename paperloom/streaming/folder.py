"""A folder as a stream: new files are admitted, read once per content, and go out as JSON lines; progress as a stateful stream of these."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paperloom.functions.detect import extension
from paperloom.options import Options
from paperloom.sources import cache as results_cache
from paperloom.sources.reader import read_documents

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
CACHE_SCHEMA = "key string, kind string, text string, units int, error string"
LINE_SCHEMA = f"path string, {CACHE_SCHEMA}, cached boolean"
#: Batches after which the cache becomes one table again.
COMPACT_EVERY = 50


def admitted(batch: DataFrame, options: Options) -> DataFrame:
    """(path, length, refused) of landed files: a folder below the landing one is a request, of which ``most_files`` by path are taken; larger files than ``most_bytes`` are refused.

    Refused files don't count towards a request's number.
    """
    listed = batch.select("path", "length").withColumn("request", F.regexp_replace("path", r"/[^/]*$", "")).withColumn("large", F.col("length") > options.most_bytes)
    at = F.row_number().over(Window.partitionBy("request", "large").orderBy("path"))
    return listed.select("path", "length", F.when(F.col("large"), "FILE_TOO_LARGE").when(at > options.most_files, "TOO_MANY_FILES").alias("refused"))


def stream_folder(spark: SparkSession, landing: str, results: str, cache: str, checkpoint: str, options: Options = Options(), files_a_batch: int = 1_000) -> StreamingQuery:
    """Reads what lies in ``landing`` and ends; a later call goes on from ``checkpoint``.

    Each batch of ``files_a_batch`` files is admitted (``admitted``: refused ones are lines with an error, and their contents are not
    read) and looked up in the cache by extension and content (MD5): known contents aren't parsed again, failed ones are tried
    anew. Each file gives one JSON line (path, key, kind, text, units, error, cached) in ``results/batch=N``;
    a batch that is tried again overwrites its own folder and its own run of the cache.
    """

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        told = admitted(batch, options).persist()
        # A filter on the length is one on the scan: the contents of large files stay where they are.
        small = batch.where(F.col("length") <= options.most_bytes).join(told.where("refused is null").select("path"), "path", "left_semi")
        files = small.select("path", "content", F.concat_ws(":", extension(F.col("path")), F.md5("content")).alias("key"))
        listed = files.select("path", "key")
        known = results_cache.lookup(listed, cache, CACHE_SCHEMA).where("error is null")
        hits = listed.join(known, "key").withColumn("cached", F.lit(True))
        fresh = files.join(known.select("key"), "key", "left_anti").select("path", "content")
        done = read_documents(fresh, options=options).select("path", "kind", "text", "units", "error").join(listed, "path").withColumn("cached", F.lit(False))
        none = F.lit(None).cast("string")
        refused = told.where("refused is not null").select("path", none.alias("key"), none.alias("kind"), none.alias("text"), F.lit(None).cast("int").alias("units"), F.col("refused").alias("error"), F.lit(False).alias("cached"))
        path = f"{results}/batch={number}"
        lines = hits.unionByName(done).unionByName(refused).select(F.to_json(F.struct("path", "key", "kind", "text", "units", "error", "cached")).alias("value"))
        lines.write.mode("overwrite").text(path)
        told.unpersist()
        written = session.read.text(path).select(F.from_json("value", LINE_SCHEMA).alias("r")).select("r.*")
        results_cache.upsert(written.where("not cached and error is null").select("key", "kind", "text", "units", "error"), cache, str(number))
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            results_cache.compact(session, cache, CACHE_SCHEMA)

    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(landing)
    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "run string, type string, path string, done long, failed long, hits long, misses long, total long, error string"


class Progress(StatefulProcessor):
    """Keeps what a run has done, failed and found in the cache: a row a file, and one of type ``done`` after the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "done long, failed long, hits long, misses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        done, failed, hits, misses = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        for some in rows:
            out = []
            for path, cached, error, total in zip(some["path"], some["cached"], some["error"], some["total"]):
                lost = error is not None and error == error
                done, failed = done + (not lost), failed + lost
                hits, misses = hits + bool(cached), misses + (not cached)
                out.append((key[0], "file", path, done, failed, hits, misses, int(total), error if lost else None))
                if done + failed == total:
                    out.append((key[0], "done", None, done, failed, hits, misses, int(total), None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PROGRESS.split(", ")], dtype=object)
        self.counts.update((done, failed, hits, misses))

    def close(self) -> None:
        pass


def stream_progress(spark: SparkSession, results: str, out: str, checkpoint: str, files_a_batch: int = 1_000) -> StreamingQuery:
    """Running counters of each run, from JSON lines (run, total, path, cached, error) in ``results``, as JSON lines in ``out``.

    ``total`` is how many files the run has. The counters are state of the stream: a later call, or one after a
    failure, goes on from ``checkpoint``. The state needs the RocksDB store, which this sets for the session.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(results)
    told = lines.select(F.from_json("value", "run string, total long, path string, cached boolean, error string").alias("r")).select("r.*").where("run is not null")
    counted = told.groupBy("run").transformWithStateInPandas(Progress(), PROGRESS, "Append", "None")
    return counted.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
