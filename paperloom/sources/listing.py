"""Which files there are: folders of files, manifests of a remote folder, contents by an injected client.

A client is any picklable object. ``pages(folder)`` yields lists of entries
(dictionaries with id, name, mimeType, modifiedTime, size, md5Checksum,
webViewLink), ``fetch(entry)`` gives an entry's bytes; a client with
``chunks(entry, start)``, which yields them from an offset on, is asked for these
instead. It runs in the tasks.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import detect
from paperloom.operators.analysis import can_retry
from paperloom.options import Options, PaperloomError

ENTRY = "folder string, ordinal long, id string, name string, mime string, modified string, size long, md5 string, link string, error string"
#: A task passes contents on after so many bytes.
HELD_BYTES = 16 << 20


class FolderClient(Protocol):
    def pages(self, folder: str) -> Iterator[list[dict[str, Any]]]: ...

    def fetch(self, entry: dict[str, Any]) -> bytes: ...


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, modificationTime, length) of the supported files under ``paths``; contents are not read.

    Names that begin with a dot, and what is in folders of such names, are left out (Spark also hides names that
    begin with an underscore). A path that isn't there is FILE_NOT_FOUND, none left NO_INPUT_FILES. Sort by path for an order.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        raise PaperloomError("FILE_NOT_FOUND", f"not found: {', '.join(paths)}") from e
    kept = found.where(detect.is_supported(F.col("path")) & ~F.rlike("path", F.lit(r"/\.")))
    if kept.isEmpty():
        raise PaperloomError("NO_INPUT_FILES", "no supported file in the given paths")
    return kept


def read_files(spark: SparkSession, paths: list[str], options: Options = Options()) -> DataFrame:
    """(path, length, content, error): the size limit is a filter on the scan; larger files are rows with FILE_TOO_LARGE and no content."""
    listed = list_files(spark, paths)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(F.col("length") <= options.most_bytes)
    whole = whole.where(detect.is_supported(F.col("path")) & ~F.rlike("path", F.lit(r"/\."))).select("path", "length", "content", F.lit(None).cast("string").alias("error"))
    return whole.unionByName(listed.where(F.col("length") > options.most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("FILE_TOO_LARGE").alias("error")))


def read_strategy(length: Column, seekable: Column, options: Options = Options()) -> Column:
    """range for large files that can be read in parts, else buffer."""
    return F.when(seekable & (length > options.range_threshold), "range").otherwise("buffer")


def error_text(e: BaseException) -> str:
    """An error as a cell: its code or kind, without what may be a secret in a URL."""
    return f"{getattr(e, 'code', None) or type(e).__name__}: {re.sub(r'([?&](?:key|token|sig)[^=]*=)[^&\s]+', r'\1...', str(e))[:300]}"


def entry_row(folder: str, ordinal: int, e: dict[str, Any]) -> tuple:
    """An entry of a client as a row of ENTRY."""
    size = None if e.get("size") in (None, "") else int(e["size"])
    return folder, ordinal, e.get("id"), e.get("name"), e.get("mimeType"), e.get("modifiedTime"), size, e.get("md5Checksum"), e.get("webViewLink"), None


def folder_manifest(folders: DataFrame, client: FolderClient) -> DataFrame:
    """The entries of each folder in the client's order, without contents, passed on page by page; where a folder fails is a row with an error.

    ``folders``: (folder). Ids are checked before the client is asked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, refused in zip(batch["folder"], batch["refused"]):
                names, given = [c.split()[0] for c in ENTRY.split(", ")], 0
                try:
                    if refused:
                        raise PaperloomError(refused, "no folder id")
                    for page in client.pages(folder):
                        yield pd.DataFrame([entry_row(folder, given + i, e) for i, e in enumerate(page)], columns=names, dtype=object)
                        given += len(page)
                except Exception as e:  # noqa: BLE001 (whatever a client raises is a row)
                    yield pd.DataFrame([(folder, given, *[None] * 7, error_text(e))], columns=names, dtype=object)

    asked = folders.select(F.trim("folder").alias("folder"), detect.folder_id_error(F.col("folder")).alias("refused"))
    found = asked.mapInPandas(run, ENTRY)
    kind = F.when(F.col("error").isNull(), detect.entry_kind(F.col("name"), F.col("mime")))
    return found.withColumn("kind", kind).withColumn("read_name", detect.export_name(F.col("name"), F.col("mime")))


def bounded(client: FolderClient, entry: dict[str, Any], options: Options, wait: Callable[[float], None] = time.sleep) -> tuple[bytes, str]:
    """(bytes, MD5) of an entry. What proves larger than ``most_bytes`` is given up within a chunk of it.

    A failure that may pass goes on from the bytes that are there, ``retries`` times without a new byte in between.
    """
    if not hasattr(client, "chunks"):
        data = client.fetch(entry)
        if len(data) > options.most_bytes:
            raise PaperloomError("FILE_TOO_LARGE", str(entry.get("name")))
        return data, hashlib.md5(data).hexdigest()
    held, digest, failed = bytearray(), hashlib.md5(), 0
    while True:
        try:
            for chunk in client.chunks(entry, len(held)):
                held += chunk
                digest.update(chunk)
                failed = 0
                if len(held) > options.most_bytes:
                    raise PaperloomError("FILE_TOO_LARGE", str(entry.get("name")))
            return bytes(held), digest.hexdigest()
        except Exception as e:
            failed += 1
            if failed > options.retries or not can_retry(e):
                raise
            wait(options.first_wait * 2 ** (failed - 1))


def fetch_entries(entries: DataFrame, client: FolderClient, options: Options = Options()) -> DataFrame:
    """``entries`` (a manifest) with content and error; what its size rules out is not fetched, what proves larger is refused.

    Contents are hashed as they come: one that differs from the manifest's ``md5`` is an error, CHECKSUM_MISMATCH, and
    not passed on. Entries that are folders or of no supported type stay without content.
    """
    told = entries.withColumn("error", F.coalesce("error", F.when(F.col("size") > options.most_bytes, "FILE_TOO_LARGE")))
    schema = told.withColumn("content", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for row in batch.to_dict("records"):
                row["content"] = None
                if row["error"] is None and row["kind"] in ("file", "export"):
                    try:
                        data, md5 = bounded(client, row, options)
                        if row["kind"] == "file" and re.fullmatch("[0-9a-fA-F]{32}", row["md5"] or "") and md5 != row["md5"].lower():
                            raise PaperloomError("CHECKSUM_MISMATCH", f"{row['name']}: {md5}")
                        row["content"], size = data, size + len(data)
                    except Exception as e:  # noqa: BLE001
                        row["error"] = error_text(e)
                held.append(row)
                if size >= HELD_BYTES:
                    yield pd.DataFrame(held, columns=schema.names, dtype=object)
                    held, size = [], 0
            yield pd.DataFrame(held, columns=schema.names, dtype=object)

    return told.mapInPandas(run, schema)


def with_cached(entries: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``entries`` with ``cached``: whether the cache has their key; no key is no hit."""
    known = cache.select(key).where(F.col(key).isNotNull()).distinct().withColumn("cached", F.lit(True))
    return entries.join(known, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def read_through(entries: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(results, fresh): entries whose key the cache has get its result, the others what ``read`` makes of them.

    ``read`` keeps the key and gives the columns of ``cache``; ``fresh`` are its rows without an error, to be added to
    the cache. One result of a key counts. Entries without a key are read and not cached. Results have the entry's own
    columns, so a renamed file has its new name.
    """
    known = cache.where(F.col(key).isNotNull()).dropDuplicates([key])
    hits = entries.join(known, key).withColumn("cached", F.lit(True))
    misses = entries.join(known.select(key), key, "left_anti")
    made = read(misses).withColumn("cached", F.lit(False))
    return hits.unionByName(made, allowMissingColumns=True), made.where(F.col(key).isNotNull() & F.col("error").isNull()).select(*cache.columns).dropDuplicates([key])


def progress(results: DataFrame) -> DataFrame:
    """(total, done, failed, hits, misses): the counters of a run."""
    failed = F.col("error").isNotNull()
    return results.agg(F.count("*").alias("total"), F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))


def skipped(manifest: DataFrame) -> DataFrame:
    """(id, name, kind) of what a folder has and is not read."""
    return manifest.where(F.col("error").isNull() & ~detect.is_readable(F.col("kind"))).select("id", "name", "kind")
