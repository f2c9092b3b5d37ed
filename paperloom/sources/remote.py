"""A remote folder, or some of its files, read as a whole: listing, cache, fetches, records, what was left out, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import detect
from paperloom.operators.relational import content_key
from paperloom.options import Options
from paperloom.sources import cache as results_cache
from paperloom.sources import listing, sinks
from paperloom.sources.listing import FolderClient
from paperloom.sources.reader import RECORD, Converter, read_documents

#: What a cached result is known by changes with these: the form of records, and how they are made.
FORM = "record-1"
RESULT = "key string, " + ", ".join(f"{n} {t}" for n, t in RECORD.items() if n not in ("path", "error", "strategy", "fetched"))


@dataclass
class FolderRead:
    """documents: a row an entry that has contents to read (the entry's columns, the record's, cached, error); skipped: the other entries;
    counts: (folder, total, done, failed, hits, misses); text: (folder, name, text), the folder's documents for a roll-up."""

    documents: DataFrame
    skipped: DataFrame
    counts: DataFrame
    text: DataFrame


def read_folders(folders: DataFrame, client: FolderClient, cache: str, run: str, options: Options = Options(), converter: Converter | None = None, only: DataFrame | None = None) -> FolderRead:
    """Reads each of ``folders`` (folder), or of their entries those in ``only`` (id): what the cache has by content is neither fetched nor read again.

    Entries are known by their MD5, else by id and time; those with neither are always read. Results without an error go
    to the cache as ``run``; a run that is tried again replaces its own. A folder that can't be listed is a row of
    ``documents`` with an error. All is read when this is called, once, and lies in the scratch folder.
    """
    spark, folder = folders.sparkSession, sinks.scratch_folder(folders.sparkSession, "remote")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    listed = listing.folder_manifest(folders, client)
    if only is not None:
        listed = listed.join(only.select("id").distinct(), "id", "left_semi")
    variant = F.lit("plain" if converter is None else "converted")
    key = F.concat_ws(":", content_key(FORM, variant, F.col("md5"), F.col("id"), F.col("modified")), detect.extension(F.col("read_name")))
    manifest = kept(listed.withColumn("key", F.when(content_key(FORM, variant, F.col("md5"), F.col("id"), F.col("modified")).isNotNull(), key)), "manifest")
    asked = manifest.where(F.col("error").isNotNull() | detect.is_readable(F.col("kind")))
    known = kept(results_cache.lookup(asked.where("error is null"), cache, RESULT), "known")
    misses = asked.where("error is null").join(known.select("key"), "key", "left_anti")
    # Of entries with equal contents one is fetched.
    at = F.concat_ws("/", "folder", "id", "read_name").alias("at")
    first = misses.where("key is not null").groupBy("key").agg(F.min_by("id", F.struct("folder", "ordinal")).alias("id"), F.min("folder").alias("folder"))
    wanted = misses.where("key is null").unionByName(misses.join(first.select("key", "id"), ["key", "id"]).dropDuplicates(["key"]))
    fetched = kept(listing.fetch_entries(wanted, client, options).select("key", at, "content", "error"), "fetched")
    made = read_documents(fetched.where("error is null and content is not null"), "at", "content", converter, options).drop("stats", "strategy", "fetched")
    lost = fetched.where("error is not null").select(F.col("at").alias("path"), F.col("error").alias("failed"))
    made = kept(made.withColumnRenamed("error", "failed").unionByName(lost, allowMissingColumns=True).join(fetched.select(F.col("at").alias("path"), "key"), "path"), "made")
    results_cache.upsert(made.where("key is not null and failed is null").select(*[c.split()[0] for c in RESULT.split(", ") if c.split()[0] in made.columns]), cache, run)
    entry = ["folder", "ordinal", "id", "name", "read_name", "mime", "size", "modified", "key"]
    body = [n for n in made.columns if n not in ("path", "key", "failed")]
    by_key = asked.where("error is null").select(*entry).join(known.select("key", *body), "key").withColumn("cached", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    rest = asked.where("error is null").select(*entry, at).join(known.select("key"), "key", "left_anti")
    fresh = rest.where("key is not null").join(made.where("key is not null").select("key", *body, F.col("failed").alias("error")), "key").drop("at")
    alone = rest.where("key is null").join(made.where("key is null").select(F.col("path").alias("at"), *body, F.col("failed").alias("error")), "at").drop("at")
    unlisted = asked.where("error is not null").select(*entry, "error")
    documents = by_key.unionByName(fresh.unionByName(alone).withColumn("cached", F.lit(False))).unionByName(unlisted.withColumn("cached", F.lit(False)), allowMissingColumns=True)
    documents = kept(documents, "documents")
    failed = F.col("error").isNotNull()
    counts = documents.groupBy("folder").agg(F.count("*").alias("total"), F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))
    skipped = manifest.where(F.col("error").isNull() & ~detect.is_readable(F.col("kind"))).select("folder", "id", "name", "kind")
    return FolderRead(documents, skipped, counts, documents.where(~failed & (F.col("text") != "")).select("folder", "ordinal", "name", "text"))
