"""Command line, ``python -m paperloom``: ``read PATH... --out DIR``, ``list PATH...``, ``folder ID... --client MODULE:NAME --cache DIR --out DIR``, ``compare ANALYSES --providers A B --out DIR``."""

from __future__ import annotations

import argparse
import importlib
import logging
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperloom.operators import comparison
from paperloom.operators.records import describe
from paperloom.options import Options, PaperloomError
from paperloom.sources.listing import list_files, read_files
from paperloom.sources.reader import read_documents
from paperloom.sources.remote import read_folders
from paperloom.sources.sinks import write_documents, write_report

log = logging.getLogger("paperloom")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="paperloom")
    parser.add_argument("--log", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    commands = parser.add_subparsers(dest="command", required=True)
    read = commands.add_parser("read", help="a JSON record of each file")
    read.add_argument("paths", nargs="+")
    read.add_argument("--out", required=True)
    folder = commands.add_parser("folder", help="the records of remote folders, by a client MODULE:NAME")
    folder.add_argument("ids", nargs="+")
    folder.add_argument("--client", required=True)
    folder.add_argument("--cache", required=True)
    folder.add_argument("--out", required=True)
    compared = commands.add_parser("compare", help="a report of two providers' analyses (JSON lines)")
    compared.add_argument("analyses")
    compared.add_argument("--providers", nargs=2, required=True)
    compared.add_argument("--truth", help="a JSON file of expected keywords by file name")
    compared.add_argument("--out", required=True)
    listed = commands.add_parser("list", help="the supported files under paths")
    listed.add_argument("paths", nargs="+")
    return parser


def _folder(spark: SparkSession, asked: argparse.Namespace, options: Options) -> int:
    module, _, name = asked.client.partition(":")
    found = getattr(importlib.import_module(module), name)
    client = found() if isinstance(found, type) else found
    read = read_folders(spark.createDataFrame([(i,) for i in asked.ids], "folder string"), client, asked.cache, uuid.uuid4().hex, options)
    write_documents(read.documents, asked.out, F.coalesce("name", "folder"))
    for row in read.skipped.orderBy("folder", "name").toLocalIterator():
        log.info("%s: skipped, %s", row.name, row.kind)
    failed = 0
    for row in read.counts.orderBy("folder").collect():  # a row a folder that was asked for
        failed += row.failed
        log.info("%s: %d of %d read, %d failed, %d from the cache", row.folder, row.done, row.total, row.failed, row.hits)
    return int(failed > 0)


def _compare(spark: SparkSession, asked: argparse.Namespace) -> int:
    first, second = asked.providers
    analyses = spark.read.schema(comparison.ANALYSIS).json(asked.analyses)
    truth = comparison.read_truth(spark, asked.truth) if asked.truth else spark.createDataFrame([], "name string, keywords array<string>")
    visuals = comparison.with_recall(comparison.compare_visuals(analyses, first, second), truth)
    totals = comparison.comparison_totals(visuals, first, second)
    summaries = comparison.file_summaries(analyses.where(F.col("provider").isin(first, second)))
    write_report(comparison.report_lines(totals, comparison.recommendation(totals, first, second), summaries, first, second), asked.out)
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0; 1 if a file could not be read; 2 for what is no input."""
    asked = _parser().parse_args(arguments)
    logging.basicConfig(level=asked.log)
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    options = Options.from_environment()
    try:
        if asked.command == "folder":
            return _folder(spark, asked, options)
        if asked.command == "compare":
            return _compare(spark, asked)
        if asked.command == "list":
            for row in list_files(spark, asked.paths).orderBy("path").toLocalIterator():
                print(row.length, row.path)
            return 0
        files = read_files(spark, asked.paths, options)
        known = files.where("error is null")
        found = read_documents(known).unionByName(files.where("error is not null").select("path", "error"), allowMissingColumns=True).persist()
        write_documents(found, asked.out)
        line = describe(F.col("kind"), {"units": F.col("units"), "images": F.col("stats.images"), "charts": F.col("stats.charts")}, F.col("stats.words"))
        failed = 0
        for row in found.select("path", "error", line.alias("line")).orderBy("path").toLocalIterator():
            failed += row.error is not None
            log.log(logging.WARNING if row.error else logging.INFO, "%s: %s", row.path, row.error or row.line)
        found.unpersist()
        return int(failed > 0)
    except PaperloomError as e:
        log.error("%s: %s", e.code, e)
        return 2


if __name__ == "__main__":
    sys.exit(main())
