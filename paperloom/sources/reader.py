"""One record of each file, whatever its type."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import detect, images, text, triage
from paperloom.operators import records
from paperloom.options import Options
from paperloom.sources import delimited, office, packages, pdf, sinks
from paperloom.sources.ranges import ArrowRanges, RangeClient, fetch_files, file_heads, open_file

SECTION = "struct<kind:string,number:int,title:string,text:string,notes:string,needs_vision:boolean,reason:string>"
PICTURE = "struct<id:string,name:string,mime:string,width:int,height:int,bytes:bigint,section:int,duplicate_of:string,needs_vision:boolean,reason:string>"
CHART = "struct<part:string,kind:string,title:string,section:int,series:array<struct<name:string,categories:array<string>,values:array<double>>>>"
#: The columns of a record; a part that a type lacks is an empty array.
RECORD = {
    "path": "string", "kind": "string", "text": "string", "markdown": "string", "units": "int", "sections": f"array<{SECTION}>", "images": f"array<{PICTURE}>", "charts": f"array<{CHART}>",
    "metadata": "map<string,string>", "warnings": "array<string>", "strategy": "string", "fetched": "bigint", "error": "string",
}


def _record(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with all columns of a record; those that aren't given are taken from the rows, or empty."""
    empty = {"array": F.array, "map": F.create_map}

    def column(name: str, kind: str) -> Column:
        got = columns.get(name, F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
        return next((F.coalesce(got, make().cast(kind)) for start, make in empty.items() if kind.startswith(start)), got).alias(name)

    return rows.select(*[column(n, k) for n, k in RECORD.items()])


def _section(kind: str, number: Column, said: Column, needs: Column | None = None, reason: Column | str = "", title: Column | None = None, notes: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    parts = (F.lit(kind), number, none if title is None else title, said, none if notes is None else notes, F.lit(False) if needs is None else needs, reason)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("kind", "number", "title", "text", "notes", "needs_vision", "reason"))]).cast(SECTION)


def _gathered(rows: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """(path, values): arrays of the parts of each file, in order; a file's parts are bounded by the readers' limits."""
    held = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[v.alias(n) for n, v in values.items()]).alias("v")))).alias("parts"), F.max("error").alias("error"))
    return held.select("path", "error", F.transform("parts", lambda p: p["v"]).alias("v")).select("path", "error", *[F.col(f"v.{n}").alias(n) for n in values])


def pretty_json(raw: Column) -> Column:
    """JSON with two spaces a level, keys as they come; null for what is no JSON."""

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return pretty(raw)


def _joined(parts: Column, separator: str) -> Column:
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), separator)


def _texts(files: DataFrame) -> DataFrame:
    ext = detect.extension(F.col("path"))
    rows = files.withColumn("raw", text.decode_bytes(F.col("content"))).withColumn("ext", ext)
    tables = {"csv": ",", "tsv": "\t"}
    cells = F.coalesce(*[delimited.delimited_cells(F.when(F.col("ext") == e, F.col("raw")), d) for e, d in tables.items()])
    rows = rows.withColumn("cells", cells)
    table = F.when(F.col("ext").isin(list(tables)), text.md_table(F.col("cells")))
    rows = rows.withColumn("table", table).withColumn("pretty", pretty_json(F.when(F.col("ext") == "json", F.col("raw"))))
    said = (
        F.when(F.col("ext").isin(list(tables)), text.table_text(F.col("table")))
        .when(F.col("ext") == "json", F.coalesce("pretty", "raw"))
        .when(F.col("ext").isin("html", "htm", "xml"), text.html_to_text(F.col("raw")))
        .when(F.col("ext") == "md", text.markdown_to_text(F.col("raw")))
        .otherwise(text.trim_ws(F.col("raw")))
    )
    markdown = F.when(F.col("ext").isin(list(tables)), F.col("table")).when(F.col("ext") == "md", F.col("raw")).when(F.col("pretty").isNotNull(), F.concat(F.lit("```json\n"), "pretty", F.lit("\n```")))
    odd = (F.col("ext") == "json") & F.col("pretty").isNull() & F.col("raw").isNotNull()
    rows = rows.withColumn("said", said)
    there = F.col("content").isNotNull()
    return _record(rows, text=F.col("said"), markdown=markdown, units=F.when(there, 1), sections=F.when(there, F.array(_section("body", F.lit(1), F.col("said"), reason="text file"))),
                   warnings=F.when(odd, F.array(F.lit("File has a .json extension but is not valid JSON."))), error=F.when(~there, "EXTRACTION_FAILED"))


def _packages(files: DataFrame, client: RangeClient | None = None, options: Options = Options()) -> DataFrame:
    """Word files, slides and sheets: one row a file from its parts to its record, in one pass."""
    rows = office.with_pictures(office.read_packages(files, client, options))
    rows = rows.withColumn("judged", office.judged_slides(F.col("slides"), F.col("pictures"))).withColumn("tables", office.sheet_tables(F.col("sheets")))
    whole = lambda s: F.concat_ws("\n", F.nullif(s["text"], F.lit("")), F.when(s["notes"] != "", F.concat(F.lit("Notes: "), s["notes"])))
    rows = rows.withColumn("made", F.array_join(F.transform("tables", lambda t: F.concat(F.lit("## "), t["name"], F.lit("\n\n"), t["table"])), "\n\n"))
    ok, kind = F.col("error").isNull(), F.col("kind")
    sections = {
        "docx": F.array(_section("body", F.lit(1), F.col("text"), reason="text document")),
        "pptx": F.transform("judged", lambda s: _section("slide", s["number"], s["text"], s["needs_vision"], s["reason"], notes=s["notes"])),
        "xlsx": F.transform("tables", lambda t: _section("sheet", t["number"], t["table"], reason="tabular data", title=t["name"])),
    }
    said = {"docx": F.col("text"), "pptx": _joined(F.transform("judged", whole), "\n\n"), "xlsx": text.table_text(F.col("made"))}
    of_kind = lambda made: F.when(ok, F.coalesce(*[F.when(kind == k, c) for k, c in made.items()]))
    picture = lambda p: F.struct(*[p[n].alias(n) for n in ("id", "name", "mime", "width", "height", "bytes", "section", "duplicate_of", "needs_vision", "reason")]).cast(PICTURE)
    return _record(
        rows, text=of_kind(said), markdown=of_kind({"xlsx": F.col("made")}), units=of_kind({"docx": F.lit(1), "pptx": F.size("slides"), "xlsx": F.size("sheets")}), sections=of_kind(sections),
        images=F.transform("pictures", picture), charts=office.placed_charts(F.col("charts"), F.col("slides"), F.col("placed")), metadata=text.pick_defined(F.col("metadata")),
        warnings=office.cut_warnings(F.col("sheets"), options.most_sheet_rows),
    )


def _pages(files: DataFrame) -> DataFrame:
    pages = pdf.pdf_pages(files)
    held = _gathered(pages, ["number"], section=_section("page", F.col("number"), F.col("text"), F.col("needs_vision"), F.col("reason")), said=F.col("text"))
    told = pdf.pdf_metadata(files).where("error is null and key is not null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    held = held.join(told, "path", "left")
    ok = F.col("error").isNull()
    cut = F.when(F.size("section") >= pdf.MOST_PAGES, F.array(F.lit(f"Only the first {pdf.MOST_PAGES} pages were read.")))
    return _record(held, kind=F.lit("pdf"), text=F.when(ok, _joined(F.col("said"), "\n\n")), sections=F.when(ok, F.col("section")), units=F.when(ok, F.size("section")), warnings=cut)


def _images(files: DataFrame) -> DataFrame:
    rows = files.withColumn("mime", detect.mime_of_name(F.col("path"))).withColumn("s", images.image_size(F.col("content")))
    rows = rows.withColumn("v", triage.image_verdict(F.lit(None).cast("string"), F.col("mime"), F.col("s.width"), F.col("s.height")))
    there, none = F.col("content").isNotNull(), F.lit(None).cast("string")
    picture = F.struct(F.lit("img-1").alias("id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "mime", "s.width", "s.height", F.octet_length("content").cast("long").alias("bytes"), F.lit(1).alias("section"), none.alias("duplicate_of"), "v.needs_vision", "v.reason")
    return _record(rows, text=F.when(there, ""), units=F.when(there, 1), sections=F.when(there, F.array(_section("image", F.lit(1), F.lit(""), F.col("v.needs_vision"), F.col("v.reason")))),
                   images=F.when(there, F.array(picture.cast(PICTURE))), error=F.when(~there, "EXTRACTION_FAILED"))


def _archives(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Archives read member by member; an archive in an archive is a member whose text is its own roll-up.

    They are unpacked when this is called, level by level, into tables that the tasks share, so each is opened once. The
    parts of one archive go to one row; what an archive may unpack to (``packages.MOST_BYTES``) bounds it.
    """
    spark, folder, levels, level = files.sparkSession, sinks.scratch_folder(files.sparkSession, "archives"), [], files
    for depth in range(1, packages.MOST_DEPTH + 1):
        here = packages.archive_level(level, depth)
        here.write.parquet(f"{folder}/level-{depth}")
        levels.append(spark.read.schema(here.schema).parquet(f"{folder}/level-{depth}"))
        level = packages.inner_archives(levels[-1])
        if level.isEmpty():
            break
    members = reduce(lambda a, b: a.unionByName(b), levels)
    told = members.where("parent is not null and skipped is null and error is null and not endswith(lower(path), '.zip')")
    child = members.where("parent is not null and error is not null and skipped is null and path is not null").select("path", "parent", "depth", "ordinal", F.lit(None).cast("string").alias("text"), "error", F.lit(False).alias("needs"))
    if not told.isEmpty():
        needs = F.exists(F.concat(F.transform("sections", lambda s: s["needs_vision"]), F.transform("images", lambda s: s["needs_vision"])), lambda x: x)
        _read(told.select("path", "content"), options).select("path", "text", "error", needs.alias("needs")).write.parquet(f"{folder}/children")
        found = spark.read.schema("path string, text string, error string, needs boolean").parquet(f"{folder}/children")
        child = child.unionByName(found.join(told.select("path", "parent", "depth", "ordinal"), "path"))
    refused = members.where("skipped is not null").groupBy(F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.concat(F.lit("skipped "), "path", F.lit(": "), "skipped"))).alias("skipped"))
    tops = files.select("path", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("ordinal"))
    inner = members.where("endswith(lower(path), '.zip') and skipped is null and error is null").select("path", "parent", "depth", "ordinal")
    zips, out = tops.unionByName(inner), None
    for depth in reversed(range(len(levels))):
        section = _section("file", F.lit(None).cast("int"), F.lit(""), F.col("needs"), F.when(F.col("error").isNull(), "see child document").otherwise("could not be read"), title=F.col("path"))
        said = F.when(F.col("text") != "", F.concat(F.lit("## "), "path", F.lit("\n\n"), "text"))
        own = child.where(F.col("depth") == depth + 1).withColumn("section", section).withColumn("said", said)
        held = own.groupBy(F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "section", "said", "needs"))).alias("p"))
        numbered = F.transform("p", lambda x, i: x["section"].withField("number", i + 1))
        here = zips.where(F.col("depth") == depth).join(held, "path", "left").select(
            "path", "parent", "depth", "ordinal", F.coalesce(_joined(F.transform("p", lambda x: x["said"]), "\n\n"), F.lit("")).alias("text"),
            numbered.alias("sections"), F.coalesce(F.exists("p", lambda x: x["needs"]), F.lit(False)).alias("needs"), F.lit(None).cast("string").alias("error"),
        )
        child = child.unionByName(here.select("path", "parent", "depth", "ordinal", "text", "error", "needs"))
        out = here
    broken = members.where("depth = 1 and path = parent and error is not null").select(F.col("parent").alias("path"), F.col("error").alias("failed"))
    rows = out.drop("error").join(broken, "path", "left").join(refused, "path", "left")
    empty = F.when(F.col("sections").isNull() & F.col("failed").isNull(), F.array(F.lit("Archive had no supported files in it."))).otherwise(F.array().cast("array<string>"))
    ok = F.col("failed").isNull()
    return _record(rows, kind=F.lit("zip"), text=F.when(ok, F.col("text")), units=F.when(ok, F.coalesce(F.size("sections"), F.lit(0))), sections=F.when(ok, F.col("sections")), warnings=F.concat(empty, F.coalesce("skipped", F.array().cast("array<string>"))), error=F.col("failed"))


READERS = {"text": _texts, "pdf": _pages, "image": _images}
#: Types whose files are packages of parts.
PACKAGES = ("docx", "pptx", "xlsx")


def _kind(head: Column) -> Column:
    return F.coalesce(detect.detect_type(F.col("path"), F.lit(None).cast("string"), head), F.lit("unknown"))


def _refused(told: DataFrame) -> DataFrame:
    refused = F.coalesce(detect.error_code(F.when(F.col("kind") != "unknown", F.col("kind"))), F.lit("UNSUPPORTED_FILE_TYPE"))
    return _record(told.where(~F.col("kind").isin("zip", *PACKAGES, *READERS)), error=refused)


def _read(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Records of all files but archives, from their contents."""
    told = files.withColumn("kind", _kind(F.substring(F.col("content"), 1, 8)))
    found = _refused(told).unionByName(_packages(told.where(F.col("kind").isin(*PACKAGES)), None, options))
    return reduce(lambda a, b: a.unionByName(b), [read(told.where(F.col("kind") == k)) for k, read in READERS.items()], found)


class Converter(Protocol):
    """Makes Markdown of a file; none if it can't. Runs in the tasks."""

    def convert(self, name: str, content: bytes) -> str | None: ...


#: Types that a converter is asked for, and characters of its Markdown that are kept.
CONVERTED, MOST_MARKDOWN = ("docx", "pptx", "xlsx", "xls", "text"), 200_000


def _converted(files: DataFrame, converter: Converter, client: RangeClient | None = None, options: Options = Options()) -> DataFrame:
    """(path, made, warning): a converter's Markdown of each file of a type that it takes; a failure is a warning.

    ``files``: (path, kind, and content if there is no client).
    """

    def fetched(path: str) -> bytes:
        file, strategy, _ = open_file(client, path, options)
        return office.slim_package(file) if strategy == "range" else file.read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"] if client is None else batch["path"]):
                made, warning = None, None
                try:
                    made = converter.convert(path, data if client is None else fetched(path)) or None
                    if made and len(made) > MOST_MARKDOWN:
                        made, warning = made[:MOST_MARKDOWN], f"Markdown cut at {MOST_MARKDOWN} characters."
                    elif not made:
                        warning = "The converter gave nothing."
                except Exception as e:  # noqa: BLE001 (whatever a converter raises is a warning)
                    warning = f"The converter failed: {type(e).__name__}"
                rows.append((path, made, warning))
            yield pd.DataFrame(rows, columns=["path", "made", "warning"], dtype=object)

    plain = detect.extension(F.col("path")).isin("txt", "md")
    asked = files.where(F.col("kind").isin(*CONVERTED) & ~plain)
    asked = asked.where("content is not null").select("path", "content") if client is None else asked.select("path")
    return asked.mapInPandas(run, "path string, made string, warning string")


def _with_converted(found: DataFrame, made: DataFrame) -> DataFrame:
    """A converter's Markdown comes first, the own reader's stays where it gave none; the text of slides is the own reader's."""
    rows, got = found.join(made, "path", "left"), F.col("made").isNotNull()
    said = text.markdown_to_text(F.col("made"))
    body = got & F.col("kind").isin("docx", "xls", "text")
    reason = F.when(F.col("kind") == "xls", "tabular data").when(F.col("kind") == "docx", "text document").otherwise("text file")
    return rows.select(*[{
        "text": F.when(got & (F.col("kind") != "pptx"), said).otherwise(F.col("text")), "markdown": F.coalesce("made", "markdown"),
        "units": F.when(body, 1).otherwise(F.col("units")), "sections": F.when(body, F.array(_section("body", F.lit(1), said, reason=reason))).otherwise(F.col("sections")),
        "warnings": F.when(F.col("warning").isNotNull(), F.concat("warnings", F.array("warning"))).otherwise(F.col("warnings")), "error": F.when(~(got & (F.col("kind") == "xls")), F.col("error")),
    }.get(n, F.col(n)).alias(n) for n in RECORD])


def read_documents(files: DataFrame, name: str = "path", content: str = "content", converter: Converter | None = None, options: Options = Options()) -> DataFrame:
    """A record (see RECORD, with ``stats``) of each file: text, Markdown, sections, pictures, charts, metadata, warnings; units are pages, slides, sheets, files.

    Only files that need a parser go to Python; Word files, slides and sheets are opened once. Types without a reader and unknown
    ones give UNSUPPORTED_FILE_TYPE, old office files LEGACY_OFFICE_FORMAT or NEEDS_MARKITDOWN, unreadable ones the
    reader's error; a limit that cuts something is a warning. Paths are unique. With a ``converter`` its Markdown comes first.
    """
    rows = files.select(F.col(name).cast("string").alias("path"), F.col(content).alias("content"))
    kind = _kind(F.substring(F.col("content"), 1, 8))
    found = _read(rows.where(kind != "zip"), options).unionByName(_archives(rows.where(kind == "zip"), options))
    if converter is not None:
        found = _with_converted(found, _converted(rows.withColumn("kind", kind), converter))
    return _counted(found)


def read_paths(files: DataFrame, client: RangeClient | None = None, name: str = "path", converter: Converter | None = None, options: Options = Options()) -> DataFrame:
    """``read_documents`` of files that the tasks read themselves, by a range client (pyarrow's file systems if none is given).

    Only paths go through Spark. A Word file, deck or book beyond ``options.range_threshold`` is read by ranges, so its
    media cost nothing (``strategy``, ``fetched``); a converter gets a copy of it with empty media. Other files are
    fetched whole up to ``options.most_bytes``, beyond it they are rows with FILE_TOO_LARGE.
    """
    client = ArrowRanges() if client is None else client
    paths = files.select(F.col(name).cast("string").alias("path"))
    by_name = detect.detect_type(F.col("path"), F.lit(None).cast("string"), F.lit(None).cast("binary"))
    named = paths.withColumn("kind", by_name).where("kind is not null")
    # Only where the name does not tell are the first bytes asked for.
    told = named.unionByName(file_heads(paths.where(by_name.isNull()), client).withColumn("kind", _kind(F.col("head"))).drop("head"))
    whole = fetch_files(told.where(F.col("kind").isin("zip", *READERS)), client, options)
    lost = _record(whole.where("error is not null").withColumn("kind", _kind(F.lit(None).cast("binary"))))
    held = whole.where("error is null").select("path", "content")
    kind = _kind(F.substring(F.col("content"), 1, 8))
    found = _refused(told).unionByName(lost).unionByName(_packages(told.where(F.col("kind").isin(*PACKAGES)), client, options))
    found = found.unionByName(_read(held.where(kind != "zip"), options)).unionByName(_archives(held.where(kind == "zip"), options))
    if converter is not None:
        found = _with_converted(found, _converted(told, converter, client, options))
    return _counted(found)


def _counted(found: DataFrame) -> DataFrame:
    return found.withColumn("stats", records.document_stats(F.col("text"), F.col("sections"), F.col("images"), F.col("charts")))


def to_analyse(found: DataFrame) -> DataFrame:
    """(path, kind, text, stats): the documents that go on to the analysis, their text labelled by pages or slides; archives and failures stay behind."""
    return found.where("kind <> 'zip' and error is null").select("path", "kind", records.labelled_text(F.col("kind"), F.col("sections"), F.col("text")).alias("text"), "stats")
