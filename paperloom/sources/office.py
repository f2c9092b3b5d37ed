"""Word, PowerPoint and Excel files in one pass: a file is opened once, and one row holds all its parts.

Contents come with the rows, or are read by the tasks through a range client:
then only paths go through Spark, and of a large package only its directory and
the parts that are looked at are fetched, whatever its media weigh. What follows
from the parts (verdicts, tables, numbers) are expressions over the arrays of a
row, so no file is read twice and no row is shuffled.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.functions import detect, images, text, triage
from paperloom.operators import records
from paperloom.options import Options
from paperloom.sources import packages
from paperloom.sources.ranges import RangeClient, open_file

SLIDE = "struct<number:int,text:string,notes:string,pictures:array<string>,charts:array<string>>"
SHEET = "struct<number:int,name:string,rows:array<array<string>>,cut:boolean>"
MEDIUM = "struct<name:string,size:bigint,crc:bigint,head:binary,width:int,height:int>"
SERIES = "struct<part:string,kind:string,title:string,series:array<struct<name:string,categories:array<string>,points:array<string>>>>"
#: The parts of a package; those that its kind has not are null. ``placed``: the sheet of each chart.
PACKAGE = (
    f"path string, kind string, strategy string, length bigint, fetched bigint, text string, slides array<{SLIDE}>, sheets array<{SHEET}>, media array<{MEDIUM}>, charts array<{SERIES}>,"
    " placed array<struct<part:string,section:int>>, metadata map<string,string>, error string"
)


def _media(archive: zipfile.ZipFile, folder: str, most: int) -> list[dict[str, Any]]:
    """Entries under a folder; of pictures that are not too large, the first bytes."""
    found = []
    for info in archive.infolist():
        name = packages.entry_name(info)
        if not name.startswith(folder) or name.endswith("/"):
            continue
        row = {"name": name, "size": info.file_size, "crc": info.CRC, "head": None, "width": None, "height": None}
        is_picture = name.rpartition(".")[2].lower() in detect.MIME_OF_PICTURE
        if is_picture and info.file_size <= most and next(packages.refusals([(info.file_size, info.compress_size)])) is None:
            data = packages.read_part(archive, info)
            row["head"] = data[:32]
            if data[:3] == b"\xff\xd8\xff" and len(data) >= images.LEAST_BYTES:
                row["width"], row["height"] = images.jpeg_size(data) or (None, None)
        found.append(row)
    return found


def _charts(archive: zipfile.ZipFile) -> list[dict[str, Any]]:
    found: dict[str, dict[str, Any]] = {}
    for part, kind, title, _, name, categories, points in packages._charts(archive):
        chart = found.setdefault(part, {"part": part, "kind": kind, "title": title, "series": []})
        chart["series"].append({"name": name, "categories": categories, "points": points})
    return list(found.values())


def _sheets(archive: zipfile.ZipFile, most: int) -> list[dict[str, Any]]:
    found = {n: {"number": n, "name": name, "rows": [], "cut": False} for kind, n, name, _ in packages._sheet_charts(archive) if kind == "sheet"}
    for n, _, _, cells in packages._sheet_rows(archive, most):
        if cells is None:
            found[n]["cut"] = True
        else:
            found[n]["rows"].append(cells)
    return list(found.values())


def _placed(archive: zipfile.ZipFile) -> list[dict[str, Any]]:
    """Sheet to drawing to chart."""
    links = list(packages._sheet_charts(archive))
    sheet_of = {target: number for kind, number, _, target in links if kind == "sheet"}
    drawings = [(target, sheet_of[source]) for kind, _, source, target in links if kind == "drawing" and source in sheet_of]
    return [{"part": target, "section": number} for drawing, number in drawings for kind, _, source, target in links if kind == "chart" and source == drawing]


def parse(kind: str, archive: zipfile.ZipFile, options: Options) -> dict[str, Any]:
    """All parts of an open package that a record is made of."""
    if len(archive.infolist()) > packages.MOST_ENTRIES:
        raise ValueError("too many entries")
    out: dict[str, Any] = {"charts": _charts(archive), "metadata": list(packages._properties(archive))}
    if kind in records.MEDIA_FOLDERS:
        out["media"] = _media(archive, records.MEDIA_FOLDERS[kind], options.most_media)
    if kind == "docx":
        out["text"] = next(packages._word(archive))[0]
    elif kind == "pptx":
        out["slides"] = [dict(zip(("number", "text", "notes", "pictures", "charts"), s)) for s in packages._slides(archive)]
    else:
        out["sheets"], out["placed"] = _sheets(archive, options.most_sheet_rows), _placed(archive)
    return out


def read_packages(files: DataFrame, client: RangeClient | None = None, options: Options = Options()) -> DataFrame:
    """A row (PACKAGE) of each of ``files`` (path, kind, and content if there is no client).

    ``fetched`` are the bytes that a client gave. A file that can't be read is a row with EXTRACTION_FAILED (or the
    client's code); a package that no memory should hold as a whole is one with FILE_TOO_LARGE only if it is not read by ranges.
    """
    schema = to_arrow_schema(StructType.fromDDL(PACKAGE))

    def one(path: str, kind: str, content: bytes | None) -> dict[str, Any]:
        row: dict[str, Any] = {"path": path, "kind": kind, "strategy": "buffer"}
        try:
            file: Any = io.BytesIO(content) if client is None else None
            if client is not None:
                file, row["strategy"], row["length"] = open_file(client, path, options)
            else:
                row["length"] = len(content)
            try:
                with zipfile.ZipFile(file) as archive:
                    row |= parse(kind, archive, options)
            finally:
                row["fetched"] = None if client is None else getattr(file, "fetched", row["length"])
        except packages.BROKEN:
            row["error"] = "EXTRACTION_FAILED"
        except Exception as e:  # noqa: BLE001 (whatever a client raises is a row)
            if client is None:
                raise
            row["error"] = getattr(e, "code", None) or "EXTRACTION_FAILED"
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            contents = batch.column(2) if client is None else [None] * len(batch)
            for path, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), contents):
                held.append(one(path, kind, content.as_py() if content is not None else None))
                size += held[-1].get("fetched") or held[-1].get("length") or 0
                if size >= packages.HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("path", "kind", *(["content"] if client is None else [])).mapInArrow(run, PACKAGE)


def with_pictures(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pictures``, in the order of a package's entries: ids, sizes, the first slide that shows each, duplicates, verdicts.

    Each step is a column of its own, so that what a lambda looks up is evaluated once a row.
    """
    showing = lambda m: F.array_min(F.transform(F.filter("slides", lambda s: F.array_contains(s["pictures"], m["name"])), lambda s: s["number"]))
    size = lambda m: F.when(m["width"].isNotNull(), F.struct(m["width"].alias("width"), m["height"].alias("height"))).otherwise(images.header_size(m["head"]))
    rows = rows.withColumn("prints", F.transform("media", lambda m: F.concat_ws(":", m["crc"].cast("string"), m["size"].cast("string"))))
    rows = rows.withColumn("listed", F.transform("media", lambda m, i: F.struct(
        F.concat(F.lit("img-"), (i + 1).cast("string")).alias("id"), m["name"].alias("part"), detect.mime_of_name(m["name"]).alias("mime"), size(m).alias("at"),
        m["size"].alias("bytes"), showing(m).alias("section"), F.array_position("prints", F.get("prints", i)).cast("int").alias("first"),
    )))
    rows = rows.withColumn("listed", F.transform("listed", lambda m, i: m.withField("duplicate_of", F.when(m["first"] <= i, F.concat(F.lit("img-"), m["first"].cast("string"))))))
    rows = rows.withColumn("listed", F.transform("listed", lambda m: m.withField("verdict", triage.image_verdict(m["duplicate_of"], m["mime"], m["at"]["width"], m["at"]["height"]))))
    return rows.withColumn("pictures", F.transform("listed", lambda m: F.struct(
        m["id"].alias("id"), F.regexp_extract(m["part"], r"([^/]*)$", 1).alias("name"), m["mime"].alias("mime"), m["at"]["width"].alias("width"), m["at"]["height"].alias("height"), m["bytes"].alias("bytes"),
        m["section"].alias("section"), m["duplicate_of"].alias("duplicate_of"), m["verdict"]["needs_vision"].alias("needs_vision"), m["verdict"]["reason"].alias("reason"), m["part"].alias("part"),
    )))


def judged_slides(slides: Column, pictures: Column) -> Column:
    """(number, text, notes, needs_vision, reason) of each slide, by the pictures on it that are worth a look and on no slide before."""

    def one(s: Column) -> Column:
        among = lambda test: lambda part: F.exists(pictures, lambda p: (p["part"] == part) & test(p))
        worth = F.filter(s["pictures"], among(lambda p: p["needs_vision"]))
        fresh = F.size(F.filter(worth, among(lambda p: p["section"] == s["number"])))
        reason = records.slide_reason(fresh, F.size(worth) > 0, F.exists(s["pictures"], among(lambda p: F.lit(True))))
        return F.struct(s["number"].alias("number"), s["text"].alias("text"), s["notes"].alias("notes"), (fresh > 0).alias("needs_vision"), reason.alias("reason"))

    return F.transform(slides, one)


def placed_charts(charts: Column, slides: Column, placed: Column) -> Column:
    """Charts with the slide or sheet that shows them first, and numbers where points are such."""
    by_slide = lambda c: F.array_min(F.transform(F.filter(slides, lambda s: F.array_contains(s["charts"], c["part"])), lambda s: s["number"]))
    by_sheet = lambda c: F.array_min(F.transform(F.filter(placed, lambda p: p["part"] == c["part"]), lambda p: p["section"]))
    series = lambda c: F.transform(c["series"], lambda s: F.struct(s["name"].alias("name"), s["categories"].alias("categories"), F.transform(s["points"], lambda p: p.try_cast("double")).alias("values")))
    return F.transform(charts, lambda c: F.struct(c["part"].alias("part"), c["kind"].alias("kind"), c["title"].alias("title"), F.coalesce(by_slide(c), by_sheet(c)).alias("section"), series(c).alias("series")))


def sheet_tables(sheets: Column) -> Column:
    """(number, name, table) of each sheet, its rows as Markdown."""
    return F.transform(sheets, lambda s: F.struct(s["number"].alias("number"), s["name"].alias("name"), text.md_table(s["rows"]).alias("table")))


def cut_warnings(sheets: Column, most: int) -> Column:
    return F.transform(F.filter(sheets, lambda s: s["cut"]), lambda s: F.concat(F.lit('Sheet "'), s["name"], F.lit(f'" cut at {most} rows.')))


def slim_package(file: io.RawIOBase) -> bytes:
    """A package with all its parts but empty media, stored: what a converter gets of a large file whose media were not fetched."""
    held = io.BytesIO()
    with zipfile.ZipFile(file) as archive, zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as out:
        for info in archive.infolist():
            if not info.is_dir():
                media = any(folder in info.filename for folder in ("/media/", "/embeddings/"))
                out.writestr(zipfile.ZipInfo(info.filename), b"" if media else packages.read_part(archive, info))
    return held.getvalue()
