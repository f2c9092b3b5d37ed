"""Rows out of ZIP packages: archive members, Word text, PowerPoint slides, Excel rows.

Each function takes a DataFrame of files (a name and the bytes, as the
``binaryFile`` source gives them) and returns flat rows, so that filters, joins
and roll-ups stay with Spark. A task holds a few megabytes of files, or one larger file. A file that can't
be read gives one row with ``error`` set and no other value; null bytes count as
such a file.
"""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.functions.detect import is_junk, is_supported

MB = 1 << 20
#: Limits of an archive: entries, bytes of an entry, bytes in all, size to packed size of large entries, nesting.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES, MOST_RATIO, RATIO_FROM, MOST_DEPTH = 5_000, 200 * MB, 1024 * MB, 1_000, 10 * MB, 3
MOST_SHEET_ROWS = 5_000
MOST_MEDIA = 5 * MB
#: A task passes rows on after so many bytes of files.
HELD_BYTES = 4 * MB
#: Parts that a worker remembers of each sort, and the size of the largest of these: the files of one maker share many parts.
REMEMBERED, REMEMBERED_SIZE = 256, 4_096
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, EOFError, NotImplementedError, RuntimeError, TypeError, ValueError)


def _remembered(make: Callable) -> Callable:
    """``make`` of a part (and what it depends on besides), looked up where the part is short and was seen lately."""
    known = functools.lru_cache(REMEMBERED)(make)

    @functools.wraps(make)
    def looked_up(part: Any, *more: Any) -> Any:
        return (known if len(part) <= REMEMBERED_SIZE else make)(part, *more)

    return looked_up


#: Ends, entries and heads of ZIP packages; an entry may be told to follow its data, to be deflated by any level, and to be named in UTF-8.
END, LISTED, HEAD, PLAIN_FLAGS = struct.Struct("<4s4H2LH"), struct.Struct("<4s2x3H4x3L3H8xL"), struct.Struct("<4s22x2H"), 0x80E


def _inflated(packed: bytes, method: int, whole: int, crc: int) -> bytes | None:
    """A part's bytes, if they are as many as told, with this sum, and nothing follows."""
    got = packed
    if method:
        inflate = zlib.decompressobj(-15)
        try:
            got = inflate.decompress(packed, whole + 1)
        except zlib.error:
            return None
        if not inflate.eof or inflate.unused_data:
            return None
    return got if len(got) == whole and zlib.crc32(got) == crc else None


_inflated_lately = functools.lru_cache(REMEMBERED)(_inflated)


class PlainPackage:
    """The parts of a package in memory as ``zipfile`` gives them, but for its cost, which is many times that of a few short parts."""

    def __init__(self, data: bytes, parts: dict[str, tuple[int, ...]]) -> None:
        self.data, self.NameToInfo = data, parts

    @classmethod
    def of(cls, data: bytes | None) -> PlainPackage | None:
        """None of what is not plain (comments, extra fields, 64 bits, passwords, names twice or beyond ASCII, parts out of order) or broken: ``zipfile`` tells."""
        end = len(data or b"") - END.size
        if end < 0 or data[max(end - 20, 0) :].startswith(b"PK\6\7"):
            return None
        sign, disk, disks, here, count, size, start, comment = END.unpack_from(data, end)
        if sign != b"PK\5\6" or disk or disks or comment or here != count or start + size != end or size < count * LISTED.size:
            return None
        parts: dict[str, tuple[int, ...]] = {}
        at, free = start, 0
        for _ in range(count):
            if at + LISTED.size > end:
                return None
            sign, version, flags, method, crc, packed, whole, named, extra, comment, offset = LISTED.unpack_from(data, at)
            at += LISTED.size + named
            name = data[at - named : at]
            if sign != b"PK\1\2" or version > zipfile.MAX_EXTRACT_VERSION or flags & ~PLAIN_FLAGS or method not in (0, 8) or extra or comment or offset < free or not name.isascii() or b"\0" in name:
                return None
            free = offset + HEAD.size + named + packed
            parts[name.decode()] = (offset, method, crc, packed, whole)
        return cls(data, parts) if at == end and free <= start and len(parts) == count else None

    def namelist(self) -> list[str]:
        return list(self.NameToInfo)

    def read(self, part: str) -> bytes:
        offset, method, crc, packed, whole = self.NameToInfo[part]
        if whole > MOST_ENTRY_BYTES:
            raise ValueError("larger than an entry may be")
        sign, named, extra = HEAD.unpack_from(self.data, offset)
        at = offset + HEAD.size + named
        # A head's extra field would move the data, towards the next part.
        if sign == b"PK\3\4" and not extra and self.data[at - named : at] == part.encode():
            got = (_inflated_lately if whole <= REMEMBERED_SIZE >= packed else _inflated)(self.data[at : at + packed], method, whole, crc)
            if got is not None:
                return got
        with zipfile.ZipFile(io.BytesIO(self.data)) as archive:
            return archive.read(part)


Archive = zipfile.ZipFile | PlainPackage


def _opened(rows: Callable[[Archive], Iterator[tuple]]) -> Callable[[bytes], Iterator[tuple]]:
    """``rows`` of an open package, as a function of its bytes."""

    def of_bytes(data: bytes) -> Iterator[tuple]:
        if plain := PlainPackage.of(data):
            yield from rows(plain)
        else:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                yield from rows(archive)

    return of_bytes


def _expand(files: DataFrame, name: str, content: str, columns: str, rows: Callable[[bytes], Iterator[tuple]], code: str) -> DataFrame:
    """(name, columns, error): what ``rows`` gives of each file."""
    schema = _arrow_schema(files, f"path string, {columns}, error string")
    empty = (None,) * (len(schema) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                first = len(held)
                try:
                    for r in rows(data):
                        held.append((key, *r, None))
                except BROKEN:
                    del held[first:]
                    held.append((key, *empty, code))
                size += len(data or b"")
                if size >= HELD_BYTES:
                    yield _batch(held, schema)
                    held, size = [], 0
            yield _batch(held, schema)

    return files.select(F.col(name).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, f"path string, {columns}, error string")


def _arrow_schema(files: DataFrame, columns: str) -> pa.Schema:
    return to_arrow_schema(files.sparkSession.createDataFrame([], columns).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def entry_name(info: zipfile.ZipInfo) -> str:
    """The name in the archive; without the UTF-8 flag its bytes count as Latin-1."""
    name = info.orig_filename
    if not info.flag_bits & 0x800:
        name = name.encode("cp437", "replace").decode("latin-1")
    return name.replace("\\", "/")


def refusals(sizes: list[tuple[int, int]]) -> Iterator[str | None]:
    """Why an entry of (size, packed size) is not unpacked; only those taken count towards the total."""
    total = 0
    for size, packed in sizes:
        if size > MOST_ENTRY_BYTES:
            yield "larger than an entry may be"
        elif size > RATIO_FROM and size > MOST_RATIO * max(packed, 1):
            yield "packed too tightly"
        elif total + size > MOST_BYTES:
            yield "archive unpacks to too much"
        else:
            total += size
            yield None


def _members(data: bytes, read: Callable[[str], bool] = lambda name: True) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        entries = [e for e in archive.infolist() if not e.is_dir()]
        if len(entries) > MOST_ENTRIES:
            raise ValueError("too many entries")
        for i, (e, refused) in enumerate(zip(entries, refusals([(e.file_size, e.compress_size) for e in entries]))):
            yield i, entry_name(e), e.file_size, e.CRC, refused, archive.read(e) if not refused and read(entry_name(e)) else None


def zip_members(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, ordinal, name, size, crc, refused, content, error) of each entry."""
    return _expand(files, name, content, "ordinal int, name string, size long, crc long, refused string, content binary", _members, "INVALID_ZIP")


def media_members(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``zip_members`` of office packages: only the media are unpacked, and of these only those of MOST_MEDIA bytes or less."""

    def media(data: bytes) -> Iterator[tuple]:
        return (row for row in _members(data, lambda n: "/media/" in n) if "/media/" in row[1])

    found = _expand(files, name, content, "ordinal int, name string, size long, crc long, refused string, content binary", media, "INVALID_ZIP")
    return found.withColumn("content", F.when(F.col("size") <= MOST_MEDIA, F.col("content")))


def archive_level(archives: DataFrame, depth: int) -> DataFrame:
    """(path, parent, depth, ordinal, content, skipped, error): members of ``archives`` (path, content), which lie ``depth - 1`` archives deep.

    Junk entries go; unsupported or refused ones are ``skipped`` with a reason; an archive nested deeper than
    ``MOST_DEPTH`` is a row with an error.
    """
    members = zip_members(archives)
    members = members.where(F.col("error").isNotNull() | ~is_junk(F.col("name")))
    skipped = F.when(F.col("name").isNotNull() & ~is_supported(F.col("name")), "unsupported file type").otherwise(F.col("refused"))
    deep = F.endswith(F.lower("name"), F.lit(".zip")) & skipped.isNull() & F.lit(depth == MOST_DEPTH)
    return members.select(
        F.concat_ws("/", "path", "name").alias("path"), F.col("path").alias("parent"), F.lit(depth).alias("depth"), "ordinal",
        F.when(skipped.isNull(), F.col("content")).alias("content"), skipped.alias("skipped"), F.when(deep, "ZIP_TOO_DEEP").otherwise(F.col("error")).alias("error"),
    )


def inner_archives(members: DataFrame) -> DataFrame:
    """(path, content) of the archives among the members of a level."""
    return members.where(F.lower("path").endswith(".zip") & F.col("content").isNotNull()).select("path", "content")


def expand_archives(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The members (``archive_level``) of archives and of archives in them, as one plan: an archive is unpacked once for each level below it."""
    level, found = files.select(F.col(name).cast("string").alias("path"), F.col(content).alias("content")), None
    for depth in range(1, MOST_DEPTH + 1):
        here = archive_level(level, depth)
        found = here if found is None else found.unionByName(here)
        level = inner_archives(here)
    return found


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_part(archive: Archive, part: str | zipfile.ZipInfo) -> bytes:
    """A part's bytes; where the package is read by ranges, a long one by a single request."""
    if isinstance(archive, PlainPackage):
        return archive.read(part)
    info = archive.getinfo(part) if isinstance(part, str) else part
    if info.file_size > MOST_ENTRY_BYTES:
        raise ValueError("larger than an entry may be")
    if hasattr(archive.fp, "want"):
        # The local header's length is told by the directory, but for its extra field.
        archive.fp.want(info.header_offset, info.header_offset + 30 + len(info.orig_filename.encode()) + 1_024 + info.compress_size)
    return archive.read(info)


def _xml(archive: Archive, part: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(read_part(archive, part)) if part in archive.NameToInfo else None


def _each(root: ElementTree.Element | None, tag: str) -> Iterator[ElementTree.Element]:
    end = "}" + tag
    return (e for e in (root.iter() if root is not None else ()) if e.tag == tag or e.tag.endswith(end))


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _resolve(part: str, target: str) -> str:
    """The part that a relation of ``part`` names."""
    steps = [] if target.startswith("/") else part.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            steps = steps[:-1]
        elif step not in ("", "."):
            steps = [*steps, step]
    return "/".join(steps)


@_remembered
def _relations(rels: bytes, part: str) -> tuple[tuple[str, str, str], ...]:
    inner = (r for r in _each(ElementTree.fromstring(rels), "Relationship") if r.get("TargetMode") != "External")
    return tuple((r.get("Id", ""), r.get("Type", "").rpartition("/")[2], _resolve(part, r.get("Target", ""))) for r in inner)


def relations(archive: Archive, part: str) -> list[tuple[str, str, str]]:
    """(id, kind, part) of each relation inside the package."""
    folder, _, leaf = part.rpartition("/")
    rels = f"{folder}/_rels/{leaf}.rels" if folder else f"_rels/{leaf}.rels"
    return list(_relations(read_part(archive, rels), part)) if rels in archive.NameToInfo else []


def _paragraph(p: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((e.text or "") if _local(e.tag) == "t" else marks.get(_local(e.tag), "") for e in p.iter())


def _word(archive: Archive) -> Iterator[tuple]:
    body = ElementTree.fromstring(read_part(archive, "word/document.xml"))
    media = sum(n.startswith("word/media/") for n in archive.namelist())
    charts = sum(kind == "chart" for _, kind, _ in relations(archive, "word/document.xml"))
    yield "\n\n".join(_paragraph(p) for p in _each(body, "p")).strip(), media, charts


def docx_text(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, text, n_images, n_charts, error): paragraphs parted by a blank line."""
    return _expand(files, name, content, "text string, n_images int, n_charts int", _opened(_word), "EXTRACTION_FAILED")


def _runs(root: ElementTree.Element | None) -> str:
    return " ".join(" ".join(e.text or "" for e in _each(root, "t")).split())


def _slides(archive: Archive) -> Iterator[tuple]:
    if "ppt/presentation.xml" not in archive.namelist() and not any(n.startswith("ppt/slides/") for n in archive.namelist()):
        raise ValueError("not a presentation")
    parts = sorted((int(m[1]), m[0]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, part in parts:
        linked = relations(archive, part)
        notes = [_runs(_xml(archive, target)) for _, kind, target in linked if kind == "notesSlide"]
        yield number, _runs(_xml(archive, part)), next(filter(None, notes), None), [t for _, kind, t in linked if kind == "image"], [t for _, kind, t in linked if kind == "chart"]


def pptx_slides(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, number, text, notes, pictures, charts, error) of each slide, by the number in its part's name."""
    return _expand(files, name, content, "number int, text string, notes string, pictures array<string>, charts array<string>", _opened(_slides), "EXTRACTION_FAILED")


def _points(e: ElementTree.Element | None) -> list[str]:
    found = [(int(p.get("idx", 0)), next((v.text or "" for v in _each(p, "v")), "")) for p in _each(e, "pt")]
    return [v for _, v in sorted(found, key=lambda p: p[0])]


def _charts(archive: Archive) -> Iterator[tuple]:
    for part in sorted(n for n in archive.namelist() if re.search(r"/charts/chart\d*\.xml$", n)):
        root = _xml(archive, part)
        kinds = "+".join(_local(e.tag) for e in root.iter() if _local(e.tag).endswith("Chart"))
        title = "".join(t.text or "" for e in list(_each(root, "title"))[:1] for t in _each(e, "t"))
        for i, ser in enumerate(_each(root, "ser")):
            tx, cat, val = (next(_each(ser, k), None) for k in ("tx", "cat", "val"))
            yield part, kinds, title or None, i, next(iter(_points(tx)), None), _points(cat), _points(val)


def chart_series(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, part, kind, title, series_no, series, categories, points, values, error): points in the order of their index.

    ``points`` are as written; ``values`` are numbers, null where a point is none.
    """
    found = _expand(files, name, content, "part string, kind string, title string, series_no int, series string, categories array<string>, points array<string>", _opened(_charts), "EXTRACTION_FAILED")
    return found.withColumn("values", F.transform("points", lambda p: p.try_cast("double")))


LETTERS = re.compile("[A-Z]*")


def column_number(cell: str) -> int:
    if "A" <= cell[:1] <= "Z" and cell[1:].isdigit():
        return ord(cell[0]) - 65
    at = 0
    for c in LETTERS.match(cell)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _cell(c: ElementTree.Element, shared: tuple[str, ...]) -> str:
    kind, value = c.get("t"), ""
    for v in c.iter():
        if v.tag == "v" or v.tag.endswith("}v"):
            value = v.text or ""
            break
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _each(c, "t"))
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value


@_remembered
def _strings(part: bytes) -> tuple[str, ...]:
    return tuple("".join(t.text or "" for t in _each(si, "t")) for si in _each(ElementTree.fromstring(part), "si"))


@_remembered
def _sheet_names(book: bytes) -> tuple[tuple[str | None, str | None], ...]:
    return tuple((sheet.get("name"), _attribute(sheet, "id")) for sheet in _each(ElementTree.fromstring(book), "sheet"))


def _sheet_rows(archive: Archive, most: int = MOST_SHEET_ROWS) -> Iterator[tuple]:
    sheets = _sheet_names(read_part(archive, "xl/workbook.xml"))
    targets = {i: part for i, _, part in relations(archive, "xl/workbook.xml")}
    shared = _strings(read_part(archive, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in archive.NameToInfo else ()
    for sheet_no, (name, key) in enumerate(sheets, 1):
        root = _xml(archive, targets.get(key, f"xl/worksheets/sheet{sheet_no}.xml"))
        for row_no, row in enumerate(_each(root, "row"), 1):
            if row_no > most:
                yield sheet_no, name, row_no, None
                break
            cells: list[str] = []
            for c in row.iter():
                if c.tag == "c" or c.tag.endswith("}c"):
                    at = column_number(c.get("r", ""))
                    if at > len(cells):
                        cells += [""] * (at - len(cells))
                    cells.append(_cell(c, shared))
            yield sheet_no, name, row_no, cells


def xlsx_rows(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells, error), ``MOST_SHEET_ROWS`` a sheet at most; gaps are empty cells.

    A sheet with more rows has one more row, whose cells are null: what ``sheet_warnings`` tells.
    """
    return _expand(files, name, content, "sheet_no int, sheet string, row_no int, cells array<string>", _opened(_sheet_rows), "EXTRACTION_FAILED")


def sheet_warnings(rows: DataFrame) -> DataFrame:
    """(path, warning) for each sheet that was cut."""
    cut = rows.where(F.col("error").isNull() & F.col("cells").isNull())
    return cut.select("path", F.concat(F.lit('Sheet "'), "sheet", F.lit(f'" cut at {MOST_SHEET_ROWS} rows.')).alias("warning"))


def _sheet_charts(archive: Archive) -> Iterator[tuple]:
    book = ElementTree.fromstring(read_part(archive, "xl/workbook.xml"))
    targets = {i: part for i, _, part in relations(archive, "xl/workbook.xml")}
    for number, sheet in enumerate(_each(book, "sheet"), 1):
        yield "sheet", number, sheet.get("name"), targets.get(_attribute(sheet, "id"), f"xl/worksheets/sheet{number}.xml")
    for name in archive.namelist():
        if re.fullmatch(r"xl/(worksheets|drawings)/_rels/[^/]*\.rels", name):
            part = name.replace("_rels/", "").removesuffix(".rels")
            yield from ((kind, 0, part, target) for _, kind, target in relations(archive, part) if kind in ("drawing", "chart"))


def _charts_of_sheets(archive: Archive) -> Iterator[tuple]:
    sheets, linked = [], {}
    for kind, number, source, target in _sheet_charts(archive):
        if kind == "sheet":
            sheets.append((number, source, target))
        else:
            linked.setdefault((kind, source), []).append(target)
    for number, sheet, part in sheets:
        for drawing in linked.get(("drawing", part), []):
            yield from ((number, sheet, chart) for chart in linked.get(("chart", drawing), []))


def sheet_charts(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, sheet_no, sheet, part): the charts of each sheet, by the package's relations: sheet to drawing, drawing to chart. A package is read once."""
    return _expand(files, name, content, "sheet_no int, sheet string, part string", _opened(_charts_of_sheets), "EXTRACTION_FAILED").where("error is null").drop("error")


def _properties(archive: Archive) -> Iterator[tuple]:
    for part in ("docProps/core.xml", "docProps/app.xml"):
        root = _xml(archive, part)
        for e in root if root is not None else ():
            if (text := (e.text or "").strip()) and _local(e.tag) in ("title", "creator", "subject", "created", "modified", "Application", "Pages", "Slides"):
                yield _local(e.tag), text


def office_properties(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, key, value, error) of a package's properties that are not empty."""
    return _expand(files, name, content, "key string, value string", _opened(_properties), "EXTRACTION_FAILED")


def chart_records(series: DataFrame) -> DataFrame:
    """(path, part, kind, title, series): one row a chart, from ``chart_series``; its series are in order."""
    one = F.struct("series_no", F.col("series").alias("name"), "categories", "values")
    held = series.where("error is null").groupBy("path", "part", "kind", "title").agg(F.array_sort(F.collect_list(F.struct("series_no", F.to_json(one).alias("s")))).alias("s"))
    return held.select("path", "part", "kind", "title", F.transform("s", lambda x: F.from_json(x["s"], "name string, categories array<string>, values array<double>")).alias("series"))


#: Kinds of parts that are packed already, and are stored as they are.
STORED = (".mp4", ".png", ".jpg", ".jpeg", ".zip")

#: What the head and the entry of a part share, and where an entry places it.
NAMED, PLACED = struct.Struct("<HHHHHLLLHH"), struct.Struct("<HHHLL")

#: Packages beyond these are written by ``zipfile``, in its 64-bit form where it must be.
MOST_PLAIN_PARTS, MOST_PLAIN_BYTES = 65_000, 512 * MB


@_remembered
def _packed(text: str, part: str) -> tuple[bytes, bytes, bytes]:
    """What head and entry of a part share, its name, and its packed bytes."""
    name, data = part.encode(), text.encode()
    method, packed = 0, data
    if not part.endswith(STORED):
        z = zlib.compressobj(6, zlib.DEFLATED, -15 if len(data) > 4_096 else -12, 8 if len(data) > 4_096 else 5)
        method, packed = 8, z.compress(data) + z.flush()
    # Version 2.0, names in UTF-8, 1980-01-01.
    return NAMED.pack(20, 0x800, method, 0, 33, zlib.crc32(data), len(packed), len(data), len(name), 0), name, packed


def pack(parts: list[tuple[str, str | None]]) -> bytes:
    """A ZIP package of parts (name, text)."""
    if len(parts) > MOST_PLAIN_PARTS or sum(len(t or "") for _, t in parts) > MOST_PLAIN_BYTES:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for part, text in parts:
                archive.writestr(zipfile.ZipInfo(part), (text or "").encode())
        return held.getvalue()
    body, directory, at = [], [], 0
    for part, text in parts:
        head, name, packed = _packed(text or "", part)
        body += [b"PK\3\4", head, name, packed]
        directory += [b"PK\1\2\x14\0", head, PLACED.pack(0, 0, 0, 0, at), name]
        at += 30 + len(name) + len(packed)
    listed = b"".join(directory)
    return b"".join([*body, listed, END.pack(b"PK\5\6", 0, 0, len(parts), len(parts), len(listed), at, 0)])


def _entries(maps: pa.MapArray) -> Iterator[list[tuple[str, str | None]]]:
    """(name, text) of each map; of nulls none. The strings of all maps are made at once, for which Arrow takes a twentieth of the time."""
    ends = maps.offsets.to_pylist()
    names, texts = (side[ends[0] : ends[-1]].to_numpy(zero_copy_only=False).tolist() for side in (maps.keys, maps.items))
    for a, b, known in zip(ends, ends[1:], maps.is_valid().to_pylist()):
        yield list(zip(names[a - ends[0] : b - ends[0]], texts[a - ends[0] : b - ends[0]])) if known else []


def build_packages(rows: DataFrame, name: Column, parts: Column) -> DataFrame:
    """(path, content): a package of each row; ``parts`` is a map of part names to text. The inverse of the readers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                some = batch.slice(a, 100)
                made = [pack(p) for p in _entries(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.select(name.cast("string").alias("path"), parts.alias("parts")).mapInArrow(run, "path string, content binary")
