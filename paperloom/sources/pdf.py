"""Pages of PDF files: text, and how many pictures and paths a page paints.

Objects are found by scanning, so files without a usable cross-reference table
are read too; of an object that is defined twice the last one counts. Streams
are raw or Flate; other filters give a page without text. Strings are read by
the font's ToUnicode map, else as Windows-1252. An encrypted file, one without
pages and null bytes give one row with ``error``. ``MOST_PAGES`` a file at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import pdf_date
from paperloom.functions.triage import page_verdict
from paperloom.sources.packages import _expand

MOST_PAGES = 500
#: A gap in a shown array that parts words, in thousandths of the font's size.
WORD_GAP = -200

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb">>\s*stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = regex.compile(
    rb"(?P<inline>\bBI\s.*?\sID\s.*?\sEI\b)|(?P<lit>\((?:[^()\\]++|\\.|(?&lit))*+\))|<<|>>|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<name>/[^\s/<>\[\]()]+)|(?P<num>[-+]?\d*\.?\d+)|(?P<sign>[\[\]])|(?P<op>[A-Za-z'\"]+\*?)",
    regex.DOTALL,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(head: bytes, body: bytes) -> bytes:
    if b"/FlateDecode" in head:
        return zlib.decompressobj().decompress(body)
    return b"" if b"/Filter" in head else body


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Dictionary and stream of each object."""
    found, at = {}, 0
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        end = len(data) if end < 0 else end
        head, body = data[m.end() : end], b""
        if s := _STREAM.search(data, m.end(), end):
            head = data[m.end() : s.start() + 2]
            n = re.search(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R)", head)
            stop = s.end() + int(n[1]) if n else data.find(b"endstream", s.end())
            body = data[s.end() : stop if stop >= 0 else end]
            end = max(s.end(), data.find(b"endobj", max(stop, s.end())))
        found[int(m[1])] = head, body
        at = end
    for head, body in list(found.values()):
        if b"/ObjStm" in head:
            packed, first = _inflated(head, body), int(re.search(rb"/First\s+(\d+)", head)[1])
            places = list(map(int, packed[:first].split()))
            ends = [*places[3::2], len(packed) - first]
            for number, a, b in zip(places[::2], places[1::2], ends):
                found.setdefault(number, (packed[first + a : first + b], b""))
    return found


def _entry(objects: dict, head: bytes, key: bytes) -> bytes:
    """The dictionary or array that ``key`` holds or refers to."""
    m = re.search(key + rb"(?![A-Za-z])\s*", head)
    if not m:
        return b""
    if r := _REF.match(head, m.end()):
        return objects.get(int(r[1]), (b"", b""))[0]
    depth, at = 0, m.end()
    for t in re.finditer(rb"<<|>>|\[|\]", head[at:]):
        depth += 1 if t[0] in (b"<<", b"[") else -1
        if depth <= 0:
            return head[at : at + t.end()]
    return head[at:]


def _leaves(objects: dict, number: int, seen: set[int], resources: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
    """(dictionary, resources) of the pages below a node of the page tree, in order."""
    if number in seen or number not in objects:
        return
    seen.add(number)
    head = objects[number][0]
    resources = _entry(objects, head, b"/Resources") or resources
    if b"/Kids" in head:
        for kid in _REF.findall(_entry(objects, head, b"/Kids")):
            yield from _leaves(objects, int(kid), seen, resources)
    else:
        yield head, resources


def _unicode_map(objects: dict, font: bytes) -> list[tuple[int, int, int, bytes]]:
    """(bytes of a code, first code, last code, UTF-16 of the first) of a font's ToUnicode map."""
    m = re.search(rb"/ToUnicode\s+(\d+)", font)
    cmap = _inflated(*objects.get(int(m[1]), (b"", b""))) if m else b""
    ranges = []
    for kind, block in re.findall(rb"beginbf(char|range)(.*?)endbf", cmap, re.DOTALL):
        codes = [bytes.fromhex(x.decode()) for x in re.findall(rb"<([0-9A-Fa-f]+)>", block)]
        step = 2 if kind == b"char" else 3
        for k in range(0, len(codes) - step + 1, step):
            ranges.append((len(codes[k]), int.from_bytes(codes[k]), int.from_bytes(codes[k + step - 2]), codes[k + step - 1]))
    return ranges


def _shown(raw: bytes, ranges: list[tuple[int, int, int, bytes]]) -> str:
    if not ranges:
        return raw.decode("cp1252", "replace")
    width, out = ranges[0][0], []
    for k in range(0, len(raw), width):
        code = int.from_bytes(raw[k : k + width])
        for _, a, b, first in ranges:
            if a <= code <= b:
                out.append((int.from_bytes(first) + code - a).to_bytes(len(first)))
                break
    return b"".join(out).decode("utf-16-be", "replace")


def _literal(raw: bytes) -> bytes:
    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, raw[1:-1], flags=re.DOTALL)


def _page(objects: dict, head: bytes, resources: bytes) -> tuple[str, int, int]:
    """Text, pictures and paths of a page."""
    refs = [m[1]] if (m := re.search(rb"/Contents\s+(\d+)\s+\d+\s+R", head)) else []
    if refs and not objects.get(int(refs[0]), (b"", b"x"))[1]:
        refs = _REF.findall(objects.get(int(refs[0]), (b"", b""))[0]) or refs
    refs = refs or _REF.findall(_entry(objects, head, b"/Contents"))
    content = b"\n".join(_inflated(*objects[int(r)]) for r in refs if int(r) in objects)
    fonts = {n: _unicode_map(objects, objects.get(int(r), (b"", b""))[0]) for n, r in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", _entry(objects, resources, b"/Font"))}
    forms = {n for n, r in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", _entry(objects, resources, b"/XObject")) if b"/Image" not in objects.get(int(r), (b"", b""))[0]}
    items, shown, name, font, images, paths = [], "", b"", [], 0, 0
    for t in _TOKEN.finditer(content):
        if t["inline"]:
            images += 1
        elif t["lit"]:
            shown += _shown(_literal(t["lit"]), font)
        elif t["hex"] is not None:
            digits = b"".join(t["hex"].split()).decode()
            shown += _shown(bytes.fromhex(digits + "0" * (len(digits) % 2)), font)
        elif t["name"]:
            name = t["name"]
        elif t["num"]:
            shown += " " if shown and float(t["num"]) < WORD_GAP else ""
        elif op := t["op"]:
            if op in (b"Tj", b"TJ", b"'", b'"'):
                items.append(shown)
            elif op == b"Tf":
                font = fonts.get(name, [])
            elif op == b"Do":
                images += name not in forms
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                paths += 1
            shown = ""
    return " ".join(" ".join(items).split()), images, paths


def _pages(data: bytes) -> Iterator[tuple]:
    if not data or b"%PDF" not in data[:1024] or b"/Encrypt" in data:
        raise ValueError("not a PDF file that can be read")
    objects = _objects(data)
    roots = [int(m[1]) for head, _ in objects.values() if re.search(rb"/Type\s*/Catalog\b", head) and (m := re.search(rb"/Pages\s+(\d+)", head))]
    pages = list(_leaves(objects, roots[-1], set())) if roots else []
    if not pages:
        raise ValueError("no pages")
    for number, (head, resources) in enumerate(pages[:MOST_PAGES], 1):
        yield number, *_page(objects, head, resources)


def pdf_pages(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, number, text, images, paths, needs_vision, reason, error) of each page."""
    pages = _expand(files, name, content, "number int, text string, images int, paths int", _pages, "EXTRACTION_FAILED")
    return pages.withColumn("v", page_verdict(F.col("text"), F.col("images"), F.col("paths"))).select("path", "number", "text", "images", "paths", "v.needs_vision", "v.reason", "error")


#: What a file's information dictionary is asked for.
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


def _info(data: bytes) -> Iterator[tuple]:
    objects = _objects(data or b"")
    m = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", (data or b"")[::-1][:4096][::-1]) or re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data or b"")
    head = objects.get(int(m[1]), (b"", b""))[0] if m else b""
    for key in INFO:
        found = re.search(rb"/" + key.encode() + rb"\s*(?:(\((?:[^()\\]|\\.)*\))|<([0-9A-Fa-f\s]*)>)", head, re.DOTALL)
        if found:
            raw = _literal(found[1]) if found[1] else bytes.fromhex(b"".join(found[2].split()).decode().ljust(2, "0"))
            text = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")
            if text.strip():
                yield key, text.strip()


def pdf_metadata(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, key, value, error) of what the information dictionary says; dates in ISO form."""
    found = _expand(files, name, content, "key string, value string", _info, "EXTRACTION_FAILED")
    return found.withColumn("value", F.when(F.col("key").endswith("Date"), pdf_date(F.col("value"))).otherwise(F.col("value")))


def pdf_file(pages: Column) -> Column:
    """The bytes of a PDF file of an array of page texts; the inverse of ``pdf_pages``."""
    obj = lambda n, x: F.concat(n.cast("string"), F.lit(" 0 obj\n"), x, F.lit("\nendobj\n"))
    stream = lambda x: F.concat(F.lit("<< /Length "), F.length(x).cast("string"), F.lit(" >>\nstream\n"), x, F.lit("\nendstream"))
    number = lambda i: F.lit(5) + 2 * i
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    kids = F.array_join(F.transform(pages, lambda t, i: F.concat(number(i).cast("string"), F.lit(" 0 R"))), " ")
    leaf = lambda i: F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents "), (number(i) + 1).cast("string"), F.lit(" 0 R >>"))
    text = lambda t: F.concat(F.lit("BT /F1 12 Tf <"), F.hex(F.encode(t, "UTF-16BE")), F.lit("> Tj ET"))
    body = F.array_join(F.transform(pages, lambda t, i: F.concat(obj(number(i), leaf(i)), obj(number(i) + 1, stream(text(t))))), "")
    first = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.concat(F.lit("<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), F.size(pages).cast("string"), F.lit(" >>")), F.lit("<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"), stream(F.lit(cmap))]
    return F.encode(F.concat(F.lit("%PDF-1.7\n"), *[obj(F.lit(k), x) for k, x in enumerate(first, 1)], body, F.lit("trailer << /Root 1 0 R >>\n%%EOF\n")), "UTF-8")
