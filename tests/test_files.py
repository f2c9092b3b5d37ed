"""Readers of files on odd input."""

import io
import json
import random
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions.images import image_size, model_size
from paperloom.sources import packages, pdf
from paperloom.sources.delimited import delimited_cells, parse_texts
from paperloom.sources.reader import read_documents
from paperloom.streaming.folder import stream_folder


def _zip(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, data in entries.items():
            archive.writestr(name, data)
    return held.getvalue()


def parse_delimited(text, delimiter=","):
    return parse_texts(pa.array([text]), delimiter).to_pylist()[0]


def _plain(text, delimiter):
    """Rows of cells, a character at a time."""
    rows, row, cell, quoted, at = [], [], "", False, 0
    while at < len(text):
        c, at = text[at], at + 1
        if c == '"':
            if quoted and text[at : at + 1] == '"':
                cell, at = cell + '"', at + 1
            else:
                quoted = not quoted
        elif quoted or c not in (delimiter, "\r", "\n"):
            cell += c
        else:
            row.append(cell)
            cell = ""
            if c != delimiter:
                at += text[at - 1 : at + 1] == "\r\n"
                rows.append(row)
                row = []
    return [*rows, [*row, cell]] if cell or row else rows


def test_delimited_texts_as_one_buffer(spark):
    draw = random.Random(5)
    some = lambda: None if draw.random() < 0.1 else "".join(draw.choices('"",;\r\naé😀 ', k=draw.randrange(16)))
    for _ in range(2_000):
        texts, mark = [some() for _ in range(draw.randrange(6))], draw.choice(",;")
        want = [None if t is None else _plain(t, mark) for t in texts]
        assert parse_texts(pa.array(["x", *texts], pa.string())[1:], mark).to_pylist() == want == parse_texts(pa.array(texts, pa.string()), mark).to_pylist(), texts
    texts = [some() for _ in range(300)] + ['"' * 100_001 + ",\n" * 100_000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", delimited_cells(F.col("t")).alias("cells")).collect()
    assert {r.i: r.cells for r in rows} == {i: None if t is None else _plain(t, ",") for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        parse_texts(pa.array(["a"]), "ab")


def test_delimited_states():
    assert parse_delimited('name,note\n"Smith, J","said ""hi""\nthen left"\nLee,ok\n') == [["name", "note"], ["Smith, J", 'said "hi"\nthen left'], ["Lee", "ok"]]
    assert parse_delimited("a\tb\n1\t2", "\t") == [["a", "b"], ["1", "2"]]
    assert parse_delimited("a\r\n\r\nb\rc,") == [["a"], [""], ["b"], ["c", ""]]
    assert parse_delimited("") == [] and parse_delimited('x"y,z"w') == [["xy,zw"]]


def test_archives(spark):
    deep = _zip({"deep.txt": "x"})
    for _ in range(3):
        deep = _zip({"in.zip": deep})
    rows = [("a.zip", _zip({"good.txt": "fine", "tool.exe": "x", "__MACOSX/._p.png": "x", "in/b.zip": _zip({"c.md": "# c"})})), ("bad.zip", b"no zip"), ("null.zip", None), ("deep.zip", deep)]
    got = {r.path: r for r in packages.expand_archives(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert bytes(got["a.zip/good.txt"].content) == b"fine" and got["a.zip/tool.exe"].skipped == "unsupported file type" and got["a.zip/tool.exe"].content is None
    assert bytes(got["a.zip/in/b.zip/c.md"].content) == b"# c" and got["a.zip/in/b.zip/c.md"].depth == 2 and "a.zip/__MACOSX/._p.png" not in got
    assert got["bad.zip"].error == got["null.zip"].error == "INVALID_ZIP"
    assert got["deep.zip/in.zip/in.zip/in.zip"].error == "ZIP_TOO_DEEP" and got["deep.zip/in.zip"].error is None


def test_refusals():
    assert list(packages.refusals([(packages.MOST_ENTRY_BYTES + 1, 5), (11 * packages.MB, 1), (5, 5)])) == ["larger than an entry may be", "packed too tightly", None]
    assert list(packages.refusals([(190 * packages.MB, 190 * packages.MB)] * 6)) == [None] * 5 + ["archive unpacks to too much"]


def test_broken_packages(spark):
    rows = spark.createDataFrame([("a", b"x"), ("b", None), ("c", _zip({"other.xml": "<a/>"}))], "path string, content binary")
    for read in (packages.docx_text, packages.pptx_slides, packages.xlsx_rows):
        assert {(r.path, r.error) for r in read(rows).collect()} == {(p, "EXTRACTION_FAILED") for p in "abc"}
        assert read(rows.limit(0)).count() == 0


def test_image_sizes(spark):
    webp = lambda chunk, rest: b"RIFF\0\0\0\0WEBP" + chunk + rest + bytes(20)
    rows = [
        (1, webp(b"VP8X", bytes(8) + (319).to_bytes(3, "little") + (239).to_bytes(3, "little")), 320, 240), (2, webp(b"VP8 ", bytes(10) + (64).to_bytes(2, "little") + (32).to_bytes(2, "little")), 64, 32),
        (3, webp(b"VP8L", bytes(4) + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")), 100, 50), (4, b"short", None, None), (5, None, None, None), (6, b"\xff\xd8\xff" + bytes(40), None, None),
    ]
    got = spark.createDataFrame([r[:2] for r in rows], "id int, content binary").select("id", image_size(F.col("content")).alias("s")).collect()
    assert {r.id: (r.s and r.s.width, r.s and r.s.height) for r in got} == {r[0]: r[2:] for r in rows}
    assert tuple(spark.range(1).select(model_size(F.lit(4000), F.lit(1000)).alias("s")).head().s) == (2000, 500)


def _pdf(content, packed=False):
    body = zlib.compress(content) if packed else content
    head = b"<< /Length %d%s >>" % (len(body), b" /Filter /FlateDecode" if packed else b"")
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n3 0 obj << /Type /Page /Resources << /XObject << /I 5 0 R >> >> /Contents [4 0 R] >> endobj\n4 0 obj " + head + b"\nstream\n" + body + b"\nendstream endobj 5 0 obj << /Subtype /Image >> endobj"


def test_pdf_pages(spark):
    content = rb"BT /F 9 Tf (a \(b\) (c)\051) Tj [(wo) -20 (rd) -300 (next)] TJ <41 42> Tj ET 0 0 5 5 re f /I Do"
    rows = [("raw", _pdf(content)), ("flate", _pdf(content, True)), ("no", b"x"), ("none", None), ("secret", _pdf(content) + b"/Encrypt")]
    got = {r.path: r for r in pdf.pdf_pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    for k in ("raw", "flate"):
        assert (got[k].number, got[k].text, got[k].images, got[k].paths, got[k].needs_vision) == (1, "a (b) (c)) word next AB", 1, 1, True)
    assert {got[k].error for k in ("no", "none", "secret")} == {"EXTRACTION_FAILED"}


def test_read_documents(spark):
    deck = _zip({"ppt/slides/slide1.xml": "<s><t>one</t></s>", "ppt/slides/slide2.xml": "<s><t>two</t></s>"})
    rows = [("a.txt", b"hi"), ("b.html", b"<p>x</p>"), ("c.pdf", _pdf(b"(page) Tj")), ("d.pptx", deck), ("e.docx", b"x"), ("f.doc", b"x"), ("g.bin", b"x"), ("h.txt", None)]
    got = {r.path: (r.kind, r.text, r.units, r.error) for r in read_documents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"] == ("text", "hi", 1, None) and got["b.html"][1] == "x" and got["c.pdf"] == ("pdf", "page", 1, None)
    assert got["d.pptx"] == ("pptx", "one\n\ntwo", 2, None) and got["e.docx"][3] == "EXTRACTION_FAILED" and got["f.doc"][3] == "LEGACY_OFFICE_FORMAT"
    assert got["g.bin"][3] == "UNSUPPORTED_FILE_TYPE" and got["h.txt"][3] == "EXTRACTION_FAILED" and len(got) == len(rows)


def test_stream_folder(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.txt").write_text("one")
    (landing / "bad.docx").write_text("x")
    run = lambda: stream_folder(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "state")).awaitTermination(120)
    assert run()
    (landing / "copy.txt").write_text("one")
    assert run()
    lines = {d["path"].rsplit("/", 1)[1]: d for f in (tmp_path / "out").rglob("part-*") for d in map(json.loads, f.read_text().splitlines())}
    assert {k: (d.get("text"), d.get("error"), d["cached"]) for k, d in lines.items()} == {"a.txt": ("one", None, False), "bad.docx": (None, "EXTRACTION_FAILED", False), "copy.txt": ("one", None, True)}
