"""Whole records of files of each type."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import detect, text
from paperloom.operators import records
from paperloom.sources import packages, sinks
from paperloom.sources.reader import read_documents, to_analyse

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, data in entries.items():
            archive.writestr(name, data)
    return held.getvalue()


def _png(width, height, tail=b""):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4) + b"IHDR" + width.to_bytes(4) + height.to_bytes(4) + bytes(8) + tail


def _rels(*links):
    return RELS.format("".join(f'<Relationship Id="r{i}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(links)))


CHART = "<c:chartSpace xmlns:c='c' xmlns:a='a'><c:chart><c:title><a:t>Sales</a:t></c:title><c:barChart><c:ser><c:tx><c:pt idx='0'><c:v>2024</c:v></c:pt></c:tx><c:cat><c:pt idx='1'><c:v>B</c:v></c:pt><c:pt idx='0'><c:v>A</c:v></c:pt></c:cat><c:val><c:pt idx='0'><c:v>1.5</c:v></c:pt><c:pt idx='1'><c:v>x</c:v></c:pt></c:val></c:ser></c:barChart></c:chart></c:chartSpace>"
CORE = "<p xmlns:dc='dc'><dc:title>Deck</dc:title><dc:subject></dc:subject><dc:creator>Kim</dc:creator></p>"


def _deck():
    slide = lambda t: f"<s xmlns:a='a'><a:t>{t}</a:t></s>"
    big, icon = _png(200, 100), _png(20, 20)
    return _zip({
        "docProps/core.xml": CORE,
        "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/slide3.xml": slide("three"), "ppt/slides/slide10.xml": slide("ten"),
        "ppt/slides/_rels/slide1.xml.rels": _rels(("image", "../media/a.png"), ("notesSlide", "../notesSlides/n1.xml"), ("chart", "../charts/chart1.xml")),
        "ppt/slides/_rels/slide2.xml.rels": _rels(("image", "../media/a.png"), ("image", "../media/icon.png")),
        "ppt/slides/_rels/slide3.xml.rels": _rels(("image", "../media/icon.png"), ("image", "../media/none.png")),
        "ppt/notesSlides/n1.xml": slide("say this"), "ppt/charts/chart1.xml": CHART,
        "ppt/media/a.png": big, "ppt/media/icon.png": icon, "ppt/media/again.png": big, "ppt/media/film.mp4": b"0" * 50,
    })


def _book():
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="One" r:id="r0"/><sheet name="Two" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml")),
        "xl/worksheets/sheet1.xml": "<w><row><c r='A1'><v>1</v></c><c r='B1' t='inlineStr'><is><t>a|b</t></is></c></row><row><c r='A2'><v>2</v></c></row></w>",
        "xl/worksheets/sheet2.xml": "<w>" + "".join(f"<row><c r='A{i}'><v>{i}</v></c></row>" for i in range(1, packages.MOST_SHEET_ROWS + 3)) + "</w>",
        "xl/worksheets/_rels/sheet2.xml.rels": _rels(("drawing", "../drawings/drawing1.xml")), "xl/drawings/_rels/drawing1.xml.rels": _rels(("chart", "../charts/chart1.xml")),
        "xl/charts/chart1.xml": CHART,
    })


@pytest.fixture(scope="module")
def found(spark):
    word = _zip({"word/document.xml": "<w><p><t>First</t></p><p><t>Second</t></p></w>", "word/_rels/document.xml.rels": _rels(("chart", "charts/chart1.xml")), "word/charts/chart1.xml": CHART, "word/media/a.png": _png(60, 60)})
    inner = _zip({"deep.txt": "deep words", "pic.png": _png(90, 90)})
    rows = [
        ("a.csv", b'x,y\r\n1,"p|q"\r\n2'), ("b.tsv", "﻿k\tv\nä\tb".encode()), ("c.json", b'{"a": [1, "\xc3\xa9"]}'), ("d.json", b"{nope"), ("e.md", b"# T\n\n[l](u) *x*"), ("f.htm", b"<p>One</p><p>Two &amp; 3</p>"),
        ("g.pptx", _deck()), ("h.docx", word), ("i.xlsx", _book()), ("j.png", _png(640, 480)), ("k.gif", b"GIF89a" + (10).to_bytes(2, "little") + (9).to_bytes(2, "little") + bytes(20)), ("l.xls", b"x"),
        ("m.zip", _zip({"t.txt": "words here", "in/n.zip": inner, "tool.exe": b"x", "bad.docx": b"x", "__MACOSX/x.txt": "j"})), ("n.zip", _zip({"tool.exe": b"x"})), ("o.zip", b"no"),
    ]
    df = read_documents(spark.createDataFrame(rows, "path string, content binary")).cache()
    return df, {r.path: r for r in df.collect()}


def test_text_family(found):
    _, r = found
    assert r["a.csv"].markdown == "| x | y |\n| --- | --- |\n| 1 | p\\|q |\n| 2 |  |" and r["a.csv"].text == "x y 1 p\\ q 2"
    assert r["b.tsv"].markdown.startswith("| k | v |") and "ä b" in r["b.tsv"].text
    assert r["c.json"].text == '{\n  "a": [\n    1,\n    "é"\n  ]\n}' and r["c.json"].markdown == f"```json\n{r['c.json'].text}\n```" and not r["c.json"].warnings
    assert r["d.json"].text == "{nope" and r["d.json"].markdown is None and len(r["d.json"].warnings) == 1
    assert r["e.md"].text == "T\n\nl x" and r["e.md"].markdown.startswith("# T") and r["f.htm"].text == "One\n\nTwo & 3"
    assert r["a.csv"].sections[0].reason == "text file" and r["a.csv"].stats.sections == 1 and r["f.htm"].stats.words == 4


def test_slides(found):
    _, r = found
    deck = r["g.pptx"]
    assert deck.text == "one\nNotes: say this\n\ntwo\n\nthree\n\nten" and [s.number for s in deck.sections] == [1, 2, 3, 10] and deck.units == 4
    assert [(s.needs_vision, s.reason) for s in deck.sections] == [(True, "1 picture(s) to analyse"), (False, "pictures already covered on an earlier slide"), (False, "only icon-sized or unreadable pictures"), (False, "text and native charts only")]
    assert [(p.id, p.name, p.section, p.duplicate_of, p.reason) for p in deck.images] == [("img-1", "a.png", 1, None, "embedded picture"), ("img-2", "icon.png", 2, None, "icon-sized"), ("img-3", "again.png", None, "img-1", "same image as img-1"), ("img-4", "film.mp4", None, None, "format a vision model cannot read")]
    chart = deck.charts[0]
    assert (chart.kind, chart.title, chart.section, chart.series[0].name, chart.series[0].categories, chart.series[0]["values"]) == ("barChart", "Sales", 1, "2024", ["A", "B"], [1.5, None])
    assert deck.metadata == {"title": "Deck", "creator": "Kim"} and (deck.stats.images, deck.stats.unique_images, deck.stats.images_needing_vision, deck.stats.sections_needing_vision) == (4, 3, 1, 1)


def test_words_sheets_pictures(found):
    _, r = found
    assert r["h.docx"].text == "First\n\nSecond" and len(r["h.docx"].images) == 1 and r["h.docx"].charts[0].title == "Sales" and r["h.docx"].images[0].width == 60
    book = r["i.xlsx"]
    assert book.units == 2 and book.markdown.startswith("## One\n\n| 1 | a\\|b |\n| --- | --- |\n| 2 |  |\n\n## Two") and book.warnings == [f'Sheet "Two" cut at {packages.MOST_SHEET_ROWS} rows.']
    assert book.charts[0].section == 2 and book.sections[1].text.count("\n") == packages.MOST_SHEET_ROWS and book.sections[0].title == "One"
    assert (r["j.png"].images[0].width, r["j.png"].sections[0].needs_vision, r["j.png"].text) == (640, True, "") and r["k.gif"].sections[0].reason == "icon-sized"
    assert r["l.xls"].error == "NEEDS_MARKITDOWN"


def test_archives(found):
    _, r = found
    top = r["m.zip"]
    assert top.text == "## m.zip/t.txt\n\nwords here\n\n## m.zip/in/n.zip\n\n## m.zip/in/n.zip/deep.txt\n\ndeep words"
    assert [(s.number, s.title, s.needs_vision, s.reason) for s in top.sections] == [(1, "m.zip/t.txt", False, "see child document"), (2, "m.zip/in/n.zip", True, "see child document"), (3, "m.zip/bad.docx", False, "could not be read")]
    assert top.warnings == ["skipped m.zip/tool.exe: unsupported file type"] and r["n.zip"].warnings[0] == "Archive had no supported files in it." and r["o.zip"].error == "INVALID_ZIP"


def test_what_goes_to_the_analysis(found, tmp_path):
    df, r = found
    got = {x.path: x.text for x in to_analyse(df).collect()}
    assert got["g.pptx"] == "[Slide 1] one\n\n[Slide 2] two\n\n[Slide 3] three\n\n[Slide 10] ten" and not {"m.zip", "l.xls"} & set(got)
    line = df.where("path = 'g.pptx'").select(records.describe(F.col("kind"), {"slides": F.col("units"), "files": F.lit(0), "images": F.col("stats.images"), "charts": F.col("stats.charts")}, F.col("stats.words")).alias("d"), records.preview(F.col("sections"), 2, 3).alias("p"), records.vision_calls(F.col("kind"), F.lit(9), F.lit(1)).alias("v")).head()
    assert (line.d, line.p, line.v) == ("pptx, 4 slides, 7 words, 4 images, 1 charts", ["one", "two"], 1)
    sinks.write_documents(df.where("kind = 'text'"), str(tmp_path / "out"), provider=F.lit("p"))
    names = {p.parent.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("part-*.txt")}
    assert names["name=a.csv"]["text"] == r["a.csv"].text and names["name=a.csv"]["error"] is None and len(names) == 6


def test_visuals_and_rendering(spark):
    media = records.register_media(packages.media_members(spark.createDataFrame([("d/g.pptx", _deck())], "path string, content binary")), "ppt/media/")
    assert [(r.label, r.mime) for r in records.visuals_of(media).collect()] == [("g.pptx - a.png", "image/png")]
    got = spark.createDataFrame([(True,), (False,), (None,)], "v boolean").select(*[records.should_render(F.col("v"), p).alias(p) for p in ("all", "none", "auto")]).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (True, False, False), (True, False, False)]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.decode_xml(F.lit("&#65;&#x1F600; &lt;a&gt; &amp;lt; & &bad; &#x110000;")).alias("x"), text.pick_defined(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(""), F.lit("c"), F.lit(None))).alias("m"),
        detect.mime_of_name(F.lit("x/Y.JPEG")).alias("j"), detect.mime_of_name(F.lit("a.svg")).alias("s"), detect.mime_of_name(F.lit("png")).alias("p"), detect.folder_id_error(F.lit(" ")).alias("e1"), detect.folder_id_error(F.lit("a b")).alias("e2"), detect.folder_id_error(F.lit(" ok_-1 ")).alias("e3"),
    ).head()
    assert row.x == "A😀 <a> &lt; & &bad; &#x110000;" and row.m == {"a": "1"} and (row.j, row.s, row.p) == ("image/jpeg", None, "image/png")
    assert (row.e1, row.e2, row.e3) == ("MISSING_DRIVE_FOLDER", "INVALID_DRIVE_FOLDER", None)


def test_numbers_within_a_large_group(spark):
    df = spark.range(2_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(F.lit(None)).alias("g"), F.lit(1).alias("_n0"))
    got = records.number_within(df, "g", "id", "number", 7).collect()
    want = {}
    for r in sorted(got, key=lambda r: r.id):
        want[r.g] = want.get(r.g, 0) + 1
        assert r.number == want[r.g]
    assert len(got) == 2_000
