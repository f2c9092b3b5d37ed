"""Queries that turn the driver's tables into files and read these again, each with its SQL.

They register in the dictionaries of ``catalogue``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import images
from paperloom.options import Options
from paperloom.plans.catalogue import query, spread
from paperloom.sources import delimited, packages, pdf, reader, sinks

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
#: Rows that a task packs into files and reads again, about.
PACKED = 50_000
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _escaped(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _entry(name: Column, text: Column) -> Column:
    return F.struct(name.alias("name"), text.alias("text"))


def _long(path: Column) -> Column:
    return path.cast("long")


@query("conversations", """SELECT conv_id, turn AS row_no, UNNEST([0, 1]) AS col_no, UNNEST([role, text]) AS value FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)""")
def delimited_cells(conversations: DataFrame) -> DataFrame:
    conversations = spread(conversations, "conv_id", each=PACKED)
    files = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", _text(F.col("role"), ',"', F.replace("text", F.lit('"'), F.lit('""')), '"').alias("line")))).alias("l"))
    rows = delimited.delimited_rows(files.select("conv_id", F.array_join(F.col("l.line"), "\r\n").alias("text")), "conv_id", "text")
    return rows.select("conv_id", F.col("row_no").cast("long").alias("row_no"), F.posexplode("cells").alias("col_no", "value"))


@query("conversations", "SELECT conv_id, turn || '.txt' AS name, strlen(text)::BIGINT AS size, md5(text) AS md5 FROM conversations")
def archive_members(conversations: DataFrame) -> DataFrame:
    entries = spread(conversations, "conv_id", each=PACKED).groupBy("conv_id").agg(F.collect_list(_entry(_text(F.col("turn"), ".txt"), F.col("text"))).alias("e"))
    files = packages.build_packages(entries, F.col("conv_id"), F.map_from_entries("e"))
    return packages.zip_members(files).select(_long(F.col("path")).alias("conv_id"), "name", "size", F.md5("content").alias("md5"))


@query("documents", "SELECT doc_id, trim(replace(text, chr(10), chr(10) || chr(10)), ' ' || chr(9) || chr(10)) AS text FROM documents")
def word_text(documents: DataFrame) -> DataFrame:
    body = F.array_join(F.transform(F.split(_escaped(F.col("text")), "\n"), lambda p: _text('<w:p><w:r><w:t xml:space="preserve">', p, "</w:t></w:r></w:p>")), "")
    document = _text('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>', body, "</w:body></w:document>")
    files = packages.build_packages(documents, F.col("doc_id"), F.create_map(F.lit("word/document.xml"), document))
    return packages.docx_text(files).select(_long(F.col("path")).alias("doc_id"), "text")


@query("conversations", r"SELECT conv_id, turn + 1 AS number, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, role AS notes FROM conversations")
def presentation_slides(conversations: DataFrame) -> DataFrame:
    return packages.pptx_slides(_decks(conversations)).select(_long(F.col("path")).alias("conv_id"), F.col("number").cast("long").alias("number"), "text", "notes")


def _decks(conversations: DataFrame, *more: Column) -> DataFrame:
    """(path, content): a deck of each conversation, a slide with notes for a turn; ``more``: further entries."""
    number = (F.col("turn") + 1).cast("string")
    slide = lambda t: _text('<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>', _escaped(t), "</a:t></a:r></a:p></p:sp></p:sld>")
    parts = F.array(
        _entry(_text("ppt/slides/slide", number, ".xml"), slide(F.col("text"))),
        _entry(_text("ppt/slides/_rels/slide", number, ".xml.rels"), _text(f'{RELS}<Relationship Id="r1" Type="{OFFICE}/notesSlide" Target="../notesSlides/notesSlide', number, '.xml"/></Relationships>')),
        _entry(_text("ppt/notesSlides/notesSlide", number, ".xml"), slide(F.col("role"))),
    )
    decks = spread(conversations, "conv_id", each=PACKED).groupBy("conv_id").agg(F.flatten(F.collect_list(parts)).alias("e"))
    return packages.build_packages(decks, F.col("conv_id"), F.map_from_entries(F.concat("e", F.array(*more)) if more else F.col("e")))


#: Characters of the film in each deck of ``ranged_decks``: far more than its text.
FILM = 400_000


@query("conversations", r"SELECT conv_id, turn + 1 AS number, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, role AS notes, 'range' AS strategy, TRUE AS under_quarter FROM conversations")
def ranged_decks(conversations: DataFrame) -> DataFrame:
    """Decks with a large film are written as files and read by ranges: text and notes are whole, and under a quarter of each file is fetched."""
    noise = F.repeat(F.sha2(F.col("conv_id").cast("string"), 256), FILM // 64)  # films are stored, not packed
    files = _decks(conversations, _entry(F.lit("ppt/media/film.mp4"), noise))
    spark = conversations.sparkSession
    written = sinks.write_files(files.withColumn("path", F.concat("path", F.lit(".pptx"))), sinks.scratch_folder(spark, "decks"))
    found = reader.read_paths(written, options=Options(range_threshold=0, block=8 << 10)).join(written, "path")
    quarter = (F.col("fetched") * 4 < F.col("length")).alias("under_quarter")
    slides = found.select(F.regexp_extract("path", r"(\d+)\.pptx$", 1).cast("long").alias("conv_id"), "strategy", quarter, F.explode("sections").alias("s"))
    return slides.select("conv_id", F.col("s.number").cast("long").alias("number"), "s.text", "s.notes", "strategy", "under_quarter")


@query("orders", """SELECT o_orderkey, UNNEST([1, 2]) AS row_no, UNNEST([[o_orderstatus, '', o_orderpriority], [o_orderkey::VARCHAR, 'TRUE', o_orderstatus]]) AS cells FROM orders""")
def sheet_rows(orders: DataFrame) -> DataFrame:
    orders, key = spread(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", each=PACKED), F.col("o_orderkey")
    shared = _text("<sst><si><t>", _escaped(F.col("o_orderstatus")), "</t></si><si><r><t>", F.substring("o_orderpriority", 1, 2), "</t></r><r><t>", F.substring("o_orderpriority", 3, 99), "</t></r></si></sst>")
    sheet = _text('<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>', key, '</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>', F.col("o_orderstatus"), "</t></is></c></row></sheetData></worksheet>")
    book = F.lit(f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="One" sheetId="1" r:id="r7"/></sheets></workbook>')
    rels = F.lit(f'{RELS}<Relationship Id="r7" Type="{OFFICE}/worksheet" Target="worksheets/first.xml"/></Relationships>')
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": shared, "xl/worksheets/first.xml": sheet}
    files = packages.build_packages(orders, key, F.create_map(*[c for name, text in parts.items() for c in (F.lit(name), text)]))
    return packages.xlsx_rows(files).select(_long(F.col("path")).alias("o_orderkey"), "row_no", "cells")


@query("lineitem", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS point, l_linenumber::VARCHAR AS category, l_quantity AS value FROM lineitem""")
def chart_points(lineitem: DataFrame) -> DataFrame:
    point = lambda c: _text('<c:pt idx="', F.col("at"), '"><c:v>', F.col(c), "</c:v></c:pt>")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lineitem = spread(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey", each=PACKED)
    charts = lineitem.withColumn("at", at).groupBy("l_orderkey").agg(F.array_join(F.collect_list(point("l_linenumber")), "").alias("cat"), F.array_join(F.collect_list(point("l_quantity")), "").alias("val"))
    chart = _text('<c:chartSpace xmlns:c="c"><c:chart><c:barChart><c:ser><c:cat><c:strCache>', F.col("cat"), "</c:strCache></c:cat><c:val><c:numCache>", F.col("val"), "</c:numCache></c:val></c:ser></c:barChart></c:chart></c:chartSpace>")
    files = packages.build_packages(charts, F.col("l_orderkey"), F.create_map(F.lit("xl/charts/chart1.xml"), chart))
    pairs = packages.chart_series(files).select(F.col("path"), F.posexplode(F.arrays_zip("categories", "values")).alias("point", "p"))
    return pairs.select(_long(F.col("path")).alias("l_orderkey"), F.col("point").cast("long").alias("point"), F.col("p.categories").alias("category"), F.col("p.values").alias("value"))


@query("part", "SELECT p_partkey, (p_size * 7)::INT AS width, (p_partkey % 4000 + 1)::INT AS height FROM part")
def image_sizes(part: DataFrame) -> DataFrame:
    width, height = (F.col("p_size") * 7).cast("int"), (F.col("p_partkey") % 4000 + 1).cast("int")
    big = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    little = lambda n, size: F.concat(*[F.substring(big(n, size), 2 * i + 1, 2) for i in reversed(range(size))])
    heads = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4)),
        F.concat(F.lit("474946383961"), little(width, 2), little(height, 2)),
        F.concat(F.lit("424D" + "00" * 16), little(width, 4), little(height, 4)),
        F.concat(F.lit("FFD8FFE00004" + "0000" + "FFC0001108"), big(height, 2), big(width, 2)),
    ]
    content = F.unhex(F.concat(F.element_at(F.array(*heads), (F.col("p_partkey") % len(heads) + 1).cast("int")), F.lit("00" * 24)))
    return part.select("p_partkey", images.image_size(content).alias("s")).select("p_partkey", "s.width", "s.height")


@query("conversations", r"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 40 AS needs_vision FROM conversations")
def pdf_page_text(conversations: DataFrame) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    files = conversations.groupBy("conv_id").agg(pdf.pdf_file(F.transform(turns, lambda t: t["text"])).alias("content"))
    return pdf.pdf_pages(files, "conv_id").select(_long(F.col("path")).alias("conv_id"), F.col("number").cast("long").alias("number"), "text", "needs_vision")
