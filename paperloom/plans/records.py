"""Queries over parts of documents, the comparison of providers and the cache, each with its SQL.

They register in the dictionaries of ``catalogue``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import detect, text
from paperloom.operators import analysis, comparison, records, relational
from paperloom.options import Options
from paperloom.plans.catalogue import _EXT_SQL, _NAMED_SQL, _named, query, spread
from paperloom.plans.files import OFFICE, PACKED, RELS, _entry, _text
from paperloom.sources import cache, delimited, folder_source, listing, packages, sinks
from paperloom.streaming.folder import PROGRESS, admitted, stream_progress

FIRST, SECOND = "north", "south"


@query("documents", "SELECT doc_id, text FROM documents")
def xml_decoded(documents: DataFrame) -> DataFrame:
    """References of all kinds become what they stand for."""
    coded = F.col("text")
    for sign, said in (("&", "&amp;"), ("<", "&#60;"), (">", "&gt;"), ("e", "&#101;"), ("a", "&#x61;"), ("\n", "&#xA;")):
        coded = F.replace(coded, F.lit(sign), F.lit(said)) if sign != "a" else F.regexp_replace(coded, "(?<!&)a(?!mp;)", said)
    return documents.select("doc_id", text.decode_xml(coded).alias("text"))


@query("documents", f"SELECT doc_id, CASE {_EXT_SQL} WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' END AS mime, {_EXT_SQL} = 'xls' AS needs_converter FROM {_NAMED_SQL}")
def picture_mime(documents: DataFrame) -> DataFrame:
    return _named(documents).select("doc_id", detect.mime_of_name(F.col("name")).alias("mime"), detect.needs_converter(detect.detect_type(F.col("name"), F.lit(None).cast("string"), F.lit(None).cast("binary"))).alias("needs_converter"))


@query("conversations", """SELECT conv_id, '| turn | role |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || turn || ' | ' || role || ' |', chr(10) ORDER BY turn) AS markdown,
  'turn role ' || string_agg(turn || ' ' || role, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def delimited_document(conversations: DataFrame) -> DataFrame:
    """A delimited file as a Markdown table, and the table's text."""
    lines = F.array_sort(F.collect_list(F.struct("turn", _text(F.col("turn"), ',"', F.col("role"), '"').alias("line"))))
    files = conversations.groupBy("conv_id").agg(lines.alias("l")).select("conv_id", F.concat(F.lit("turn,role\r\n"), F.array_join("l.line", "\r\n")).alias("raw"))
    tables = files.withColumn("cells", delimited.delimited_cells(F.col("raw"))).withColumn("markdown", text.md_table(F.col("cells")))
    return tables.select("conv_id", "markdown", text.table_text(F.col("markdown")).alias("text"))


_SHOWN_SQL = "(SELECT l_orderkey, l_linenumber, min(l_partkey) % 7 AS part, min(l_suppkey) % 5 AS other FROM lineitem GROUP BY ALL)"
_SLIDES_SQL = f"""WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, UNNEST(list_distinct([part, other + 3])) AS p FROM {_SHOWN_SQL} WHERE l_linenumber % 4 > 0),
  f AS (SELECT o, n, p, p % 3 = 0 AS worth, min(n) OVER (PARTITION BY o, p) = n AS first FROM s WHERE p < 6),
  g AS (SELECT o, n, count(*) FILTER (worth AND first) AS fresh, bool_or(worth) AS worth FROM f GROUP BY o, n)"""


def _slides(lineitem: DataFrame) -> DataFrame:
    """Orders as decks: line numbers are slides with two pictures at most (none on each fourth), parts from 0 to 7."""
    lineitem = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    pictures = F.when(F.col("l_linenumber") % 4 > 0, F.array_distinct(F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 5 + 3))).otherwise(F.array().cast("array<bigint>"))
    return lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("number"), F.transform(pictures, lambda p: p.cast("string")).alias("pictures"))


def _media(lineitem: DataFrame) -> DataFrame:
    """Records of parts 0 to 5 of each order; those that 3 divides are worth a look."""
    orders = lineitem.select(F.col("l_orderkey").alias("path")).distinct()
    return orders.select("path", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p")).select("path", F.col("p").cast("string").alias("part"), (F.col("p") % 3 == 0).alias("needs_vision"))


@query("lineitem", f"""{_SLIDES_SQL} SELECT l.o AS l_orderkey, l.n AS number, coalesce(fresh > 0, false) AS needs_vision,
  CASE WHEN fresh > 0 THEN fresh || ' picture(s) to analyse' WHEN worth THEN 'pictures already covered on an earlier slide' WHEN worth IS NOT NULL THEN 'only icon-sized or unreadable pictures' ELSE 'text and native charts only' END AS reason
  FROM (SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem GROUP BY ALL) l LEFT JOIN g USING (o, n)""")
def slide_verdicts(lineitem: DataFrame) -> DataFrame:
    found = records.slide_verdicts(_slides(lineitem), _media(lineitem))
    return found.select(F.col("path").alias("l_orderkey"), "number", "needs_vision", "reason")


@query("lineitem", f"{_SLIDES_SQL} SELECT o AS l_orderkey, p::VARCHAR AS part, min(n) AS section FROM s GROUP BY o, p")
def first_slides(lineitem: DataFrame) -> DataFrame:
    return records.first_slides(_slides(spread(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey"))).select(F.col("path").alias("l_orderkey"), "part", "section")


@query("conversations", """SELECT conv_id, sum(length(text) + 1)::BIGINT - 1 AS characters, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words, count(*)::BIGINT AS sections, count(*)::BIGINT AS images,
  count(*) FILTER (turn % 3 > 0)::BIGINT AS unique_images, 1::BIGINT AS charts, count(*) FILTER (turn % 2 = 0)::BIGINT AS sections_needing_vision, count(*) FILTER (turn % 3 > 0 AND turn % 4 = 1)::BIGINT AS images_needing_vision FROM conversations GROUP BY conv_id""")
def record_stats(conversations: DataFrame) -> DataFrame:
    section = F.struct("turn", "text", (F.col("turn") % 2 == 0).alias("needs_vision"), F.when(F.col("turn") % 3 == 0, "img-1").alias("duplicate_of"), (F.col("turn") % 4 == 1).alias("worth"))
    held = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    pictures = F.transform("s", lambda x: F.struct(x["duplicate_of"].alias("duplicate_of"), x["worth"].alias("needs_vision")))
    return held.select("conv_id", records.document_stats(F.array_join("s.text", "\n"), F.col("s"), pictures, F.array(F.lit(1))).alias("r")).select("conv_id", "r.*")


@query("conversations", """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN string_agg('[Page ' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn) WHEN conv_id % 3 = 1 THEN string_agg('[Slide ' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn) ELSE 'body' END AS text FROM conversations GROUP BY conv_id""")
def labelled_text(conversations: DataFrame) -> DataFrame:
    kind = F.when(F.col("conv_id") % 3 == 0, "pdf").when(F.col("conv_id") % 3 == 1, "pptx").otherwise("docx")
    held = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("number"), "text"))).alias("s"))
    return held.select("conv_id", records.labelled_text(kind, F.col("s"), F.lit("body")).alias("text"))


@query("documents", """SELECT doc_id, 'pdf' || CASE WHEN doc_id % 3 > 0 THEN ', ' || doc_id % 3 || ' pages' ELSE '' END || ', ' || n_chars || ' words' || CASE WHEN doc_id % 2 > 0 THEN ', 1 images' ELSE '' END AS line FROM documents""")
def summary_line(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", records.describe(F.lit("pdf"), {"pages": F.col("doc_id") % 3, "images": F.col("doc_id") % 2}, F.col("n_chars")).alias("line"))


_IMAGE_PROMPT, _PAGE_PROMPT = "Look at this picture: its text, charts, diagrams, tables and photos. ", ". Read its text and look at each chart, table and picture. "


@query("documents", f"""SELECT doc_id, '{_IMAGE_PROMPT}Where it is from: ' || source || '. ' || a.asked AS picture,
  'This is a page of "' || source || '", page ' || doc_id || '{_PAGE_PROMPT}' || CASE WHEN text <> '' THEN 'Its text layer, which may be incomplete: \"\"\"' || substring(text, 1, {analysis.HINT}) || '\"\"\". ' ELSE '' END || a.asked AS page
  FROM documents, (SELECT '{analysis._asked()}' AS asked) a""")
def model_prompts(documents: DataFrame) -> DataFrame:
    label = F.concat(F.lit("page "), F.col("doc_id").cast("string"))
    return documents.select("doc_id", analysis.image_prompt(F.col("source")).alias("picture"), analysis.page_prompt(F.col("source"), label, F.col("text")).alias("page"))


@query("conversations", """SELECT conv_id, turn, turn % 3 < 2 AS parsed, CASE turn % 3 WHEN 0 THEN 'said ' || turn ELSE '' END AS summary, CASE turn % 3 WHEN 0 THEN 2 ELSE 0 END AS elements, CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE 'low' END AS confidence,
  CASE turn % 3 WHEN 2 THEN 'the reply is no JSON' END AS notes FROM conversations""")
def reply_records(conversations: DataFrame) -> DataFrame:
    whole = F.concat(F.lit('Here: ```json\n{"summary": "said '), F.col("turn").cast("string"), F.lit('", "visual_elements": [{"type": "chart"}, {}], "confidence": "high"}\n``` done'))
    raw = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, '{"summary": ""}').otherwise(F.concat(F.lit("no "), F.translate("text", "{}`", "")))
    return conversations.select("conv_id", "turn", analysis.parse_reply(raw).alias("r")).select("conv_id", "turn", "r.parsed", "r.summary", "r.elements", "r.confidence", "r.notes")


def _analyses(conversations: DataFrame) -> DataFrame:
    """Turns as analyses: two turns in a row are what two providers say of one picture."""
    turn = F.col("turn")
    return conversations.select(
        F.concat(F.lit("in/file-"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("file"), F.floor(turn / 2).cast("int").alias("visual_no"), F.when(turn % 2 == 0, FIRST).otherwise(SECOND).alias("provider"),
        F.concat(F.lit("p"), F.floor(turn / 2).cast("string")).alias("label"), (turn % 5 > 0).alias("parsed"), F.when(F.length("text") % 3 == 0, "low").otherwise("high").alias("confidence"), F.length("text").cast("long").alias("latency"),
        F.when(turn % 3 == 0, turn).cast("long").alias("tokens_in"), turn.cast("long").alias("tokens_out"), F.when(turn % 4 > 0, F.length("text") % 4).cast("int").alias("elements"), (turn % 2).cast("int").alias("tables"),
        F.substring("text", 1, 5).alias("summary"), F.col("text").alias("extracted_text"), F.when(turn % 2 == 0, "").otherwise("look").alias("notes"), F.when(F.length("text") % 7 == 0, "ECONNRESET").alias("error"),
    )


def _truth(conversations: DataFrame) -> DataFrame:
    """Words to be found for each third file."""
    files = conversations.where("conv_id % 3 = 0").select("conv_id").distinct()
    return files.select(F.concat(F.lit("file-"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("name"), F.array(*map(F.lit, ["The", "Der", "zzz"])).alias("keywords"))


_SIDES_SQL = """a AS (SELECT 'in/file-' || conv_id || '.pdf' AS file, conv_id, (turn // 2)::INT AS visual_no, turn % 2 AS side, turn, text, turn % 5 > 0 AS parsed, CASE WHEN length(text) % 3 = 0 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN turn % 4 > 0 THEN length(text) % 4 ELSE 0 END AS elements, CASE WHEN length(text) % 7 = 0 THEN 'ECONNRESET' END AS error,
  CASE WHEN conv_id % 3 = 0 THEN floor(len(list_filter(['the', 'der', 'zzz'], lambda k: contains(lower(substring(text, 1, 5) || ' ' || text), k)))::DOUBLE / 3 * 1000 + 0.5) / 1000 END AS recall,
  list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)) AS words FROM conversations),
  v AS (SELECT file, visual_no, max(CASE WHEN side = 0 THEN recall END) AS first_recall, max(CASE WHEN side = 1 THEN recall END) AS second_recall, coalesce(max(words) FILTER (side = 0), []) AS x, coalesce(max(words) FILTER (side = 1), []) AS y FROM a GROUP BY file, visual_no),
  w AS (SELECT file, visual_no, first_recall, second_recall, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE floor(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) * 1000 + 0.5) / 1000 END::DOUBLE AS agreement FROM v)"""
_TOTALS_SQL = f"""{_SIDES_SQL}, m AS (SELECT side, count(*)::BIGINT AS analyses, floor(avg(parsed::INT) * 1000 + 0.5) / 1000 AS parse_rate, floor(avg(length(text)) * 1000 + 0.5) / 1000 AS latency, floor(avg(elements) * 1000 + 0.5) / 1000 AS elements,
  floor(avg(turn % 2) * 1000 + 0.5) / 1000 AS tables, floor(avg(recall) * 1000 + 0.5) / 1000 AS recall, count(*) FILTER (confidence = 'low')::BIGINT AS n_low FROM a GROUP BY side),
  t AS (SELECT CASE side WHEN 0 THEN '{FIRST}' ELSE '{SECOND}' END AS provider, m.* EXCLUDE (side), agreement, visuals, files FROM m, (SELECT floor(avg(agreement) * 1000 + 0.5) / 1000 AS agreement, count(*)::BIGINT AS visuals, count(DISTINCT file)::BIGINT AS files FROM w))"""


@query("conversations", f"""WITH {_SIDES_SQL} SELECT file, visual_no, 'p' || visual_no AS label, CASE WHEN side = 0 THEN '{FIRST}' ELSE '{SECOND}' END AS provider, CASE WHEN error IS NOT NULL THEN 'request error: ' || error WHEN NOT parsed THEN 'response was not valid JSON' ELSE 'model reported low confidence' END AS reason,
  CASE WHEN side = 1 THEN 'look' END AS notes FROM a WHERE error IS NOT NULL OR NOT parsed OR confidence = 'low'""")
def failure_cases(conversations: DataFrame) -> DataFrame:
    return comparison.failure_cases(_analyses(conversations))


def _visuals(conversations: DataFrame) -> DataFrame:
    return comparison.with_recall(comparison.compare_visuals(_analyses(conversations), FIRST, SECOND), _truth(conversations))


@query("conversations", f"WITH {_SIDES_SQL} SELECT * FROM w")
def compared_visuals(conversations: DataFrame) -> DataFrame:
    return _visuals(conversations).select("file", "visual_no", "first_recall", "second_recall", "agreement")


@query("conversations", f"WITH {_TOTALS_SQL} SELECT * FROM t")
def compared_totals(conversations: DataFrame) -> DataFrame:
    return comparison.comparison_totals(_visuals(conversations), FIRST, SECOND)


_ADVICE_SQL = f"""WITH {_TOTALS_SQL}, x AS (SELECT * FROM t WHERE provider = '{FIRST}'), y AS (SELECT * FROM t WHERE provider = '{SECOND}')
  SELECT CASE WHEN coalesce(x.recall, 0) >= coalesce(y.recall, 0) THEN '{FIRST}' ELSE '{SECOND}' END || ' recalled more of the expected facts ({FIRST} ' || x.recall || ', {SECOND} ' || y.recall || ')' AS accuracy,
  CASE WHEN x.parse_rate = y.parse_rate THEN 'both were equally reliable' WHEN x.parse_rate > y.parse_rate THEN '{FIRST} was more reliable' ELSE '{SECOND} was more reliable' END || ' at valid JSON ({FIRST} ' || x.parse_rate || ', {SECOND} ' || y.parse_rate || ')' AS reliability,
  'visual elements a picture ({FIRST} ' || x.elements || ', {SECOND} ' || y.elements || '), tables ({FIRST} ' || x.tables || ', {SECOND} ' || y.tables || ')' AS depth, 'agreement of the extracted texts ' || x.agreement AS consistency FROM x, y"""


@query("conversations", _ADVICE_SQL)
def comparison_advice(conversations: DataFrame) -> DataFrame:
    return comparison.recommendation(comparison.comparison_totals(_visuals(conversations), FIRST, SECOND), FIRST, SECOND)


@query("conversations", f"""WITH {_SIDES_SQL} SELECT '| file-' || conv_id || '.pdf | ' || CASE WHEN side = 0 THEN '{FIRST}' ELSE '{SECOND}' END || ' | ' || floor(avg(parsed::INT) * 1000 + 0.5) / 1000 || ' | ' || floor(sum(length(text))::DOUBLE / count(*) + 0.5)::BIGINT || ' | ' || floor(avg(elements) * 1000 + 0.5) / 1000 || ' | '
  || floor(avg(turn % 2) * 1000 + 0.5) / 1000 || ' | ' || count(*) FILTER (error IS NOT NULL OR NOT parsed OR confidence = 'low') || ' |' AS line FROM a GROUP BY conv_id, side""")
def report_rows(conversations: DataFrame) -> DataFrame:
    """The lines of a report that tell of files; ``report_lines`` has the head too."""
    told = _analyses(conversations)
    totals = comparison.comparison_totals(_visuals(conversations), FIRST, SECOND)
    return comparison.report_lines(totals, comparison.recommendation(totals, FIRST, SECOND), comparison.file_summaries(told), FIRST, SECOND).where("place.part = 3").select("line")


@query("conversations", "SELECT a.conv_id, a.turn AS page, b.text AS hint FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def page_hints(conversations: DataFrame) -> DataFrame:
    visuals = conversations.select(F.col("conv_id").alias("path"), F.col("turn").alias("page"))
    sections = conversations.select(F.col("conv_id").alias("path"), (F.col("turn") - 1).alias("number"), "text")
    return analysis.page_hints(visuals, sections).select(F.col("path").alias("conv_id"), "page", "hint")


def _cache(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    entries = documents.select("doc_id", F.when(F.col("doc_id") % 11 > 0, F.md5("text")).alias("key"), "text")
    kept = entries.where("doc_id % 4 = 0").select("key", F.length("text").alias("result"), F.lit(None).cast("string").alias("error"))
    return entries, kept


_CACHE_SQL = "e AS (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN md5(text) END AS key, text FROM documents), k AS (SELECT DISTINCT key FROM e WHERE doc_id % 4 = 0 AND key IS NOT NULL)"


@query("documents", f"WITH {_CACHE_SQL} SELECT doc_id, coalesce(key IN (SELECT key FROM k), false) AS cached FROM e")
def cached_entries(documents: DataFrame) -> DataFrame:
    return listing.with_cached(*_cache(documents)).select("doc_id", "cached")


def _through(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    entries, kept = _cache(documents)
    read = lambda rows: rows.withColumn("result", F.length("text")).withColumn("error", F.when(F.col("result") < 100, "EXTRACTION_FAILED"))
    return listing.read_through(entries, kept, read)


@query("documents", f"WITH {_CACHE_SQL} SELECT doc_id, length(text) AS result, coalesce(key IN (SELECT key FROM k), false) AS cached, CASE WHEN length(text) < 100 AND NOT coalesce(key IN (SELECT key FROM k), false) THEN 'EXTRACTION_FAILED' END AS error FROM e")
def read_through_cache(documents: DataFrame) -> DataFrame:
    return _through(documents)[0].select("doc_id", "result", "cached", "error")


@query("documents", f"""WITH {_CACHE_SQL}, r AS (SELECT coalesce(key IN (SELECT key FROM k), false) AS hit, length(text) < 100 AS short FROM e)
  SELECT count(*)::BIGINT AS total, count(*) FILTER (hit OR NOT short)::BIGINT AS done, count(*) FILTER (short AND NOT hit)::BIGINT AS failed, count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses FROM r""")
def folder_progress(documents: DataFrame) -> DataFrame:
    return listing.progress(_through(documents)[0])


@query("customer", "SELECT c_custkey, n AS sheet_no, 'S' || n AS sheet, 'xl/charts/chart' || n || '.xml' AS part FROM customer, (SELECT UNNEST([1, 2]) AS n) WHERE n <= 1 + c_custkey % 2")
def sheet_charts(customer: DataFrame) -> DataFrame:
    """Workbooks of one or two sheets, each with a drawing that shows a chart."""
    n = F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 2 + 1).cast("int")))
    sheets = spread(customer.select("c_custkey"), "c_custkey", each=PACKED).select("c_custkey", n.alias("n"))
    rel = lambda kind, place, target: _text(f'<Relationship Id="r', F.col("n"), f'" Type="{OFFICE}/{kind}" Target="', place, F.col("n"), target, '"/>')
    whole = lambda x: F.concat(F.lit(RELS), x, F.lit("</Relationships>"))
    parts = F.array(
        _entry(_text("xl/worksheets/_rels/sheet", F.col("n"), ".xml.rels"), whole(rel("drawing", "../drawings/drawing", ".xml"))),
        _entry(_text("xl/drawings/_rels/drawing", F.col("n"), ".xml.rels"), whole(rel("chart", "../charts/chart", ".xml"))),
    )
    tag = _text('<sheet name="S', F.col("n"), '" r:id="r', F.col("n"), '"/>')
    books = sheets.groupBy("c_custkey").agg(F.flatten(F.collect_list(parts)).alias("e"), F.array_sort(F.collect_list(F.struct("n", tag.alias("t")))).alias("tags"), F.array_join(F.collect_list(rel("worksheet", "worksheets/sheet", ".xml")), "").alias("links"))
    book = F.concat(F.lit(f'<workbook xmlns:r="{OFFICE}"><sheets>'), F.array_join("tags.t", ""), F.lit("</sheets></workbook>"))
    first = F.array(_entry(F.lit("xl/workbook.xml"), book), _entry(F.lit("xl/_rels/workbook.xml.rels"), whole(F.col("links"))))
    files = packages.build_packages(books, F.col("c_custkey"), F.map_from_entries(F.concat(first, "e")))
    return packages.sheet_charts(files).select(F.col("path").cast("long").alias("c_custkey"), "sheet_no", "sheet", "part")


@query("documents", "SELECT doc_id, CASE WHEN length(text) % 2 = 0 AND n_chars > 2000 THEN 'range' ELSE 'buffer' END AS strategy, doc_id % 3 = 0 AS rendered, CASE WHEN doc_id % 5 = 0 THEN n_chars ELSE doc_id END AS calls FROM documents")
def read_plan(documents: DataFrame) -> DataFrame:
    """How a file is read, which pages are drawn, how many looks a document takes."""
    return documents.select(
        "doc_id", listing.read_strategy(F.col("n_chars"), F.length("text") % 2 == 0, Options(range_threshold=2_000)).alias("strategy"), records.should_render(F.col("doc_id") % 3 == 0, "auto").alias("rendered"),
        records.vision_calls(F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("docx"), F.col("n_chars"), F.col("doc_id")).alias("calls"),
    )


@query("documents", "SELECT source AS folder, doc_id::VARCHAR AS id, doc_id || '.txt' AS name, n_chars AS size, doc_id // 50 AS page FROM documents WHERE n_chars > 1000 AND doc_id IS NOT NULL AND source IS NOT NULL")
def folder_listing(documents: DataFrame) -> DataFrame:
    """Listings of folders, in pages of 1,000 ids (few files), written as JSON lines and read by the data source, which applies the filter."""
    spark = documents.sparkSession
    root = sinks.scratch_folder(spark, "listing")
    entries = documents.where("doc_id is not null and source is not null").select(F.col("source").alias("folder"), F.expr("doc_id div 1000").alias("page"), F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("text/plain").alias("mimeType"), F.col("n_chars").cast("string").alias("size"), F.col("doc_id").alias("at"),
    )).alias("value"))
    entries.repartition("folder", "page").write.partitionBy("folder", "page").text(root)
    folder_source.register(spark)
    found = spark.read.format("paperloom_folder").option("root", root).load().where("size > 1000 and error is null")
    return found.select("folder", "id", "name", "size", (F.col("id").cast("long") - F.pmod(F.col("id").cast("long"), F.lit(50))).alias("at")).select("folder", "id", "name", "size", F.expr("at div 50").alias("page"))


@query("documents", """SELECT source AS run, n AS total, n - lost AS done, lost AS failed, hit AS hits, n - hit AS misses
 FROM (SELECT source, count(*) AS n, count_if(doc_id % 7 = 0)::BIGINT AS lost, count_if(doc_id % 3 = 0)::BIGINT AS hit FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source)""")
def running_progress(documents: DataFrame) -> DataFrame:
    """The last row of each run of a stateful stream over a line for each document, taken in several batches."""
    spark = documents.sparkSession
    folder = sinks.scratch_folder(spark, "progress")
    rows = documents.where("source is not null and doc_id is not null")
    sizes = rows.groupBy(F.col("source").alias("run")).agg(F.count("*").alias("total"))
    lines = rows.select(F.col("source").alias("run"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 3 == 0).alias("cached"), F.when(F.col("doc_id") % 7 == 0, "EXTRACTION_FAILED").alias("error")).join(sizes, "run")
    lines.select(F.to_json(F.struct("run", "total", "path", "cached", "error")).alias("value")).repartition(4).write.text(f"{folder}/results")
    stream_progress(spark, f"{folder}/results", f"{folder}/out", f"{folder}/checkpoint", files_a_batch=2).awaitTermination()
    told = spark.read.text(f"{folder}/out").select(F.from_json("value", PROGRESS).alias("r")).select("r.*").where("type = 'done'")
    return told.select("run", "total", "done", "failed", "hits", "misses")


_LANDED_SQL = "(SELECT source || '/' || doc_id // 60 || '/' || doc_id || '.txt' AS path, source || '/' || doc_id // 60 AS request, n_chars AS length FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND n_chars IS NOT NULL)"


@query("documents", f"""SELECT path, length, CASE WHEN length > 2000 THEN 'FILE_TOO_LARGE' WHEN row_number() OVER (PARTITION BY request, length > 2000 ORDER BY path) > 5 THEN 'TOO_MANY_FILES' END AS refused FROM {_LANDED_SQL}""")
def landing_admitted(documents: DataFrame) -> DataFrame:
    """Documents as landed files, 60 ids of a source as a request: which are admitted, under limits of 5 files a request and 2,000 bytes a file."""
    named = documents.where("source is not null and doc_id is not null and n_chars is not null")
    landed = named.select(F.concat_ws("/", "source", F.expr("doc_id div 60"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("n_chars").alias("length"))
    return admitted(landed, Options(most_bytes=2_000, most_files=5))


@query("documents", """WITH k AS (SELECT md5(text) AS key, min(doc_id) AS id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)
  SELECT key, CASE WHEN id % 5 = 0 THEN 2 * id WHEN id % 3 = 1 OR id % 6 = 0 THEN -id ELSE id END AS result FROM k WHERE id % 5 = 0 OR id % 3 < 2""")
def cache_upserts(documents: DataFrame) -> DataFrame:
    """The cache table after three runs, the first one tried twice, with a compaction before the last: a row a key, of its latest run."""
    spark, schema = documents.sparkSession, "key string, result long"
    root = sinks.scratch_folder(spark, "cache")
    held = documents.where("text is not null and doc_id is not null").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("result"))
    first = held.where("result % 3 = 0")
    for rows, run in ((first.where("result % 2 = 0"), "1"), (first, "1"), (held.where("result % 3 = 1 or result % 6 = 0").withColumn("result", -F.col("result")), "2")):
        cache.upsert(rows, root, run)
    cache.compact(spark, root, schema)
    cache.upsert(held.where("result % 5 = 0").withColumn("result", 2 * F.col("result")), root, "3")
    return cache.current(spark, root, schema).select("key", "result")
