"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import detect, reply, text, triage
from paperloom.operators import records, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows and bytes that Spark sends to Python at once, so that a worker's memory does not follow the size of the input.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, each: int = 200_000) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as leave about ``each`` rows to one, twice the cores at least.

    Spark would choose by bytes alone: too few tasks for work that is slow for its bytes, and tasks that grow up to a fixed size.
    """
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)), *keys)


def query(table: str, sql: str) -> Callable:
    """Registers a function of a table's DataFrame under its own name, with its SQL."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_table(spark, sf_dir, t) for t in table.split()])
        ORACLES[f.__name__] = sql
        return f

    return register


_HTML_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'gi'), '<!--[\s\S]*?-->', ' ', 'g'), '<br\s*/?>', chr(10), 'gi'),
    '</(p|div|li|tr|h[0-9]|table|ul|ol|section|article)>', chr(10) || chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""


@query("pages", f"SELECT page_id, {_HTML_SQL} AS text FROM pages")
def html_to_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("pages", f"""SELECT page_id, text, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words, length(text) < 40 AS needs_vision,
  CASE WHEN length(text) = 0 THEN 'no text layer - scanned or image-only' WHEN length(text) < 40 THEN 'very little text - likely scanned' ELSE 'text layer present (graphics not inspected)' END AS vision_reason
  FROM (SELECT page_id, {_HTML_SQL} AS text FROM pages)""")
def html_doc_stats(pages: DataFrame) -> DataFrame:
    found = pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))
    verdict = triage.page_verdict(F.col("text"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    return found.select("page_id", "text", text.utf16_length(F.col("text")).alias("characters"), text.word_count(F.col("text")).alias("words"), verdict["needs_vision"].alias("needs_vision"), verdict["reason"].alias("vision_reason"))


_MD_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*\|?\s*:?-{3,}.*$', '', 'g'), '(?m)^#{1,6}\s+', '', 'g'),
  '[*_`>]+', '', 'g'), '\s*\|\s*', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""


@query("documents", f"SELECT doc_id, {_MD_SQL} AS text FROM documents")
def md_to_text(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text.markdown_to_text(F.col("text")).alias("text"))


@query("documents", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_ws(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text.normalize_ws(F.col("text")).alias("text"))


@query("documents", r"SELECT doc_id, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS words, n_chars FROM documents")
def doc_stats(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text.utf16_length(F.col("text")).alias("characters"), text.word_count(F.col("text")).alias("words"), "n_chars")


@query("documents", """SELECT doc_id, length(text) < 40 OR doc_id % 3 > 0 OR n_chars % 50 >= 25 AS needs_vision,
  CASE WHEN length(text) = 0 THEN 'no text layer - scanned or image-only' WHEN length(text) < 40 THEN 'very little text - likely scanned' WHEN doc_id % 3 > 0 THEN (doc_id % 3) || ' image(s) on page'
  WHEN n_chars % 50 >= 25 THEN 'vector graphics - likely a chart or diagram' ELSE 'text only' END AS reason FROM documents""")
def page_triage(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", triage.page_verdict(F.col("text"), (F.col("doc_id") % 3).cast("int"), (F.col("n_chars") % 50).cast("int")).alias("v")).select("doc_id", "v.needs_vision", "v.reason")


_NAMES = ["report.pdf", "memo.DOCX", "deck.pptx", "sheet.xlsx", "old.xls", "old.doc", "photo.JPEG", "bundle.zip", "notes.md", "tool.exe", "noext", ".pdf", "__MACOSX/._a.png", "a/Thumbs.db", "page.htm"]
_MIMES = ["application/pdf", "text/plain; charset=utf-8", "image/tiff", "application/octet-stream", "application/vnd.google-apps.document", "application/vnd.google-apps.folder", "application/vnd.google-apps.form"]


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAMED_SQL = f"(SELECT doc_id, {_sql_list(_NAMES)}[(doc_id % {len(_NAMES)} + 1)::INT] AS name, {_sql_list(_MIMES)}[(doc_id // {len(_NAMES)} % {len(_MIMES)} + 1)::INT] AS mime FROM documents)"
_EXT_SQL = r"lower(regexp_extract(regexp_extract(name, '([^/]*)$', 1), '^.+\.([^.]*)$', 1))"
_TYPE_BY_EXT_SQL = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e, t in detect.TYPE_OF_EXTENSION.items() if t == kind)}) THEN '{kind}'" for kind in dict.fromkeys(detect.TYPE_OF_EXTENSION.values())) + " END"
_TYPE_BY_MIME_SQL = "CASE " + " ".join(f"WHEN plain = '{m}' THEN '{t}'" for m, t in detect.TYPE_OF_MIME.items()) + " WHEN starts_with(plain, 'image/') THEN 'image' END"


def _named(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", _pick(_NAMES, F.col("doc_id")).alias("name"), _pick(_MIMES, F.floor(F.col("doc_id") / len(_NAMES))).alias("mime"))


@query("documents", f"""SELECT doc_id, name, CASE WHEN ext IN ('doc', 'ppt') THEN 'legacy' ELSE coalesce({_TYPE_BY_EXT_SQL}, {_TYPE_BY_MIME_SQL}) END AS type
  FROM (SELECT *, {_EXT_SQL} AS ext, lower(trim(split_part(mime, ';', 1))) AS plain FROM {_NAMED_SQL})""")
def detect_type(documents: DataFrame) -> DataFrame:
    return _named(documents).select("doc_id", "name", detect.detect_type(F.col("name"), F.col("mime"), F.lit(None).cast("binary")).alias("type"))


@query("documents", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'pdf' WHEN 4 THEN 'zip' END AS type FROM documents""")
def detect_magic(documents: DataFrame) -> DataFrame:
    heads = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A", "FFD8FFE000", "474946383961", "255044462D31", "504B03041400", "001122")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents.select("doc_id", detect.detect_type(F.lit("upload"), F.lit(None).cast("string"), F.concat(heads, F.encode("text", "UTF-8"))).alias("type"))


@query("documents", f"""SELECT doc_id, name FROM (SELECT *, {_EXT_SQL} AS ext FROM {_NAMED_SQL}) WHERE ext IN ({', '.join(map(repr, [*detect.TYPE_OF_EXTENSION, *detect.OLD_OFFICE]))})
  AND NOT (starts_with(name, '__MACOSX/') OR starts_with(regexp_extract(name, '([^/]*)$', 1), '.') OR regexp_extract(name, '([^/]*)$', 1) = 'Thumbs.db')""")
def supported_files(documents: DataFrame) -> DataFrame:
    return _named(documents).where(detect.is_supported(F.col("name")) & ~detect.is_junk(F.col("name"))).select("doc_id", "name")


@query("documents", f"""SELECT doc_id, CASE WHEN mime = '{detect.FOLDER_MIME}' THEN 'folder' WHEN mime IN ({', '.join(map(repr, detect.EXPORTS))}) THEN 'export' WHEN starts_with(mime, '{detect.APP_MIME}') THEN 'unsupported'
  WHEN ext IN ({', '.join(map(repr, [*detect.TYPE_OF_EXTENSION, *detect.OLD_OFFICE]))}) THEN 'file' ELSE 'unsupported' END AS kind,
  CASE WHEN mime = 'application/vnd.google-apps.document' AND ext <> 'docx' THEN name || '.docx' ELSE name END AS name FROM (SELECT *, {_EXT_SQL} AS ext FROM {_NAMED_SQL})""")
def manifest_classify(documents: DataFrame) -> DataFrame:
    return _named(documents).select("doc_id", detect.entry_kind(F.col("name"), F.col("mime")).alias("kind"), detect.export_name(F.col("name"), F.col("mime")).alias("name"))


@query("conversations", "SELECT conv_id, turn, regexp_full_match(trim(text), '[A-Za-z0-9_-]{1,200}') AS valid, trim(text) = '' AS missing FROM conversations")
def folder_id_validation(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.rlike(F.trim("text"), F.lit(r"\A[A-Za-z0-9_-]{1,200}\z")).alias("valid"), (F.trim("text") == "").alias("missing"))


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'document/v1|md|md5:' || md5(text) WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'document/v1|md|drive:' || doc_id || '@' || source END AS cache_key FROM documents")
def content_key(documents: DataFrame) -> DataFrame:
    md5 = F.when(F.col("doc_id") % 3 < 2, F.md5("text"))
    return documents.select("doc_id", relational.content_key("document/v1", F.lit("md"), md5, F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.col("source")).alias("cache_key"))


@query("documents", """SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value('img-' || doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)""")
def duplicate_content(documents: DataFrame) -> DataFrame:
    return relational.duplicates_of(documents, [], F.md5("text"), "doc_id", F.concat(F.lit("img-"), F.col("doc_id").cast("string"))).select("doc_id", "duplicate_of")


@query("documents", """SELECT doc_id, 'img-' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS image_id,
  CASE WHEN row_number() OVER w > 1 THEN 'same image as ' || first_value('img-' || doc_id) OVER w WHEN n_chars % 7 = 0 THEN 'format a vision model cannot read' WHEN n_chars % 100 < 48 THEN 'icon-sized' ELSE 'embedded picture' END AS reason
  FROM documents WINDOW w AS (PARTITION BY source, md5(text) ORDER BY doc_id)""")
def image_registry(documents: DataFrame) -> DataFrame:
    marked = relational.duplicates_of(documents, ["source"], F.md5("text"), "doc_id", F.concat(F.lit("img-"), F.col("doc_id").cast("string")))
    verdict = triage.image_verdict(F.col("duplicate_of"), F.when(F.col("n_chars") % 7 != 0, "image/png"), (F.col("n_chars") % 100).cast("int"), F.lit(100))
    numbered = records.number_within(marked.select("source", "doc_id", verdict["reason"].alias("reason")), "source", "doc_id", "number")
    return numbered.select("doc_id", F.concat(F.lit("img-"), F.col("number").cast("string")).alias("image_id"), "reason")


@query("documents", "SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src0')")
def cache_hits(documents: DataFrame) -> DataFrame:
    keyed = documents.withColumn("key", F.md5("text"))
    return relational.split_by_cache(keyed, keyed.where("source = 'src0'"), "key")[0].select("doc_id")


@query("documents", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0')")
def cache_misses(documents: DataFrame) -> DataFrame:
    keyed = documents.withColumn("key", F.md5("text"))
    return relational.split_by_cache(keyed, keyed.where("source = 'src0'"), "key")[1].select("doc_id")


@query("events", "SELECT user_id, last_access FROM (SELECT user_id, max(event_id) AS last_access FROM events GROUP BY user_id) ORDER BY last_access DESC, user_id LIMIT 50")
def lru_survivors(events: DataFrame) -> DataFrame:
    return relational.survivors(events, "user_id", F.col("event_id"), 50)


#: Documents of a source in one archive at most, so that an archive is one row of bounded size.
_ARCHIVE = 1_000
_ARCHIVE_SQL = f"source || '/' || (doc_id // {_ARCHIVE})"


def _archived(documents: DataFrame) -> DataFrame:
    return documents.withColumn("archive", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / _ARCHIVE).cast("string")))


@query("documents", f"""SELECT {_ARCHIVE_SQL} AS archive, string_agg('## doc-' || doc_id || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS text, count(*)::BIGINT AS n_children FROM documents WHERE text <> '' GROUP BY ALL""")
def archive_rollup_text(documents: DataFrame) -> DataFrame:
    return relational.roll_up_text(_archived(documents), "archive", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "text", "doc_id")


@query("documents", """SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, 'doc-' || doc_id AS title, length(text) < 40 AS needs_vision, 'see child document' AS reason FROM documents""")
def archive_sections(documents: DataFrame) -> DataFrame:
    """The children of an archive of any size, as numbered rows."""
    numbered = records.number_within(documents, "source", "doc_id", "number")
    return numbered.select("source", "number", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), (F.length("text") < 40).alias("needs_vision"), F.lit("see child document").alias("reason"))


@query("documents", "SELECT source, bool_or(length(text) < 40) AS needs_vision, count(*)::BIGINT AS n_children, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source")
def archive_child_verdict(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.bool_or(F.length("text") < 40).alias("needs_vision"), F.count("*").alias("n_children"), F.sum(F.length("text")).cast("long").alias("characters"))


@query("documents", f"""WITH RECURSIVE d AS (SELECT *, {_ARCHIVE_SQL} AS archive FROM documents), o AS (SELECT archive, n_chars, row_number() OVER (PARTITION BY archive ORDER BY doc_id) AS i FROM d),
  f AS (SELECT archive, i, CASE WHEN n_chars <= 30000 THEN n_chars ELSE 0 END AS s, n_chars <= 30000 AS ok FROM o WHERE i = 1
  UNION ALL SELECT o.archive, o.i, CASE WHEN f.s + o.n_chars <= 30000 THEN f.s + o.n_chars ELSE f.s END, f.s + o.n_chars <= 30000 FROM f JOIN o ON o.archive = f.archive AND o.i = f.i + 1)
  SELECT archive, sum(ok::INT)::BIGINT AS n_taken, count(*)::BIGINT AS n FROM f GROUP BY archive""")
def zip_refusal(documents: DataFrame) -> DataFrame:
    # What is larger than the limit is never taken, so it needs no place in the array.
    fits = F.when(F.col("n_chars") <= 30_000, F.struct("doc_id", "n_chars"))
    entries = _archived(documents).groupBy("archive").agg(F.array_sort(F.collect_list(fits)).alias("e"), F.count("*").cast("long").alias("n"))
    return entries.select("archive", relational.admitted(F.transform("e", lambda x: x["n_chars"]), 30_000).alias("n_taken"), "n")


@query("lineitem", """SELECT l_suppkey, min(l_partkey) AS first_block, max(l_partkey) AS last_block, count(*)::BIGINT AS blocks FROM (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, g""")
def block_runs(lineitem: DataFrame) -> DataFrame:
    return relational.runs(spread(lineitem.select("l_suppkey", "l_partkey"), "l_suppkey"), "l_suppkey", "l_partkey")


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 16777216 WHEN n_chars * 10000 > 33554432 THEN 33554432 ELSE 20000 * n_chars END::BIGINT AS bytes FROM documents")
def memory_estimate(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", triage.memory_estimate(F.when(F.col("doc_id") % 10 != 0, F.col("n_chars") * 10_000)).alias("bytes"))


@query("nation", """SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""")
def md_table(nation: DataFrame) -> DataFrame:
    rows = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    body = F.transform("r", lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    return rows.select("n_regionkey", text.md_table(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), body)).alias("md"))


@query("events", "SELECT event_id, json_valid(CASE WHEN event_id % 4 = 0 THEN props || '}' ELSE props END) AS valid FROM events")
def json_validity(events: DataFrame) -> DataFrame:
    return events.select("event_id", reply.valid_json(F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("valid"))


_REPLY_SQL = """CASE turn % 3 WHEN 0 THEN 'Here: ```json' || chr(10) || '{"confidence": "high", "n": ' || turn || '}' || chr(10) || '``` done' WHEN 1 THEN 'so {"confidence": "low", "n": 1} it is' ELSE text END"""


def _replies(conversations: DataFrame) -> DataFrame:
    fenced = F.concat(F.lit('Here: ```json\n{"confidence": "high", "n": '), F.col("turn").cast("string"), F.lit("}\n``` done"))
    return conversations.withColumn("reply", F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, 'so {"confidence": "low", "n": 1} it is').otherwise(F.col("text")))


@query("conversations", """SELECT conv_id, turn, turn % 3 < 2 AS parsed, CASE turn % 3 WHEN 0 THEN 'high' ELSE 'low' END AS confidence FROM conversations""")
def reply_parse(conversations: DataFrame) -> DataFrame:
    found = _replies(conversations).withColumn("json", reply.json_candidate(F.col("reply")))
    ok = F.coalesce(reply.valid_json(F.col("json")), F.lit(False))
    return found.select("conv_id", "turn", ok.alias("parsed"), F.coalesce(F.when(ok, F.get_json_object("json", "$.confidence")), F.lit("low")).alias("confidence"))


_METRICS_SQL = """count(*)::BIGINT AS n, floor(avg((turn % 3 < 2)::INT) * 1000 + 0.5) / 1000 AS parse_rate, floor(sum(length(text))::DOUBLE / count(*) + 0.5)::BIGINT AS avg_latency, coalesce(sum(CASE WHEN turn % 2 = 0 THEN turn END), 0)::BIGINT AS tokens_in,
  sum(length(text) % 100)::BIGINT AS tokens_out, floor(avg(turn % 4) * 1000 + 0.5) / 1000 AS avg_elements, sum((turn % 3 > 0)::INT)::BIGINT AS n_low"""


def _analyses(conversations: DataFrame) -> DataFrame:
    found = _replies(conversations)
    return found.select(
        "conv_id", (F.col("conv_id") % 2).alias("provider"), reply.parsed_ok(F.col("reply")).alias("parsed"), F.length("text").alias("latency"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("tokens_in"),
        (F.length("text") % 100).alias("tokens_out"), (F.col("turn") % 4).alias("elements"), F.when(F.col("turn") % 3 == 0, "high").otherwise("low").alias("confidence"),
    )


@query("conversations", f"SELECT conv_id, conv_id % 2 AS provider, {_METRICS_SQL} FROM conversations GROUP BY conv_id")
def provider_summary(conversations: DataFrame) -> DataFrame:
    return relational.provider_metrics(_analyses(conversations), ["conv_id", "provider"])


@query("conversations", f"SELECT conv_id % 2 AS provider, {_METRICS_SQL} FROM conversations GROUP BY conv_id % 2")
def comparison_total(conversations: DataFrame) -> DataFrame:
    return relational.provider_metrics(_analyses(conversations), ["provider"])


_WORDS_SQL = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"


@query("conversations", f"""SELECT conv_id, turn, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE floor(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) * 1000 + 0.5) / 1000 END::DOUBLE AS agreement
  FROM (SELECT a.conv_id, a.turn, {_WORDS_SQL.format('a.text')} AS x, {_WORDS_SQL.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""")
def text_agreement(conversations: DataFrame) -> DataFrame:
    after = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return conversations.join(after, ["conv_id", "turn"]).select("conv_id", "turn", reply.text_agreement(F.col("text"), F.col("next")).alias("agreement"))


_KEYS = ["The", "de la", "und", "license", "zzzz"]


@query("documents", f"""SELECT doc_id, floor(len(found)::DOUBLE / {len(_KEYS)} * 1000 + 0.5) / 1000 AS recall, array_to_string(found, ',') AS found, array_to_string(list_filter({_sql_list(_KEYS)}, lambda k: NOT contains(lower(text), lower(k))), ',') AS missing
  FROM (SELECT *, list_filter({_sql_list(_KEYS)}, lambda k: contains(lower(text), lower(k))) AS found FROM documents)""")
def keyword_recall(documents: DataFrame) -> DataFrame:
    found = documents.select("doc_id", reply.keyword_recall(F.col("text"), F.array(*map(F.lit, _KEYS))).alias("k"))
    return found.select("doc_id", "k.recall", F.array_join("k.found", ",").alias("found"), F.array_join("k.missing", ",").alias("missing"))


@query("lineitem", """SELECT l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY l_linenumber""")
def chart_pivot(lineitem: DataFrame) -> DataFrame:
    return relational.chart_pivot(lineitem, "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"]).toDF("l_linenumber", "a", "n", "r")


@query("conversations", "SELECT conv_id, string_agg('[Page ' || (turn + 1) || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def page_labels(conversations: DataFrame) -> DataFrame:
    pages = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return pages.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("[Page "), (x["turn"] + 1).cast("string"), F.lit("] "), x["text"])), "\n\n").alias("text"))


@query("documents", "SELECT doc_id, 'Describe the pictures of this document. Its text: ' || substring(text, 1, 4000) AS prompt FROM documents")
def prompts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.concat(F.lit("Describe the pictures of this document. Its text: "), F.substring("text", 1, 4000)).alias("prompt"))


@query("documents", r"""SELECT doc_id, regexp_replace(source || ':/' || lang || '?*' || doc_id, '[\\/:*?"<>|]+', '__', 'g') AS name FROM documents""")
def safe_name(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text.safe_name(F.concat("source", F.lit(":/"), "lang", F.lit("?*"), F.col("doc_id").cast("string"))).alias("name"))


@query("part", """SELECT p_partkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size FROM (SELECT p_partkey, p_size::BIGINT * p_size * p_size * 16 AS b FROM part)""")
def format_bytes(part: DataFrame) -> DataFrame:
    size = F.col("p_size").cast("long")
    return part.select("p_partkey", text.format_bytes(size * size * size * 16).alias("size"))


@query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') || '+02:30' ELSE strftime(o_orderdate, '%Y-%m-01T00:00:00Z') END AS iso FROM orders")
def pdf_date(orders: DataFrame) -> DataFrame:
    full = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("000000+02'30'"))
    return orders.select("o_orderkey", text.pdf_date(F.when(F.col("o_orderkey") % 2 == 0, full).otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMM")))).alias("iso"))


@query("part", "SELECT p_partkey, (p_partkey % 26 + 1) * 26 + p_size % 26 AS col FROM part")
def column_index(part: DataFrame) -> DataFrame:
    letters = F.concat(F.char(65 + F.col("p_partkey") % 26), F.char(65 + F.col("p_size") % 26))
    return part.select("p_partkey", text.column_index(letters).cast("long").alias("col"))


@query("events", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 400 WHEN 1 THEN 413 WHEN 2 THEN 415 WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 404 ELSE 502 END ELSE 500 END AS status, event_id % 7 IN (0, 1) OR (event_id % 7 = 3) AS again FROM events""")
def http_status(events: DataFrame) -> DataFrame:
    code = _pick(["INVALID_INPUT", "FILE_TOO_LARGE", "NEEDS_MARKITDOWN", "DRIVE_REQUEST_FAILED", "WHATEVER"], F.col("event_id"))
    upstream = F.when(F.col("user_id") % 2 == 0, 404).otherwise(500)
    given = F.element_at(F.array(*map(F.lit, [429, 503, 404, 0, 0, 200, 600])), (F.col("event_id") % 7 + 1).cast("int"))
    network = F.when(F.col("event_id") % 7 == 3, "ECONNRESET").otherwise("EPERM")
    return events.select("event_id", triage.http_status(code, F.lit(False), upstream).alias("status"), triage.retryable(given, network).alias("again"))
