"""Two providers' analyses of the same pictures, compared.

An analysis is a row (file, visual_no, provider, label, parsed, confidence,
latency, tokens_in, tokens_out, elements, tables, summary, extracted_text, notes,
error). Everything is a join or an aggregate by file, picture or provider; only
the report, which has a line for each file and a fixed head, becomes text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.reply import keyword_recall, text_agreement
from paperloom.functions.text import safe_average, shown
from paperloom.operators.relational import provider_metrics

#: What one provider said of a picture, as ``compare_visuals`` gives it.
SIDE = ("parsed", "confidence", "latency", "elements", "tables", "summary", "extracted_text")


#: An analysis as JSON.
ANALYSIS = "file string, visual_no int, label string, provider string, model string, latency long, tokens_in long, tokens_out long, error string, parsed boolean, summary string, extracted_text string, elements int, tables int, entities int, confidence string, notes string"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def failure_cases(analyses: DataFrame) -> DataFrame:
    """(file, visual_no, label, provider, reason, notes) of analyses that failed, weren't JSON or are of low confidence; the first of these tells the reason."""
    reason = (
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.concat(F.lit("request error: "), "error"))
        .when(~F.coalesce(F.col("parsed"), F.lit(False)), "response was not valid JSON")
        .when(F.col("confidence") == "low", "model reported low confidence")
    )
    return analyses.withColumn("reason", reason).where("reason is not null").select("file", "visual_no", "label", "provider", "reason", F.nullif(F.col("notes"), F.lit("")).alias("notes"))


def compare_visuals(analyses: DataFrame, first: str, second: str) -> DataFrame:
    """(file, visual_no, label, agreement, first, second): both providers' words on the same picture; a side is null where a provider has none."""
    side = lambda name: F.max(F.when(F.col("provider") == name, F.struct(*SIDE)))
    both = analyses.where(F.col("provider").isin(first, second)).groupBy("file", "visual_no").agg(F.min("label").alias("label"), side(first).alias("first"), side(second).alias("second"))
    return both.select("file", "visual_no", "label", text_agreement(F.col("first.extracted_text"), F.col("second.extracted_text")).alias("agreement"), "first", "second")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, keywords) from a JSON file of ``{name: {"expectedKeywords": [...]}}``; a file that is none of these gives no rows."""
    told = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<expectedKeywords: array<string>>>").alias("files"))
    return told.select(F.explode("files").alias("name", "found")).where("found.expectedKeywords is not null").select("name", F.col("found.expectedKeywords").alias("keywords"))


def with_recall(visuals: DataFrame, truth: DataFrame) -> DataFrame:
    """``visuals`` with first_recall and second_recall: keywords of the file's name in ``truth`` (name, keywords) that a side found; null without any.

    ``truth`` has one row for each file name.
    """
    keyed = visuals.withColumn("name", base_name(F.col("file"))).join(truth, "name", "left")
    said = lambda side: F.concat_ws(" ", F.coalesce(f"{side}.summary", F.lit("")), F.coalesce(f"{side}.extracted_text", F.lit("")))
    found = {f"{side}_recall": F.when(F.col(side).isNotNull() & F.col("keywords").isNotNull(), keyword_recall(said(side), F.col("keywords"))["recall"]) for side in ("first", "second")}
    return keyed.withColumns(found).drop("name", "keywords")


def comparison_totals(visuals: DataFrame, first: str, second: str) -> DataFrame:
    """One row a provider over all pictures: (provider, analyses, parse_rate, latency, elements, tables, recall, n_low, agreement, visuals, files).

    Averages are rounded to three places and are null without a value; a missing latency is left out of its average.
    """
    sides = [(i, name, side) for i, (name, side) in enumerate(((first, "first"), (second, "second")))]
    rows = visuals.select("file", "visual_no", "agreement", F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("provider"), F.col(side).alias("said"), F.col(f"{side}_recall").alias("recall")) for i, name, side in sides
    ])).alias("x")).select("file", "visual_no", "agreement", "x.*")
    there = F.col("said").isNotNull()
    mean = lambda c: safe_average(F.when(there, c))
    totals = rows.groupBy("place", "provider").agg(
        F.count_if(there).alias("analyses"), mean(F.col("said.parsed").cast("int")).alias("parse_rate"), mean(F.col("said.latency")).alias("latency"),
        mean(F.coalesce("said.elements", F.lit(0))).alias("elements"), mean(F.coalesce("said.tables", F.lit(0))).alias("tables"), safe_average(F.col("recall")).alias("recall"),
        F.count_if(there & (F.col("said.confidence") == "low")).alias("n_low"), safe_average(F.col("agreement")).alias("agreement"),
        F.count("*").alias("visuals"), F.count_distinct("file").alias("files"),
    )
    return totals.orderBy("place").drop("place")


def recommendation(totals: DataFrame, first: str, second: str) -> DataFrame:
    """(accuracy, reliability, depth, consistency): what the totals say, as sentences. Ties in recall go to the first provider."""
    of = lambda name, c: F.max(F.when(F.col("provider") == name, F.col(c)))
    names = ("parse_rate", "recall", "elements", "tables", "agreement")
    one = totals.agg(*[of(p, c).alias(f"{side}_{c}") for side, p in (("a", first), ("b", second)) for c in names])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    pair = lambda c: F.concat(F.lit(f"({first} "), shown(a(c)), F.lit(f", {second} "), shown(b(c)), F.lit(")"))
    winner = F.when(F.coalesce(a("recall"), F.lit(0.0)) >= F.coalesce(b("recall"), F.lit(0.0)), first).otherwise(second)
    accuracy = F.when(a("recall").isNull() & b("recall").isNull(), "no ground truth was given, so nothing is said of accuracy").otherwise(F.concat(winner, F.lit(" recalled more of the expected facts "), pair("recall")))
    reliable = F.when(a("parse_rate").eqNullSafe(b("parse_rate")), "tied").when(a("parse_rate") > b("parse_rate"), first).otherwise(second)
    return one.select(
        accuracy.alias("accuracy"),
        F.concat(F.when(reliable == "tied", "both were equally reliable").otherwise(F.concat(reliable, F.lit(" was more reliable"))), F.lit(" at valid JSON "), pair("parse_rate")).alias("reliability"),
        F.concat(F.lit("visual elements a picture "), pair("elements"), F.lit(", tables "), pair("tables")).alias("depth"),
        F.concat(F.lit("agreement of the extracted texts "), shown(a("agreement"))).alias("consistency"),
    )


def file_summaries(analyses: DataFrame) -> DataFrame:
    """(file, provider, parse_rate, latency, elements, tables, failures): what a report says of each file."""
    metrics = provider_metrics(analyses, ["file", "provider"]).select("file", "provider", "parse_rate", F.col("avg_latency").alias("latency"), F.col("avg_elements").alias("elements"), F.col("avg_tables").alias("tables"))
    failed = failure_cases(analyses).groupBy("file", "provider").agg(F.count("*").alias("failures"))
    return metrics.join(failed, ["file", "provider"], "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


def report_lines(totals: DataFrame, advice: DataFrame, summaries: DataFrame, first: str, second: str) -> DataFrame:
    """(place, line) of a Markdown report: a table of totals, the advice, and a row for each file and provider.

    ``summaries``: (file, provider, visuals, parse_rate, latency, elements, tables, failures). Sort by place.
    """
    metrics = (("JSON parse rate", "parse_rate"), ("Low confidence", "n_low"), ("Visual elements", "elements"), ("Tables", "tables"), ("Keyword recall", "recall"), ("Latency (ms)", "latency"))
    value = lambda name, c: F.max(F.when(F.col("provider") == name, shown(F.col(c))))
    head = totals.agg(*[value(p, c).alias(f"{s}_{c}") for s, p in (("a", first), ("b", second)) for _, c in metrics], F.max("files").alias("files"), F.max("visuals").alias("visuals"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = [F.lit(f"# {first} and {second}"), text("Files: ", F.col("files"), " | Pictures: ", F.col("visuals")), F.lit(f"| Metric | {first} | {second} |"), F.lit("|---|---|---|")]
    lines += [text(f"| {title} | ", F.col(f"a_{c}"), " | ", F.col(f"b_{c}"), " |") for title, c in metrics]
    place = lambda part, *by: F.struct(F.lit(part).alias("part"), *by)
    none = (F.lit("").alias("file"), F.lit(0).alias("at"))
    top = head.select(F.posexplode(F.array(*lines)).alias("at", "line")).select(place(0, F.lit("").alias("file"), "at").alias("place"), "line")
    said = advice.select(F.posexplode(F.array("accuracy", "reliability", "depth", "consistency")).alias("at", "line")).select(place(1, F.lit("").alias("file"), "at").alias("place"), "line")
    title = advice.select(place(2, *none).alias("place"), F.lit("| File | Provider | Parse rate | Latency (ms) | Elements | Tables | Failures |").alias("line"))
    order = F.when(F.col("provider") == first, 0).otherwise(1).alias("at")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", base_name(F.col("file")), "provider", *[shown(F.col(c)) for c in ("parse_rate", "latency", "elements", "tables", "failures")]), F.lit(" |"))
    return top.unionByName(said).unionByName(title).unionByName(summaries.select(place(3, "file", order).alias("place"), row.alias("line")))
