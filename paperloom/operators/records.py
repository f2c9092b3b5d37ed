"""Parts of documents: pictures on slides, verdicts, statistics, what a model is to see.

Parts are flat rows by document (``path``); a part's document is a join away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import detect, images, text, triage
from paperloom.operators.relational import duplicates_of

#: Folders of packages with pictures, by kind; what makes a document's statistics.
MEDIA_FOLDERS = {"docx": "word/media/", "pptx": "ppt/media/"}


def register_media(members: DataFrame, folder: Column | str) -> DataFrame:
    """(path, part, id, name, mime, width, height, bytes, duplicate_of, needs_vision, reason, content) of the entries under a folder.

    ``members`` (path, ordinal, name, size, crc, content) are a package's entries, as ``zip_members`` gives them. The
    first of equal pictures (CRC and size) counts, the others are its duplicates. Entries that are no picture are listed too.
    """
    folder = F.lit(folder) if isinstance(folder, str) else folder
    held = members.where(F.startswith("name", folder) & ~F.endswith("name", F.lit("/")))
    held = held.withColumn("id", F.concat(F.lit("img-"), F.row_number().over(Window.partitionBy("path").orderBy("ordinal")).cast("string")))
    held = held.withColumn("mime", detect.mime_of_name(F.col("name"))).withColumn("measured", images.image_size(F.when(F.col("mime").isNotNull(), F.col("content"))))
    held = duplicates_of(held, ["path"], F.concat_ws(":", "crc", "size"), "ordinal", F.col("id"))
    verdict = triage.image_verdict(F.col("duplicate_of"), F.col("mime"), F.col("measured.width"), F.col("measured.height"))
    return held.withColumn("verdict", verdict).select(
        "path", F.col("name").alias("part"), "id", F.regexp_extract("name", r"([^/]*)$", 1).alias("name"), "mime", "measured.width", "measured.height",
        F.col("size").alias("bytes"), "duplicate_of", "verdict.needs_vision", "verdict.reason", "content",
    )


def slide_reason(fresh: Column, worth: Column, known: Column) -> Column:
    """Why a slide does or doesn't need a look: pictures seen first on it, whether any is worth one, whether any has a record. Fixed values."""
    return (
        F.when(fresh > 0, F.concat(fresh.cast("string"), F.lit(" picture(s) to analyse")))
        .when(worth, "pictures already covered on an earlier slide")
        .when(known, "only icon-sized or unreadable pictures")
        .otherwise("text and native charts only")
    )


def first_slides(slides: DataFrame) -> DataFrame:
    """(path, part, section): the first slide that shows a picture; from slides (path, number, pictures)."""
    return slides.select("path", "number", F.explode("pictures").alias("part")).groupBy("path", "part").agg(F.min("number").alias("section"))


def slide_verdicts(slides: DataFrame, media: DataFrame) -> DataFrame:
    """``slides`` (path, number, pictures) with needs_vision and reason, by their pictures in ``media`` (path, part, needs_vision).

    A slide needs a look if it is the first with a picture that is worth one. Pictures without a record don't count.
    """
    shown = slides.select("path", "number", F.explode("pictures").alias("part")).join(media.select("path", "part", F.col("needs_vision").alias("worth")), ["path", "part"])
    first = F.min("number").over(Window.partitionBy("path", "part"))
    seen = shown.withColumn("fresh", F.col("worth") & (first == F.col("number"))).groupBy("path", "number").agg(F.count_if("fresh").alias("fresh"), F.bool_or("worth").alias("worth"))
    reason = slide_reason(F.col("fresh"), F.col("worth"), F.col("worth").isNotNull())
    return slides.join(seen, ["path", "number"], "left").withColumn("needs_vision", F.coalesce(F.col("fresh") > 0, F.lit(False))).withColumn("reason", reason).drop("fresh", "worth")


def should_render(needs_vision: Column, pages: str) -> Column:
    """Whether a page is drawn for a model, with ``pages`` all, none or auto."""
    return {"all": F.lit(True), "none": F.lit(False), "auto": F.coalesce(needs_vision, F.lit(False))}[pages]


def visuals_of(media: DataFrame, kept: str = "content") -> DataFrame:
    """(path, id, label, mime, base64): the pictures that a model is to see and whose bytes are there."""
    label = F.concat_ws(" - ", F.regexp_extract("path", r"([^/]*)$", 1), "name")
    return media.where(F.col("needs_vision") & F.col(kept).isNotNull()).select("path", "id", label.alias("label"), "mime", F.base64(kept).alias("base64"))


def vision_calls(kind: Column, sections: Column, pictures: Column) -> Column:
    """How many looks a document takes: pages for a PDF, else pictures."""
    return F.when(kind == "pdf", sections).otherwise(pictures)


def document_stats(body: Column, sections: Column, pictures: Column, charts: Column) -> Column:
    """Counts over a document: its text, arrays of sections (needs_vision), pictures (duplicate_of, needs_vision) and charts."""
    unique = F.filter(pictures, lambda p: p["duplicate_of"].isNull())
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    wanted = lambda a: n(F.filter(a, lambda x: x["needs_vision"]))
    return F.struct(
        F.coalesce(text.utf16_length(body), F.lit(0).cast("long")).alias("characters"), text.word_count(body).alias("words"), n(sections).alias("sections"), n(pictures).alias("images"),
        n(unique).alias("unique_images"), n(charts).alias("charts"), wanted(sections).alias("sections_needing_vision"), wanted(unique).alias("images_needing_vision"),
    )


def describe(kind: Column, units: dict[str, Column], words: Column) -> Column:
    """One line on a document: its kind, the counts that are not zero, its words."""
    counts = [F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for name, n in units.items() if name not in ("images", "charts")]
    after = [F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for name, n in units.items() if name in ("images", "charts")]
    return F.concat_ws(", ", kind, *counts, F.concat(words.cast("string"), F.lit(" words")), *after)


def labelled_text(kind: Column, sections: Column, body: Column) -> Column:
    """The text that goes to the analysis: pages and slides with their numbers, else the body."""
    said = lambda word: F.array_join(F.transform(sections, lambda s: F.concat(F.lit(f"[{word} "), s["number"].cast("string"), F.lit("] "), F.coalesce(s["text"], F.lit("")))), "\n\n")
    return F.when(kind == "pdf", said("Page")).when(kind == "pptx", said("Slide")).otherwise(body)


def preview(sections: Column, most: int = 200, characters: int = 400) -> Column:
    """The first sections, the beginning of each: what a viewer lists."""
    return F.transform(F.slice(sections, 1, most), lambda s: F.substring(s["text"], 1, characters))


def number_within(rows: DataFrame, group: str, order: str, into: str, parts: int | None = None) -> DataFrame:
    """``rows`` with a number from 1 within ``group`` by the unique ``order``, also where one group has most rows.

    ``order`` is cut at quantiles; a window runs within (group, cut), and counts of these give where each begins.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000)).head()[0] or []
    cut = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_cut", F.coalesce(cut, F.lit(0)))
    counts = dealt.groupBy(group, "_cut").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_g"), F.col("_cut").alias("_c"), before.alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_cut").orderBy(order))
    met = dealt.withColumn("_at", within).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cut") == F.col("_c")))
    return met.withColumn(into, (F.col("_start") + F.col("_at")).cast("long")).drop("_cut", "_g", "_c", "_start", "_at")
