"""What needs a look by a vision model, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A page with less text is a scan; with as many paths it holds a drawing; smaller pictures are icons.
LEAST_TEXT, MOST_PATHS, ICON = 40, 25, 48


def page_verdict(text: Column, images: Column, paths: Column) -> Column:
    """(needs_vision, reason) of a page; images and paths are both null where they weren't counted."""
    short, seen = F.length(text) < LEAST_TEXT, F.coalesce(images, F.lit(0)) > 0
    drawn = F.coalesce(paths, F.lit(0)) >= MOST_PATHS
    reason = (
        F.when(short & (F.length(text) > 0), "very little text - likely scanned")
        .when(short, "no text layer - scanned or image-only")
        .when(seen, F.concat(images.cast("string"), F.lit(" image(s) on page")))
        .when(drawn, "vector graphics - likely a chart or diagram")
        .when(images.isNull() & paths.isNull(), "text layer present (graphics not inspected)")
        .otherwise("text only")
    )
    return F.struct((short | seen | drawn).alias("needs_vision"), reason.alias("reason"))


def image_verdict(duplicate_of: Column, mime: Column, width: Column, height: Column) -> Column:
    small = F.coalesce((width < ICON) & height.isNotNull() | (height < ICON) & width.isNotNull(), F.lit(False))
    reason = F.when(duplicate_of.isNotNull(), F.concat(F.lit("same image as "), duplicate_of)).when(mime.isNull(), "format a vision model cannot read").when(small, "icon-sized").otherwise("embedded picture")
    return F.struct((duplicate_of.isNull() & mime.isNotNull() & ~small).alias("needs_vision"), reason.alias("reason"))


def memory_estimate(size: Column, threshold: int = 32 << 20) -> Column:
    return F.when(size.isNull(), 16 << 20).when(size > threshold, 32 << 20).otherwise(2 * size).cast("long")


def http_status(code: Column, known: Column, upstream: Column) -> Column:
    """Status of an error code; known: one of our own codes; upstream: the status that the storage gave."""
    return (
        F.when(code.isin("INVALID_INPUT", "INVALID_DRIVE_FOLDER", "MISSING_DRIVE_FOLDER", "MISSING_INPUT", "OAUTH_STATE", "OAUTH_DENIED"), 400)
        .when(code.isin("MISSING_CREDENTIALS", "DRIVE_OAUTH_REQUIRED"), 401)
        .when(code == "FILE_TOO_LARGE", 413)
        .when(code.isin("UNSUPPORTED_FILE_TYPE", "LEGACY_OFFICE_FORMAT", "NEEDS_MARKITDOWN"), 415)
        .when(code == "DRIVE_REQUEST_FAILED", F.when(upstream == 404, 404).otherwise(502))
        .otherwise(F.when(known, 422).otherwise(500))
    )


def retryable(status: Column, network: Column) -> Column:
    return F.coalesce((status == 429) | ((status >= 500) & (status < 600)), F.lit(False)) | (F.coalesce(status, F.lit(0)) == 0) & F.coalesce(network.isin("ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN"), F.lit(False))
