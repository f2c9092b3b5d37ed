"""Type detection from name, MIME type and first bytes, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types by extension, by MIME type and by first bytes; old formats; MIME types by extension.
TYPE_OF_EXTENSION = {
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "gif": "image", "bmp": "image", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx",
    "xls": "xls", "zip": "zip", "txt": "text", "md": "text", "csv": "text", "tsv": "text", "json": "text", "xml": "text", "html": "text", "htm": "text",
}
TYPE_OF_MIME = {
    "application/pdf": "pdf", "application/zip": "zip", "application/x-zip-compressed": "zip", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/plain": "text", "text/csv": "text", "text/html": "text", "application/json": "text",
}
TYPE_OF_MAGIC = {"89504E47": "image", "FFD8FF": "image", "47494638": "image", "25504446": "pdf", "504B0304": "zip"}
OLD_OFFICE = ["doc", "ppt"]
MIME_OF_PICTURE = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}
EXPORTS = {
    "application/vnd.google-apps.document": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "application/vnd.google-apps.presentation": ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    "application/vnd.google-apps.spreadsheet": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "application/vnd.google-apps.drawing": ("png", "image/png"),
}
FOLDER_MIME, APP_MIME = "application/vnd.google-apps.folder", "application/vnd.google-apps"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extension(name: Column) -> Column:
    """Lower-cased, without the dot; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^.+\.([^.]*)$", 1))


def detect_type(name: Column, mime: Column, head: Column) -> Column:
    """legacy, or a type by extension, MIME type, or first bytes, in this order; null if none tells."""
    plain = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    first = F.hex(F.substring(head, 1, 8))
    magic = F.coalesce(*[F.when(F.startswith(first, F.lit(m)), t) for m, t in TYPE_OF_MAGIC.items()])
    return F.when(extension(name).isin(OLD_OFFICE), "legacy").otherwise(F.coalesce(_lookup(TYPE_OF_EXTENSION, extension(name)), _lookup(TYPE_OF_MIME, plain), F.when(F.startswith(plain, F.lit("image/")), "image"), magic))


def mime_of_name(name: Column) -> Column:
    """The MIME type of a picture that a model can read, by what follows the last dot of its name (the whole name without one); else null."""
    return _lookup(MIME_OF_PICTURE, F.lower(F.regexp_extract(name, r"([^.]*)$", 1)))


def needs_converter(kind: Column) -> Column:
    """Types that only an external converter reads."""
    return F.coalesce(kind == "xls", F.lit(False))


def is_readable(kind: Column) -> Column:
    """Whether an entry of a listing has a content to read."""
    return F.coalesce(kind.isin("file", "export"), F.lit(False))


def folder_id_error(folder: Column) -> Column:
    """MISSING_DRIVE_FOLDER or INVALID_DRIVE_FOLDER for what is no folder id; null for one."""
    plain = F.trim(F.coalesce(folder, F.lit("")))
    return F.when(plain == "", "MISSING_DRIVE_FOLDER").when(~F.rlike(plain, F.lit(r"\A[A-Za-z0-9_-]{1,200}\z")), "INVALID_DRIVE_FOLDER")


def is_supported(name: Column) -> Column:
    return extension(name).isin([*TYPE_OF_EXTENSION, *OLD_OFFICE])


def is_junk(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.startswith(name, F.lit("__MACOSX/")) | F.startswith(base, F.lit(".")) | (base == "Thumbs.db")


def entry_kind(name: Column, mime: Column) -> Column:
    return F.when(mime == FOLDER_MIME, "folder").when(mime.isin(list(EXPORTS)), "export").when(F.startswith(mime, F.lit(APP_MIME)) | ~is_supported(name), "unsupported").otherwise("file")


def export_name(name: Column, mime: Column) -> Column:
    """An exported file's name, with the extension of what it becomes unless it has it."""
    ext = _lookup({m: e for m, (e, _) in EXPORTS.items()}, mime)
    return F.when(ext.isNotNull() & (extension(name) != ext), F.concat(name, F.lit("."), ext)).otherwise(name)


def error_code(kind: Column) -> Column:
    return F.when(kind == "legacy", "LEGACY_OFFICE_FORMAT").when(kind.isNull(), "UNSUPPORTED_FILE_TYPE").when(kind == "xls", "NEEDS_MARKITDOWN")
