"""Width and height from the first bytes of PNG, GIF, BMP, WEBP and JPEG files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A header that is shorter tells nothing.
LEAST_BYTES = 24
SIZE = "width int, height int"


def _number(hexed: Column, offset: int, n: int, little: bool) -> Column:
    """The unsigned number in ``n`` bytes at ``offset``."""
    pairs = [F.substring(hexed, 2 * (offset + i) + 1, 2) for i in range(n)]
    return F.conv(F.concat(*(pairs[::-1] if little else pairs)), 16, 10).cast("long")


def _pair(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """From the first frame header among the segments."""
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return None


def header_size(content: Column) -> Column:
    """struct<width, height> of all but JPEG; null where the bytes don't tell."""
    h = F.hex(F.substring(content, 1, 32))
    starts = lambda m: F.startswith(h, F.lit(m))
    webp = starts("52494646") & (F.substring(h, 17, 8) == "57454250")
    chunk, bits = F.substring(h, 25, 8), _number(h, 21, 4, True)
    known = (
        F.when(starts("89504E47"), _pair(_number(h, 16, 4, False), _number(h, 20, 4, False)))
        .when(starts("47494638"), _pair(_number(h, 6, 2, True), _number(h, 8, 2, True)))
        .when(starts("424D"), _pair(_number(h, 18, 4, True), F.abs(_number(h, 22, 4, True).bitwiseAND(0xFFFFFFFF).cast("int"))))
        .when(webp & (chunk == "56503858"), _pair(_number(h, 24, 3, True) + 1, _number(h, 27, 3, True) + 1))
        .when(webp & (chunk == "56503820"), _pair(_number(h, 26, 2, True).bitwiseAND(0x3FFF), _number(h, 28, 2, True).bitwiseAND(0x3FFF)))
        .when(webp & (chunk == "5650384C"), _pair(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
    )
    return F.when(F.octet_length(content) >= LEAST_BYTES, known)


def image_size(content: Column) -> Column:
    """struct<width, height>; only JPEG files go through Python."""

    @F.pandas_udf(SIZE)
    def jpeg(contents: pd.Series) -> pd.DataFrame:
        found = [(c and jpeg_size(c)) or (None, None) for c in contents]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    is_jpeg = F.hex(F.substring(content, 1, 3)) == "FFD8FF"
    found = F.when(is_jpeg, jpeg(F.when(is_jpeg, content))).otherwise(header_size(content))
    return F.when(found["width"].isNotNull(), found)


def model_size(width: Column, height: Column, most: int = 2000) -> Column:
    """The size to which a picture is scaled for a model: its longer side is ``most`` at most."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return _pair(F.floor(width * scale + 0.5), F.floor(height * scale + 0.5))
