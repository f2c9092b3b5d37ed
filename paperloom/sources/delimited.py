"""Delimited text whose quotes may stand anywhere in a field, as rows of cells.

``spark.read.csv`` reads well-formed files; this one reads what a file really
holds: a quote inside a field opens or closes quoting, two quotes inside quotes
are one, and ragged rows stay ragged. A batch of texts is parsed as one buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE, RETURN, LINE = b'"\r\n'
#: Bytes of text parsed at once (or one longer text); some 40 times as many are held meanwhile.
SLICE = 1_000_000


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def parse_texts(texts: pa.Array, delimiter: str = ",") -> pa.Array:
    """list<list<string>>: rows of cells of each text, in slices of about SLICE bytes; a blank line is a row of one empty cell, no text is no row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([_parse_slice(texts.slice(a, b - a), delimiter) for a, b in zip(cuts, cuts[1:]) if b > a] or [_parse_slice(texts, delimiter)])


def _parse_slice(texts: pa.Array, delimiter: str) -> pa.Array:
    """All texts as one buffer. The delimiter is one ASCII character. A mark that an even number of
    quotes of its text precede ends a cell or a row; of the quotes only those that another one has just closed are part of a cell.
    """
    mark = delimiter.encode()
    if len(mark) != 1:
        raise ValueError("a delimiter is one ASCII character")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    starts = ends[:-1]

    quote = data == QUOTE
    odd = np.concatenate([[False], np.logical_xor.accumulate(quote)])  # quotes in front of each byte
    inside = odd[:-1] ^ np.repeat(odd[starts], np.diff(ends))
    first = np.zeros(len(data) + 1, bool)  # of a text
    first[starts] = True
    follows = lambda what: np.concatenate([[False], what[:-1]]) & ~first[:-1]
    doubled = quote & ~inside & follows(quote & inside)
    breaks = ~inside & ((data == RETURN) | (data == LINE))
    second = breaks & (data == LINE) & follows(breaks & (data == RETURN))
    new_row = breaks & ~second
    closes = new_row | (~inside & (data == mark[0]))
    kept = (~quote | doubled) & ~closes & ~second

    # A text ends its last cell, unless that is empty and the first of a row: then there is no row.
    at = np.flatnonzero(closes)
    kept_before = np.concatenate([np.zeros(1, np.int32), np.cumsum(kept, dtype=np.int32)])
    closed = np.searchsorted(at, ends)  # marks in front of each text's start and, last, of the end
    some = closed[1:] > closed[:-1]
    last = np.where(some, at[np.maximum(closed[1:] - 1, 0)] if len(at) else 0, starts - 1)
    open_row = some & ~new_row[np.maximum(last, 0)] if len(data) else np.zeros(len(texts), bool)
    tail = open_row | (kept_before[ends[1:]] > kept_before[last + 1])
    texts_of = np.repeat(np.arange(len(texts)), np.diff(closed))
    where = np.concatenate([at, ends[1:][tail]])
    owner = np.concatenate([texts_of, np.flatnonzero(tail)])
    ends_row = np.concatenate([new_row[at], np.ones(tail.sum(), bool)])
    order = np.lexsort((where, owner))
    where, owner, ends_row = where[order], owner[order], ends_row[order]

    cells = pa.StringArray.from_buffers(len(where), pa.py_buffer(np.concatenate([[0], kept_before[where]]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[kept])))
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.flatnonzero(ends_row) + 1]), pa.int32()), cells)
    return pa.ListArray.from_arrays(_offsets(np.bincount(owner[ends_row], minlength=len(texts))), rows, mask=texts.is_null())


def delimited_cells(text: Column, delimiter: str = ",") -> Column:
    """array<array<string>> of a text; null for null."""

    @F.arrow_udf("array<array<string>>")
    def parse(texts: pa.Array) -> pa.Array:
        return parse_texts(texts.cast(pa.string()), delimiter)

    return parse(text)


def delimited_rows(files: DataFrame, name: str, text: str, delimiter: str = ",") -> DataFrame:
    """(name, row_no, cells), rows from 0."""
    return files.select(name, F.posexplode(delimited_cells(F.col(text), delimiter)).alias("row_no", "cells"))
