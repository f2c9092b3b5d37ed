"""Sets of hashed word shingles, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, factor, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_slice(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    n = len(data)
    up, down = _power(n + 1)
    word = ~_BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]  # a word ends where its text ends
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n])))
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    count = len(hashed)
    whole = np.zeros(max(count - size + 1, 0), np.uint64)
    for j in range(size if len(whole) else 0):
        whole += hashed[j : j + len(whole)] * weights[j]
    whole = mix(whole)
    edges = np.searchsorted(start, offsets)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield mix((hashed[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``size`` words as sorted 64-bit hashes.

    A-Z are lower-cased; words are what ASCII white space parts. Fewer words than ``size``: the whole sequence
    as one. Null or no word: none.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        b = min(b, len(texts))
        yield from _of_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        a = b
