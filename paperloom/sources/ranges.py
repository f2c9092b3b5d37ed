"""Files read in parts by the tasks: a range client, and a seekable file over it that fetches whole blocks.

A client is a picklable object with ``size(path)`` and ``read(path, start, end)``.
``ArrowRanges`` reads whatever pyarrow has a file system for (local paths, HDFS,
object stores); others may be injected. Paths, not contents, go through Spark, so
a task holds the parts that its reader asks for and nothing else of a file.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.options import Options, PaperloomError


class RangeClient(Protocol):
    def size(self, path: str) -> int: ...

    def read(self, path: str, start: int, end: int) -> bytes: ...


class ArrowRanges:
    """Paths or URIs of a file system that pyarrow knows. Open files are kept by nobody, so a client can be sent to tasks."""

    def _at(self, path: str) -> tuple[pyarrow.fs.FileSystem, str]:
        # Spark writes local paths with one slash.
        path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        return pyarrow.fs.FileSystem.from_uri(path)

    def size(self, path: str) -> int:
        system, inner = self._at(path)
        found = system.get_file_info(inner)
        if not found.is_file:
            raise PaperloomError("FILE_NOT_FOUND", path)
        return found.size

    def read(self, path: str, start: int, end: int) -> bytes:
        system, inner = self._at(path)
        with system.open_input_file(inner) as f:
            f.seek(start)
            return f.read(end - start)


class RangeFile(io.RawIOBase):
    """A seekable file of ``size`` bytes over ``fetch(start, end)``.

    Reads are rounded out to blocks; neighbouring missing blocks are one request, and the blocks used last are kept. A
    read of four blocks or more is one request that leaves the kept blocks alone, as is what ``want`` announces.
    """

    def __init__(self, fetch: Callable[[int, int], bytes], size: int, block: int = 256 << 10, most_blocks: int = 32):
        super().__init__()
        self._fetch, self.length, self.block, self.most_blocks = fetch, size, block, most_blocks
        self._blocks: OrderedDict[int, bytes] = OrderedDict()
        self._at, self._ahead = 0, (0, b"")
        self.requests = self.fetched = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self.length}[whence]
        if at < 0:
            raise ValueError("before the file's begin")
        self._at = at
        return at

    def _get(self, start: int, end: int) -> bytes:
        self.requests += 1
        got = self._fetch(start, end)
        if len(got) != end - start:
            raise EOFError(f"asked for {end - start} bytes, got {len(got)}")
        self.fetched += len(got)
        return got

    def want(self, start: int, end: int) -> None:
        """Fetch a long stretch at once that is about to be read in pieces; a short one is left to the blocks."""
        end = min(end, self.length)
        if end - start >= 4 * self.block:
            self._ahead = (start, self._get(start, end))

    def _run(self, first: int, last: int) -> None:
        start = first * self.block
        got = self._get(start, min((last + 1) * self.block, self.length))
        for i in range(first, last + 1):
            self._blocks[i] = got[i * self.block - start : (i + 1) * self.block - start]

    def _between(self, start: int, end: int) -> bytes:
        ahead, held = self._ahead
        if ahead <= start and end <= ahead + len(held):
            return held[start - ahead : end - ahead]
        if end - start >= 4 * self.block:
            return self._get(start, end)
        blocks = range(start // self.block, (end - 1) // self.block + 1)
        missing: list[int] = []
        for i in [*blocks, None]:
            if i is not None and i not in self._blocks:
                missing.append(i)
            elif missing:
                self._run(missing[0], missing[-1])
                missing = []
        for i in blocks:
            self._blocks.move_to_end(i)
        got = b"".join(self._blocks[i] for i in blocks)
        while len(self._blocks) > self.most_blocks:
            self._blocks.popitem(last=False)
        return got[start - blocks[0] * self.block : end - blocks[0] * self.block]

    def read(self, size: int = -1) -> bytes:
        start = min(self._at, self.length)
        end = self.length if size is None or size < 0 else min(start + size, self.length)
        self._at = end
        return self._between(start, end) if end > start else b""

    def readinto(self, buffer) -> int:  # noqa: ANN001
        got = self.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def open_file(client: RangeClient, path: str, options: Options) -> tuple[io.RawIOBase, str, int]:
    """(file, strategy, bytes of the file): large files by ranges, others as one read."""
    size = client.size(path)
    if size > options.range_threshold:
        return RangeFile(lambda a, b: client.read(path, a, b), size, options.block, options.most_blocks), "range", size
    if size > options.most_bytes:
        raise PaperloomError("FILE_TOO_LARGE", path)
    return io.BytesIO(client.read(path, 0, size)), "buffer", size


def fetch_files(files: DataFrame, client: RangeClient, options: Options = Options(), name: str = "path") -> DataFrame:
    """(path, length, content, error) of each path: whole contents, for readers that need them; what is too large is not fetched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                size, data, error = None, None, None
                try:
                    size = client.size(path)
                    if size > options.most_bytes:
                        raise PaperloomError("FILE_TOO_LARGE", path)
                    data = client.read(path, 0, size)
                except Exception as e:  # noqa: BLE001 (whatever a client raises is a row)
                    error = getattr(e, "code", None) or "EXTRACTION_FAILED"
                yield pd.DataFrame([(path, size, data, error)], columns=["path", "length", "content", "error"], dtype=object)

    return files.select(F.col(name).cast("string").alias("path")).mapInPandas(run, "path string, length long, content binary, error string")


def file_heads(files: DataFrame, client: RangeClient, name: str = "path", most: int = 8) -> DataFrame:
    """(path, head): the first bytes of each file; null where it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for path in batch["path"]:
                try:
                    heads.append(client.read(path, 0, min(most, client.size(path))))
                except Exception:  # noqa: BLE001 (the reader of the file tells)
                    heads.append(None)
            yield pd.DataFrame({"path": batch["path"], "head": pd.Series(heads, dtype=object)})

    return files.select(F.col(name).cast("string").alias("path")).mapInPandas(run, "path string, head binary")
