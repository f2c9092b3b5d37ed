"""Listings of remote folders as a Spark data source: ``spark.read.format("paperloom_folder")``.

Options: ``client``, the import path of a client (``package.module:name``, an object or a class
without arguments), or ``root``, a place with the pages of listings as JSON lines in
``folder=<id>/page=<token>/`` (``PageFiles``); ``folders``, their ids parted by commas (for
``root``: all there are, if left out).

A partition is some pages (``pages_a_partition``, 16 if not given), where the client knows their tokens
beforehand, else a folder, whose pages are asked for one after another. Filters on names, types, sizes and times go to the
client's side: rows that they exclude are not built. A page that fails is a row with an error and nulls, so
one that a filter on another column excludes, as always in SQL.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

SCHEMA = "folder string, page int, ordinal int, id string, name string, mime string, modified string, size long, md5 string, link string, error string"
#: Keys of a client's entries, by column.
KEYS = {"id": "id", "name": "name", "mime": "mimeType", "modified": "modifiedTime", "size": "size", "md5": "md5Checksum", "link": "webViewLink"}
#: Filters that are tested before a row is built; a null fails all of them.
TESTS: dict[type, Callable[[Any, Any], bool]] = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.IsNotNull: lambda a, b: True, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


@dataclass
class Pages(InputPartition):
    """Some pages of a folder by their tokens; without tokens all of them, one after another."""

    folder: str
    number: int
    tokens: list[str] | None


class PageFiles:
    """Pages of listings that lie as JSON lines below ``root``."""

    def __init__(self, root: str):
        self.root = root

    def _at(self, below: str = "") -> tuple[pyarrow.fs.FileSystem, str]:
        uri = self.root if "://" in self.root else f"file://{self.root.removeprefix('file:')}"
        system, inner = pyarrow.fs.FileSystem.from_uri(uri)
        return system, f"{inner}/{below}"

    def _below(self, below: str, prefix: str) -> list[str]:
        system, at = self._at(below)
        found = system.get_file_info(pyarrow.fs.FileSelector(at))
        return [f.base_name.removeprefix(prefix) for f in found if f.base_name.startswith(prefix)]

    def folders(self) -> list[str]:
        return sorted(self._below("", "folder="))

    def tokens(self, folder: str) -> list[str]:
        return sorted(self._below(f"folder={folder}", "page="), key=lambda t: (len(t), t))

    def page(self, folder: str, token: str) -> tuple[list[dict[str, Any]], str | None]:
        system, at = self._at(f"folder={folder}/page={token}")
        entries = []
        for f in sorted(system.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda f: f.path):
            if f.base_name[0] not in "._":
                with system.open_input_stream(f.path) as held:
                    entries += [json.loads(line) for line in held.read().split(b"\n") if line]
        return entries, None


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.tests = options, []

    def _client(self) -> Any:
        if "client" not in self.options:
            return PageFiles(self.options["root"])
        module, _, name = self.options["client"].partition(":")
        found = getattr(importlib.import_module(module), name)
        return found() if isinstance(found, type) else found

    def pushFilters(self, filters: list[Filter]):  # noqa: ANN201, N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in KEYS and type(f) in TESTS:
                self.tests.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        client = self._client()
        folders = [f.strip() for f in self.options["folders"].split(",")] if "folders" in self.options else client.folders()
        found: list[InputPartition] = []
        for folder in folders:
            try:
                tokens = client.tokens(folder) if hasattr(client, "tokens") else None
            except Exception:  # noqa: BLE001 (the page's reader tells)
                tokens = None
            size = int(self.options.get("pages_a_partition", 16))
            found += [Pages(folder, 0, None)] if tokens is None else [Pages(folder, i, tokens[i : i + size]) for i in range(0, len(tokens), size)]
        return found

    def _passes(self, row: dict[str, Any]) -> bool:
        return all(row[column] is not None and TESTS[kind](row[column], value) for column, kind, value in self.tests)

    def _rows(self, client: Any, folder: str, number: int, token: str | None) -> Iterator[tuple | str | None]:
        """The rows of a page, then the token of the next one; of a page that fails one row with an error."""
        try:
            entries, after = client.page(folder, token)
        except Exception as e:  # noqa: BLE001 (whatever a client raises is a row)
            from paperloom.sources.listing import error_text

            if not self.tests:  # a filter that reached the source excludes rows of nulls
                yield (folder, number, 0, *[None] * len(KEYS), error_text(e))
            return
        for i, entry in enumerate(entries):
            row = {c: entry.get(k) for c, k in KEYS.items()}
            row["size"] = None if row["size"] in (None, "") else int(row["size"])
            if self._passes(row):
                yield (folder, number, i, *row.values(), None)
        yield after

    def read(self, partition: Pages) -> Iterator[tuple]:
        client, number = self._client(), partition.number
        waiting = [None] if partition.tokens is None else list(partition.tokens)
        while waiting:
            for row in self._rows(client, partition.folder, number, waiting.pop(0)):
                if isinstance(row, tuple):
                    yield row
                elif partition.tokens is None and row is not None:
                    waiting.append(row)
            number += 1


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paperloom_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
