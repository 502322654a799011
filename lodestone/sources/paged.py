"""A feed of pages as a stream: a Python data source with offsets, some pages a partition.

A page is a folder ``page=<number>`` with the recorded response as text. Offsets are numbers of pages, so a stream that
failed or was stopped reads each page once. Pages are read by pyarrow's file systems, in the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.sources.readers import ITEM_SCHEMA, atom_items, rest_items


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _pages(path: str) -> list[int]:
    files, root = _open(path)
    found = [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory]
    return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"page=(\d+)", x)))


#: Partitions of a batch of pages, at most. Tasks cost more than small pages do, so their number is bounded.
PARTITIONS = 64


class _Range(InputPartition):
    """Pages that one task reads, one after the other."""

    def __init__(self, numbers: list[int]):
        self.numbers = numbers


def _dealt(numbers: list[int]) -> list[InputPartition]:
    some = max(1, -(-len(numbers) // PARTITIONS))
    return [_Range(numbers[i : i + some]) for i in range(0, len(numbers), some)]


class _Pages:
    """Reads pages; kind is "atom" or a key of REST_FIELDS."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.source = options["path"], options.get("kind", "works"), options.get("source", "feed")

    def read(self, partition: _Range) -> Iterator[tuple]:
        files, root = _open(self.path)
        for number in partition.numbers:
            for f in files.get_file_info(fs.FileSelector(f"{root}/page={number}")):
                if f.is_file and not f.base_name.startswith(("_", ".")):
                    for body in files.open_input_stream(f.path).read().decode().splitlines():
                        if body.strip():
                            yield from atom_items(self.source, body) if self.kind == "atom" else rest_items(self.source, self.kind, body)


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _dealt(_pages(self.path))


class _Stream(_Pages, DataSourceStreamReader):
    """An offset is the number of the first page that is not read yet; pages come in the order of their numbers, and a gap
    is waited for, so no page is passed over."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        n = 0
        for p in _pages(self.path):
            if p != n:
                break
            n += 1
        return {"page": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(list(range(start["page"], end["page"])))

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    """format("paged_feed") with path, kind and source, for read and readStream: items of ITEM_SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def write_pages(items: DataFrame, page: Column, fields: dict[str, Column], path: str, into: str = "results", mode: str = "append") -> None:
    """Items as recorded REST responses, one for each page number (from 0 on)."""
    rows = items.select(page.cast("bigint").alias("page"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("item"))
    bodies = rows.groupBy("page").agg(F.to_json(F.struct(F.array_sort(F.collect_list("item")).alias(into))).alias("value"))
    bodies.write.mode(mode).partitionBy("page").text(path)
