"""A paged source replayed from recorded pages, as a Spark data source.

``spark.read.format("replay").option("path", folder).option("first", ...).option("last", ...)``
reads JSON pages (one object a line) from any file system that Arrow knows; a page is a partition. Rows outside the window of
the ``submitted_at`` texts are left out where they are read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.folder = options["path"]
        self.first, self.last = options.get("first", ""), options.get("last", "￿")
        self.names = names

    def partitions(self) -> list[InputPartition]:
        system, folder = FileSystem.from_uri(self.folder)
        found = system.get_file_info(FileSelector(folder, allow_not_found=True))
        return [_Page(f"{self.folder.rstrip('/')}/{name}") for name in sorted(f.base_name for f in found if f.base_name.endswith(".json"))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if partition is None:
            return
        system, path = FileSystem.from_uri(partition.path)
        with io.TextIOWrapper(system.open_input_stream(path), encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                if self.first <= (row.get("submitted_at") or "") <= self.last:
                    yield tuple(row.get(n) for n in self.names)


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "paper_row bigint, id string, category string, submitted_at string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)
