"""A Python data source for page folders, with a fetcher that may be put in its place."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "law_id string, layout string, html string, content_hash string, n_bytes bigint"


class _Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.size = int(options.get("foldersPerPartition", 256))

    def partitions(self) -> list[InputPartition]:
        """One listing of names; which folders hold a page, and what it is, is found out in the tasks."""
        names = sorted(os.listdir(self.root))
        return [_Folders(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [_Folders([])]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for law in partition.names:
            for layout, parts in (("latest", (law, "latest")), ("flat", (law,))):
                page = os.path.join(self.root, *parts, "main.html")
                if os.path.isfile(page):
                    with open(page, "rb") as f:
                        raw = f.read()
                    yield law, layout, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), len(raw)
                    break


class PageFolders(DataSource):
    """``spark.dataSource.register(PageFolders); spark.read.format("page_folders").load(root)``: one row per folder that
    holds main.html, from ``<id>/latest`` if there is one, else from ``<id>``."""

    @classmethod
    def name(cls) -> str:
        return "page_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
