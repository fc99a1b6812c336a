"""A data source over package archives whose reader takes path filters: rows that cannot match are never made.

    spark.dataSource.register(PackageEntries)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("package_entries").load(folder).where("path LIKE 'res/%'")
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from packsight.sources.archive import BadPackage, open_package


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PackageEntries(DataSource):
    """Entries of the packages in a folder that driver and executors can both open (a mounted store). A package that cannot
    be read has one row with an error, unless a filter on its path was pushed down: it has no paths."""

    @classmethod
    def name(cls) -> str:
        return "package_entries"

    def schema(self) -> str:
        return "container_id string, cd_index int, path string, method int, csize long, usize long, lho long, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EntriesReader(self.options["path"].removeprefix("file:"))


class EntriesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.prefixes: list[str] = []
        self.exact: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes prefix and equality tests of the path; hands the others back to Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.exact.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [File(p) for p in sorted(glob.glob(f"{glob.escape(self.path)}/**/*.*", recursive=True)) if p.endswith((".apk", ".apks", ".zip"))]
        return [File(self.path)]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        try:
            listed = open_package(data).listed
        except BadPackage as e:
            if not self.prefixes and not self.exact:
                yield partition.path, *[None] * 6, str(e)
            return
        for e in listed:
            if all(e.path.startswith(p) for p in self.prefixes) and all(e.path == p for p in self.exact):
                yield partition.path, e.index, e.path, e.method, e.packed, e.size, e.offset, None
