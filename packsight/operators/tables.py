"""The corpus as DataFrames: containers in, entries, nodes, attributes and resource values out.

Each table is one pass of Python over the blobs, without a shuffle. A blob that cannot be read gives a row with an error
(mode PERMISSIVE) or fails the job (mode FAILFAST).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from packsight.session import ship_for_packages
from packsight.sources.archive import MANIFEST, TABLE, BadPackage, open_package
from packsight.sources.chunks import ResourceTable, parse_xml

CONTAINERS = "container_id string, path string, length long, content binary"
ENTRIES = "container_id string, cd_index int, path string, method int, csize long, usize long, lho long"
NODES = "container_id string, file string, node_id int, parent_id int, depth int, ord int, tag string, ns string"
ATTRIBUTES = "container_id string, file string, node_id int, ord int, ns string, name string, raw string, vtype int, vdata int"
MANIFEST_ROWS = "container_id string, node_id int, parent_id int, tag string, ord int, name string, raw string, vtype int, vdata int"
VALUES = "container_id string, res_id int, config_ord int, value_ord int, kind string, str string, argb int, ref_id int"
ERROR = ", error string"
#: Rows that a Python stage hands back at a time, and bytes in their binary columns.
ROWS, BYTES = 4096, 4 << 20


def containers(spark: SparkSession, path: str, pattern: str = "*.{apk,apks,zip}") -> DataFrame:
    """Packages under a path; content is only read where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("container_id"), "path", "length", "content")


def containers_of(spark: SparkSession, blobs: Iterable[tuple[str, bytes]]) -> DataFrame:
    """Packages held in memory."""
    return spark.createDataFrame([(name, name, len(data), bytearray(data)) for name, data in blobs], CONTAINERS)


def flat_map(df: DataFrame, rows: Callable[[bytes], Iterable[tuple]], schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of every blob behind its container_id, and an error column.

    A few blobs at a time cross over to Python (they are whole packages), and rows go back in batches of ``ROWS``, or of fewer
    where they hold ``BYTES`` of pictures or packages.
    """
    ship_for_packages(df.sparkSession)
    full: StructType = _parse_datatype_string(schema + ERROR)
    arrow = to_arrow_schema(full)
    width = len(full) - 2
    binary = [i for i, f in enumerate(arrow) if pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            size = 0
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for name, content in zip(batch.column("container_id"), batch.column("content"), strict=True):
                name, data = name.as_py(), content.as_py()
                try:
                    if data is None:
                        raise BadPackage("no content")
                    for row in rows(data):
                        held.append((name, *row, None))
                        size += sum(len(held[-1][i] or b"") for i in binary)
                        if len(held) >= ROWS or size >= BYTES:
                            yield flush()
                except Exception as e:  # whatever a hostile blob does to a parser, the job goes on
                    if mode == "FAILFAST":
                        raise
                    known = isinstance(e, BadPackage) and str(e)
                    held.append((name, *[None] * width, known or f"{type(e).__name__}: {e}"))
        if held:
            yield flush()

    return df.select("container_id", "content").mapInArrow(run, full)


def _entries(data: bytes) -> Iterator[tuple]:
    for e in open_package(data).listed:
        yield e.index, e.path, e.method, e.packed, e.size, e.offset


def _documents(data: bytes, files: str) -> Iterator[tuple[str, object]]:
    archive = open_package(data)
    names = [MANIFEST] if files == "manifest" else [MANIFEST, *(p for p in archive.entries if p.startswith("res/") and p.endswith(".xml"))]
    for name in names:
        content = archive.read(name)
        if content is None:
            continue
        try:
            yield name, parse_xml(content)
        except BadPackage:
            if name == MANIFEST:
                raise


def _walk(root) -> Iterator[tuple[object, int, int | None, int, int]]:
    """(node, id, parent, depth, place among siblings) in document order."""
    stack, number = [(root, None, 0, 0)], 0
    while stack:
        node, parent, depth, place = stack.pop()
        yield node, number, parent, depth, place
        stack.extend((c, number, depth + 1, i) for i, c in reversed(list(enumerate(node.children))))
        number += 1


def entries(df: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    return flat_map(df, _entries, ENTRIES, mode)


def xml_nodes(df: DataFrame, files: str = "manifest", mode: str = "PERMISSIVE") -> DataFrame:
    """files: manifest, or all for the documents under res/ too. node_id counts in document order."""

    def rows(data: bytes) -> Iterator[tuple]:
        for name, root in _documents(data, files):
            for node, number, parent, depth, place in _walk(root):
                yield name, number, parent, depth, place, node.tag, node.ns

    return flat_map(df, rows, NODES, mode)


def xml_attrs(df: DataFrame, files: str = "manifest", mode: str = "PERMISSIVE") -> DataFrame:
    def rows(data: bytes) -> Iterator[tuple]:
        for name, root in _documents(data, files):
            for node, number, *_ in _walk(root):
                for i, a in enumerate(node.attributes):
                    yield name, number, i, a.ns, a.name, a.raw, a.type, a.data

    return flat_map(df, rows, ATTRIBUTES, mode)


def manifest_rows(df: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Nodes and attributes of manifests in one pass: a row per attribute, one with null name for a node without any."""

    def rows(data: bytes) -> Iterator[tuple]:
        for _, root in _documents(data, "manifest"):
            for node, number, parent, *_ in _walk(root):
                for i, a in enumerate(node.attributes):
                    yield number, parent, node.tag, i, a.name, a.raw, a.type, a.data
                if not node.attributes:
                    yield number, parent, node.tag, None, None, None, None, None

    return flat_map(df, rows, MANIFEST_ROWS, mode)


def res_values(df: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    def rows(data: bytes) -> Iterator[tuple]:
        content = open_package(data).read(TABLE)
        if content is not None:
            for res_id, order, kind, text, argb, ref in ResourceTable(content).rows():
                yield res_id, order, 0, kind, text, argb, ref

    return flat_map(df, rows, VALUES, mode)


def by_sorting(df: DataFrame) -> DataFrame:
    """One side of a join of tables that Python made, which must not be broadcast: Spark guesses their size from the few bytes
    of the table that they were made from, so every driver would get one that is too large for it."""
    return df.hint("merge")


def last_duplicates(entries_df: DataFrame, *more: Column) -> DataFrame:
    """One row per path of a container: the last in its directory. more: aggregates of all entries with that path."""
    good = entries_df.where("error IS NULL").drop("error")
    names = good.columns
    last = good.groupBy("container_id", "path").agg(F.max_by(F.struct(*names), "cd_index").alias("e"), *more)
    return last.select(*[f"e.{n}" for n in names], *last.columns[3:])


def existing(paths: DataFrame, entries_df: DataFrame) -> DataFrame:
    """Rows (container_id, path) whose path is an entry of the container."""
    return paths.join(by_sorting(entries_df), ["container_id", "path"], "left_semi")


def missing(paths: DataFrame, entries_df: DataFrame) -> DataFrame:
    return paths.join(by_sorting(entries_df), ["container_id", "path"], "left_anti")


def base_members(df: DataFrame) -> DataFrame:
    """Containers with bundles replaced by their base package; what cannot be read keeps its content and gets an error."""

    def rows(data: bytes) -> Iterator[tuple]:
        yield (bytes(open_package(data).data),)

    return flat_map(df, rows, "container_id string, content binary")
