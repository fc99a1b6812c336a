"""Where queries and their SQL equivalents are kept, and what they share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from packsight.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return put


def t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: few bytes say what much work is to be done, so a scan's partitions are too few for it."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def mapped(df: DataFrame, run: Callable[..., tuple], schema: str) -> DataFrame:
    """A row for each row: ``run`` gets its values and gives those of ``schema``, in Arrow batches and without a shuffle."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [run(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(rows, schema)
