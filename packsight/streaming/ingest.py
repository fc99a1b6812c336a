"""Packages as they arrive: a folder watched as a stream, each content once, parsed in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, pattern: str = "*.{apk,apks,zip}", late: str = "1 hour") -> DataFrame:
    """Containers of new files. A content that was seen within ``late`` of its file's time is dropped: the state is
    digests within the watermark, not all that ever came."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(path)
    keyed = files.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", late)
    once = keyed.dropDuplicatesWithinWatermark(["digest"])
    return once.select(F.col("path").alias("container_id"), "path", "length", "content")


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write what ``parse`` makes of each micro-batch to Parquet, exactly once by the sink's own log."""
    writer = parse(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
