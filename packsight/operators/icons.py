"""The engine's calls: inspect, record, render, icons, metadata with icon. One container per step, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.functions.images import encode_png
from packsight.operators.metadata import METADATA, derived_from, metadata
from packsight.operators.ranking import order_statistic
from packsight.operators.package import IconOptions, Package, Recording, render
from packsight.operators.tables import flat_map

INSPECTION = "container_id string, icon_ref string, resolved_path string"
RECORDINGS = "container_id string, icon_ref string, source_path string, tier string, recording binary"
ICONS = "container_id string, size int, png binary, width int, height int, source_path string, tier string, error string"


def inspect(df: DataFrame, options: IconOptions = IconOptions(), mode: str = "PERMISSIVE") -> DataFrame:
    """Which file each container's icon comes from, without decoding it."""
    return flat_map(df, lambda data: [Package(data, options).inspect()], INSPECTION, mode)


def record(df: DataFrame, options: IconOptions = IconOptions(), mode: str = "PERMISSIVE") -> DataFrame:
    """Icons before they have a size: write or persist them, then render as often as wanted.

    A container without any icon has a row whose recording is null.
    """

    def rows(data: bytes) -> list[tuple]:
        found = Package(data, options).record()
        return [(found.icon_ref, found.source_path, found.tier, found.pack()) if found else (None, None, None, None)]

    return flat_map(df, rows, RECORDINGS, mode)


def draw(recordings: DataFrame, sizes: Sequence[int] = (432,), mask: str = "circle", isolate: bool = False) -> DataFrame:
    """Recordings to PNGs, one row for each size. Each is drawn where its recording is; bitmaps never become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("container_id", "source_path", "tier", "recording", "error"))
            for name, path, tier, packed, error in zip(*columns, strict=True):
                for size in sizes:
                    png, height, width = None, None, None
                    if packed is not None:
                        bitmap = render(Recording.unpack(packed), size, mask, isolate)
                        png, (height, width) = encode_png(bitmap), bitmap.shape[:2]
                    rows.append((name, size, png, width, height, path, tier, error))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ICONS.split(", ")])

    return recordings.select("container_id", "source_path", "tier", "recording", "error").mapInArrow(run, ICONS)


def icons(df: DataFrame, options: IconOptions = IconOptions(), sizes: Sequence[int] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    return draw(record(df, options, mode), sizes or (options.size,), options.mask, options.isolate)


def preview(df: DataFrame, options: IconOptions = IconOptions(size=192)) -> DataFrame:
    """Metadata of each container that has it, with its icon where there is one: both from one reading of the blob."""

    def rows(data: bytes) -> list[tuple]:
        package = Package(data, options)
        found = derived_from(package)
        if not found:
            return []
        icon = package.record()
        return [(*found[0], encode_png(render(icon, options.size, options.mask, options.isolate)) if icon else None)]

    return flat_map(df, rows, f"{METADATA}, png binary").where("error IS NULL").drop("error")


class Session:
    """Containers opened once: recordings are kept per choice of density and preference, and rendered from there."""

    def __init__(self, df: DataFrame):
        self.df, self.kept = df, {}

    def inspect(self, options: IconOptions = IconOptions()) -> DataFrame:
        return inspect(self.df, options)

    def metadata(self) -> DataFrame:
        return metadata(self.df)

    def record(self, options: IconOptions = IconOptions()) -> DataFrame:
        key = options.dpi, options.sdk, options.adaptive
        if key not in self.kept:
            self.kept[key] = record(self.df, options).persist()
        return self.kept[key]

    def icons(self, options: IconOptions = IconOptions(), sizes: Sequence[int] | None = None) -> DataFrame:
        return draw(self.record(options), sizes or (options.size,), options.mask, options.isolate)

    def close(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


def stage_report(timings: DataFrame) -> DataFrame:
    """(stage, ms) -> count, sum, range, mean, population deviation and lower-index percentiles by stage."""
    out = timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"), F.avg("ms").alias("avg_ms"), F.stddev_pop("ms").alias("std_ms"), F.max("ms").alias("max_ms")
    )
    for name, p in (("p50_ms", 0.5), ("p95_ms", 0.95)):
        out = out.join(order_statistic(timings, "stage", "ms", p).withColumnRenamed("ms", name), "stage")
    return out


def report_text(report: DataFrame) -> str:
    """A stage report as lines of text, slowest stage first; milliseconds with three decimals and each stage's share."""
    rows = sorted(report.collect(), key=lambda r: (-r.total_ms, r.stage))
    total = sum(r.total_ms for r in rows) or 1.0
    head = f"{'stage':<16}{'n':>8}{'total':>12}{'share':>8}{'min':>10}{'avg':>10}{'std':>10}{'p50':>10}{'p95':>10}{'max':>10}"
    line = lambda r: f"{r.stage:<16}{r.n:>8}{r.total_ms:>12.3f}{100 * r.total_ms / total:>7.1f}%{r.min_ms:>10.3f}{r.avg_ms:>10.3f}{r.std_ms:>10.3f}{r.p50_ms:>10.3f}{r.p95_ms:>10.3f}{r.max_ms:>10.3f}"
    return "\n".join([head, *map(line, rows)])
