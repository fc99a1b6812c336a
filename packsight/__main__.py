"""Command line: python -m packsight (dump|entries|inspect|meta|render|stages) FOLDER [--size N] [--out FOLDER].

dump writes each icon as a PNG file under --out; the other verbs print a table, or write it there as Parquet.
"""

from __future__ import annotations

import argparse
import re
import time
import zlib
from pathlib import Path

from pyspark.sql import DataFrame

from packsight.operators import icons, metadata, tables
from packsight.operators.package import IconOptions
from packsight.session import local_session


def stages(packages: DataFrame, rounds: int = 3) -> DataFrame:
    """Wall-clock milliseconds of each stage over all packages, summarised over some rounds."""
    runs = {"entries": tables.entries, "manifest": tables.xml_nodes, "resources": tables.res_values, "inspect": icons.inspect, "record": icons.record}
    rows = []
    for _ in range(rounds):
        for name, run in runs.items():
            begin = time.perf_counter()
            run(packages).write.format("noop").mode("overwrite").save()
            rows.append((name, (time.perf_counter() - begin) * 1000))
    return icons.stage_report(packages.sparkSession.createDataFrame(rows, "stage string, ms double"))


def dump(packages: DataFrame, size: int, out: str) -> int:
    """Icons as files, one folder for each way an icon is preferred; the number of files. Rows come to this machine one
    partition at a time."""
    written = 0
    for name, adaptive in (("adaptive", True), ("raster", False)):
        found = icons.icons(packages, IconOptions(size=size, adaptive=adaptive), sizes=(size,)).where("png IS NOT NULL")
        folder = Path(out) / name
        folder.mkdir(parents=True, exist_ok=True)
        for row in found.select("container_id", "png").toLocalIterator():
            stem = re.sub(r"[^\w.-]+", "_", row.container_id.rsplit("/", 1)[-1])
            (folder / f"{stem}-{zlib.crc32(row.container_id.encode()):08x}.png").write_bytes(row.png)
            written += 1
    return written


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="packsight", description=__doc__)
    parser.add_argument("verb", choices=("dump", "entries", "inspect", "meta", "render", "stages"))
    parser.add_argument("folder")
    parser.add_argument("--size", type=int, default=432)
    parser.add_argument("--out", help="a folder for the result")
    got = parser.parse_args(args)
    if got.verb == "dump" and not got.out:
        parser.error("dump needs --out")
    spark = local_session()
    packages = tables.containers(spark, got.folder)
    if got.verb == "dump":
        print(f"{dump(packages, got.size, got.out)} icons")
        return
    run = {"entries": tables.entries, "inspect": icons.inspect, "meta": metadata.metadata, "stages": stages, "render": lambda df: icons.icons(df, sizes=(got.size,))}[got.verb]
    found = run(packages)
    if got.out:
        found.write.mode("overwrite").parquet(got.out)
    else:
        if got.verb == "stages":
            print(icons.report_text(found))
            return
        (found.drop("png") if got.verb == "render" else found).show(1000, truncate=False)


if __name__ == "__main__":
    main()
