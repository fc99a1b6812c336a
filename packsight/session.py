"""Session helpers: a tuned local session, the shared folder, shipping this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "packsight", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that cross over to Python at a time, at most: they hold whole texts or packages.
BATCH_ROWS = 1000
#: And in bytes, where they are packages: of large ones a few at a time cross over.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages find it anywhere.

    Batches for Python are capped at ``BATCH_ROWS`` rows in this session, unless it caps them lower.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="packsight-")) / "packsight_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def ship_for_packages(spark: SparkSession) -> None:
    """``ship``, and batches for Python are capped at ``BATCH_BYTES`` too in this session, unless it caps them lower."""
    ship(spark)
    bytes_ = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if bytes_ > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine that names none gets one under /tmp, which
    is removed again when this process ends; on a cluster the setting must be there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = now.get() if now.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = f"/tmp/checkpoints/packsight-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Roots of the tables that this process wrote, for ``clean``.
_roots: list[str] = []


def clean(spark: SparkSession) -> None:
    """Remove all tables that this process wrote to the shared folder: for when their results have been read."""
    while _roots:
        _delete(spark, _roots.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _roots and spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            clean(spark)


atexit.register(_clean_at_exit)


class Scratch:
    """Tables written to the shared folder to cut lineage: lost executors reread files, not whole plans.

    They stay until ``clean`` or the end of the process: results are read from them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/packsight-tables/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
