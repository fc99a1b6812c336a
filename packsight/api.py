"""The calls of the engine in one place. Packages are a path, (name, bytes) pairs, or a containers DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from packsight.operators import icons, tables
from packsight.operators import metadata as _metadata
from packsight.operators.package import IconOptions
from packsight.operators.tables import base_members

__all__ = ["IconOptions", "base_packages", "extract_icons", "extract_png", "inspect_icons", "metadata", "open_session", "packages", "permissions", "preview"]

Packages = str | DataFrame | Sequence[tuple[str, bytes]]


def packages(spark: SparkSession, given: Packages) -> DataFrame:
    if isinstance(given, DataFrame):
        return given
    return tables.containers(spark, given) if isinstance(given, str) else tables.containers_of(spark, given)


def inspect_icons(spark: SparkSession, given: Packages, options: IconOptions = IconOptions()) -> DataFrame:
    return icons.inspect(packages(spark, given), options)


def extract_icons(spark: SparkSession, given: Packages, options: IconOptions = IconOptions(), sizes: Sequence[int] | None = None) -> DataFrame:
    return icons.icons(packages(spark, given), options, sizes)


def extract_png(spark: SparkSession, given: Packages, options: IconOptions = IconOptions()) -> DataFrame:
    """(container_id, png) alone."""
    return extract_icons(spark, given, options).select("container_id", "png")


def metadata(spark: SparkSession, given: Packages) -> DataFrame:
    return _metadata.metadata(packages(spark, given))


def permissions(spark: SparkSession, given: Packages) -> DataFrame:
    return _metadata.permissions(packages(spark, given))


def preview(spark: SparkSession, given: Packages, options: IconOptions = IconOptions(size=192)) -> DataFrame:
    return icons.preview(packages(spark, given), options)


def base_packages(spark: SparkSession, given: Packages) -> DataFrame:
    """(container_id, content, error): bundles by their base package, packages as they are."""
    return base_members(packages(spark, given))


def open_session(spark: SparkSession, given: Packages) -> icons.Session:
    return icons.Session(packages(spark, given))
