"""Ranking of candidates: nearest density, best score, first success, tiers of fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packsight.operators.rules import adaptive_score_col, density_distance_col, is_adaptive_candidate_col, is_raster_candidate_col
from packsight.operators.tables import by_sorting


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in its group. ``order`` must end in a key without ties: Spark keeps no input order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def best(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, by partial aggregation rather than a sort of whole groups.

    ``order``: columns of which the smallest wins; negate numbers to turn them round.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    row = F.struct(*df.columns)
    return df.groupBy(*group).agg(F.min_by(row, F.struct(*keys)).alias("__row")).select("__row.*")


def raster_candidates(entries: DataFrame, dpi: int = 480) -> DataFrame:
    """Launcher images of each container with their ranks: density distance, then larger file, then archive order."""
    found = entries.where(is_raster_candidate_col(F.col("path"))).withColumn("distance", density_distance_col(F.col("path"), dpi))
    return ranked(found, ["container_id"], [F.asc("distance"), F.desc("usize"), F.asc("cd_index")])


def adaptive_candidates(entries: DataFrame) -> DataFrame:
    found = entries.where(is_adaptive_candidate_col(F.col("path"))).withColumn("score", adaptive_score_col(F.col("path")))
    return ranked(found, ["container_id"], [F.desc("score"), F.asc("cd_index")])


def best_raster(entries: DataFrame, dpi: int = 480) -> DataFrame:
    """(container_id, path) of the best launcher image by name."""
    found = entries.where(is_raster_candidate_col(F.col("path")))
    return best(found, ["container_id"], [density_distance_col(F.col("path"), dpi), -F.col("usize"), F.col("cd_index")]).select("container_id", "path")


def resource_paths(entries: DataFrame) -> DataFrame:
    """Entries with the resource kind, name and ending that their paths spell; lookups by name are then equi-joins."""
    long_form = F.regexp_extract("path", r"^res/([a-z]+)[^/]*/([^/]+)\.(png|webp|jpg|jpeg|xml)$", 0) != ""
    part = lambda i: F.regexp_extract("path", r"^(?:res/([a-z]+)[^/]*|r/[^/]+)/([^/]+)\.(png|webp|jpg|jpeg|xml)$", i)
    out = entries.withColumn("res_name", part(2)).where("res_name != ''")
    return out.withColumns({"res_type": F.nullif(part(1), F.lit("")), "ending": part(3), "long_form": long_form})


def by_name(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """refs (container_id, res_type, res_name) -> matching entries; the short form only where the long one has none."""
    widened = F.when(F.col("res_type").isin("drawable", "mipmap"), F.array(F.lit("drawable"), F.lit("mipmap"))).otherwise(F.array("res_type"))
    asked = refs.where("res_type != 'color'").select("container_id", "res_name", F.col("res_type").alias("asked"), F.explode(widened).alias("res_type"))
    paths = resource_paths(entries).select("container_id", "path", "usize", "cd_index", "res_type", "res_name", "ending", "long_form")
    full = asked.join(by_sorting(paths.where("long_form")), ["container_id", "res_type", "res_name"]).select("container_id", "asked", "res_name", "path", "usize", "cd_index", "ending")
    rest = asked.select("container_id", "asked", "res_name").distinct().join(by_sorting(full), ["container_id", "asked", "res_name"], "left_anti")
    lower = paths.where("NOT long_form").withColumn("key", F.lower("res_name")).drop("res_name", "res_type", "long_form")
    short = rest.withColumn("key", F.lower("res_name")).join(by_sorting(lower), ["container_id", "key"]).select("container_id", "asked", "res_name", "path", "usize", "cd_index", "ending")
    return full.unionByName(short)


def first_success(df: DataFrame, group: list[str], rank: str, ok: str) -> DataFrame:
    """Of ranked attempts the first that succeeded; groups without success have no row."""
    return df.where(F.col(ok)).groupBy(*group).agg(F.min_by(F.struct(*df.columns), rank).alias("__row")).select("__row.*")


def tiers(*columns: str) -> Column:
    """The first column that has a value."""
    return F.coalesce(*columns)


#: Relative error of the sketch that brackets an order statistic.
ACCURACY = 10_000


def order_statistic(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at floor((n - 1) p) of each group's sorted numbers; a null is no value and a group of nulls has no row.

    A mergeable sketch of bounded size brackets the rank between two values of each group. The second pass counts what is
    below the bracket and the distinct values in it, some 4 / ACCURACY of a group's at most, and ranks only those: no group
    is sorted or held, whatever its size.
    """
    known = df.where(F.col(value).isNotNull()).select(group, value)
    spread = 2.0 / ACCURACY
    ends = F.percentile_approx(value, [max(0.0, p - spread), min(1.0, p + spread)], ACCURACY)
    bracket = known.groupBy(group).agg(ends.alias("__ends"), F.count(F.lit(1)).alias("__total"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    small = F.col("__total") <= 5 * ACCURACY  # ranked whole: a sketch counts ranks a little differently
    low = F.when(small | F.lit(p <= spread), F.col("__min")).otherwise(F.col("__ends")[0])
    high = F.when(small | F.lit(p >= 1 - spread), F.col("__max")).otherwise(F.col("__ends")[1])
    bracket = bracket.select(F.col(group).alias("__group"), low.alias("__low"), high.alias("__high"), F.floor((F.col("__total") - 1) * F.lit(p)).alias("__at"))
    near = known.join(bracket, F.col(group).eqNullSafe(F.col("__group"))).where(F.col(value) <= F.col("__high"))
    slot = F.when(F.col(value) >= F.col("__low"), F.col(value))  # null: below the bracket, and first in order
    counted = near.groupBy(group, slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__n"), F.first("__at").alias("__at"))
    running = counted.withColumn("__upto", F.sum("__n").over(Window.partitionBy(group).orderBy(F.asc_nulls_first("__slot"))))
    return running.where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__n") <= F.col("__at"))).select(group, F.col("__slot").alias(value))
