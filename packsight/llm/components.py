"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.session import shared_dir

#: Edges beyond which rounds join by sorting: what Spark takes for their size can be too small, and it would broadcast them.
FEW_EDGES = 1 << 18


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, root): root is the smallest node that node reaches.

    Every node of an edge gets a row; loops and repeated edges are harmless. Each round is two grouped minima, and
    its edges are checkpointed to the shared folder, so lineage stays short and a lost executor costs one round.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = _size(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low if seen[0] <= FEW_EDGES else low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = small.where("u != v").distinct().checkpoint()
        size = _size(now)
        if size == seen:
            break
        seen = size
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
