"""Rules on paths and densities, once for Python stages and once as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Density qualifiers with their ranks, in the order in which they are looked for.
DENSITIES = (("xxxhdpi", 0), ("xxhdpi", 1), ("xhdpi", 2), ("hdpi", 3), ("mdpi", 4), ("ldpi", 5), ("anydpi", 1), ("nodpi", 7))
# Lowest dpi of a target rank.
TARGETS = ((560, 0), (400, 1), (280, 2), (200, 3), (140, 4))
# ABIs of native libraries.
ABIS = ("armeabi-v7a", "armeabi", "arm64-v8a", "x86", "x86_64", "mips", "mips64")
# Image file endings.
RASTERS = (".png", ".webp", ".jpg", ".jpeg")
#: Distance of a path without a density.
UNKNOWN = 50


def target_rank(dpi: int) -> int:
    return next((rank for least, rank in TARGETS if dpi >= least), 5)


def density_distance(path: str, dpi: int) -> int:
    lower = path.lower()
    return next((abs(rank - target_rank(dpi)) for name, rank in DENSITIES if name in lower), UNKNOWN)


def is_raster_candidate(path: str) -> bool:
    lower = path.lower()
    placed = "/mipmap" in lower or "/drawable" in lower or re.match(r"r/[^/]+/ic_launcher", lower)
    base = lower.rsplit("/", 1)[-1]
    return lower.endswith(RASTERS) and bool(placed) and ("ic_launcher" in base or base.startswith("launcher_icon"))


def adaptive_score(path: str) -> int:
    lower = path.lower()
    return 4 * ("mipmap" in lower) + 3 * ("launcher" in lower) + 2 * lower.endswith("e4.xml")


def abi(path: str) -> str | None:
    """The ABI of a native library's path."""
    parts = path.split("/")
    return parts[1] if path.startswith("lib/") and path.endswith(".so") and parts[1] in ABIS else None


# --- the same as columns ---


def target_rank_col(dpi: Column) -> Column:
    out = F
    for least, rank in TARGETS:
        out = out.when(dpi >= least, F.lit(rank))
    return out.otherwise(F.lit(5))


def density_distance_col(path: Column, dpi: int) -> Column:
    out = F
    for name, rank in DENSITIES:
        out = out.when(F.lower(path).contains(name), F.lit(abs(rank - target_rank(dpi))))
    return out.otherwise(F.lit(UNKNOWN))


def is_raster_candidate_col(path: Column) -> Column:
    lower = F.lower(path)
    base = F.substring_index(lower, "/", -1)
    placed = lower.contains("/mipmap") | lower.contains("/drawable") | lower.rlike("^r/[^/]+/ic_launcher")
    return lower.rlike(r"\.(png|webp|jpg|jpeg)$") & placed & (base.contains("ic_launcher") | base.startswith("launcher_icon"))


def adaptive_score_col(path: Column) -> Column:
    lower = F.lower(path)
    return sum((F.when(c, n).otherwise(0) for c, n in ((lower.contains("mipmap"), 4), (lower.contains("launcher"), 3), (lower.endswith("e4.xml"), 2))), F.lit(0))


def is_adaptive_candidate_col(path: Column) -> Column:
    return path.startswith("res/") & path.endswith(".xml")


def abi_col(path: Column) -> Column:
    """The ABI of a native library's path, else null."""
    second = F.get(F.split(path, "/"), F.lit(1))
    return F.when(path.startswith("lib/") & path.endswith(".so") & second.isin(*ABIS), second)
