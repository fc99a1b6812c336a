"""Queries over packages that are written from the driver's tables and read by the engine, with SQL that foretells the
result from the table alone. ``sources.synthetic`` says what is in a package."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsight.functions import images, raster, vector
from packsight.functions.columns import image_kind, resource_id
from packsight.operators import icons, metadata, ranking, tables
from packsight.operators.package import IconOptions
from packsight.plans.registry import mapped, query, spread, t
from packsight.sources.archive import STORED, write_archive
from packsight.sources.chunks import write_xml
from packsight.sources.samples import element
from packsight.sources.synthetic import packages, shop


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spread(t(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")), shop, "c_custkey")


def key() -> Column:
    return F.col("container_id").cast("long").alias("c_custkey")


#: The customers with short names for what their packages depend on.
C = "c AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS n, lower(c_mktsegment) AS segment, (c_custkey * 7919) % 16777215 - 16777216 AS argb FROM customer)"
SCAN, ART, MDPI, XHDPI, XXHDPI = "res/mipmap-anydpi-v26/ic_launcher.xml", "res/drawable/art.xml", *(f"res/mipmap-{d}/ic_launcher.png" for d in ("mdpi", "xhdpi", "xxhdpi"))
BEST = f"CASE k % 3 WHEN 2 THEN '{XXHDPI}' WHEN 1 THEN '{XHDPI}' ELSE '{MDPI}' END"
LIBS = " + ".join(f"(k // {1 << i}) % 2" for i in range(4))


def _entries_sql() -> str:
    rows = [f"SELECT k, 2 AS place, 'AndroidManifest.xml' AS path, 8 AS method FROM c", "SELECT k, 3, 'resources.arsc', 0 FROM c"]
    for i, abi in enumerate(("x86", "arm64-v8a", "other", "armeabi-v7a")):
        before = " + ".join(["4", *(f"(k // {1 << j}) % 2" for j in range(i))])
        rows.append(f"SELECT k, {before}, 'lib/{abi}/libc.so', 0 FROM c WHERE (k // {1 << i}) % 2 = 1")
    at = f"4 + {LIBS}"
    rows.append(f"SELECT k, {at}, '{SCAN}', 8 FROM c WHERE k % 2 = 0")
    rows.append(f"SELECT k, {at} + 1, '{ART}', 8 FROM c WHERE k % 2 = 0")
    at += " + 2 * (1 - k % 2)"
    rows.append(f"SELECT k, {at}, 'res/drawable-hdpi/alias.png', 0 FROM c WHERE k % 5 = 2")
    at += " + (k % 5 = 2)::INT"
    rows.append(f"SELECT k, {at}, '{MDPI}', 0 FROM c WHERE k % 6 = 0")
    at += " + (k % 6 = 0)::INT"
    rows += [f"SELECT k, {at} + {i}, '{p}', 0 FROM c WHERE k % 3 >= {i}" for i, p in enumerate((MDPI, XHDPI, XXHDPI))]
    return "\nUNION ALL ".join(rows)


@query("q_package_entries", f"WITH {C}, e AS ({_entries_sql()}) SELECT k AS c_custkey, place::INTEGER AS cd_index, path, method FROM e")
def package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central directories: what is listed, in which place and how it is packed."""
    return tables.entries(shops(spark, sf_dir)).select(key(), "cd_index", "path", "method")


@query("q_package_paths", f"WITH {C}, e AS ({_entries_sql()}) SELECT k AS c_custkey, path, max(place)::INTEGER AS cd_index, count(*) > 1 AS twice FROM e GROUP BY ALL")
def package_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries with one path the last counts."""
    found = tables.last_duplicates(tables.entries(shops(spark, sf_dir)), (F.count(F.lit(1)) > 1).alias("twice"))
    return found.select(key(), "path", "cd_index", "twice")


NODES = """
n AS (SELECT k, 0 AS node_id, NULL AS parent_id, 0 AS depth, 'manifest' AS tag FROM c
UNION ALL SELECT k, 1, 0, 1, 'uses-sdk' FROM c UNION ALL SELECT k, 2, 0, 1, 'uses-sdk' FROM c WHERE k % 4 = 0
UNION ALL SELECT k, 2 + (k % 4 = 0)::INT + i, 0, 1, CASE i WHEN 2 THEN 'uses-permission-sdk-23' ELSE 'uses-permission' END FROM c, (SELECT unnest(range(3)) AS i)
UNION ALL SELECT k, 5 + (k % 4 = 0)::INT, 0, 1, 'application' FROM c
UNION ALL SELECT k, 6 + (k % 4 = 0)::INT + i, 5 + (k % 4 = 0)::INT, 2, 'activity-alias' FROM c, (SELECT unnest(range(2)) AS i) WHERE k % 5 = 2)"""


@query("q_manifest_nodes", f"WITH {C}, {NODES} SELECT k AS c_custkey, node_id::INTEGER AS node_id, coalesce(parent_id, -1)::INTEGER AS parent_id, depth::INTEGER AS depth, tag FROM n")
def manifest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.xml_nodes(shops(spark, sf_dir))
    return nodes.select(key(), "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "depth", "tag")


@query("q_tag_counts", f"WITH {C}, {NODES} SELECT tag, count(*) AS n FROM n GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.xml_nodes(shops(spark, sf_dir)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_manifest_attributes",
    f"""WITH {C}, a AS (
    SELECT k, 'manifest' AS tag, 'package' AS name, 'com.' || segment || '.c' || k AS text, NULL::BIGINT AS number FROM c
    UNION ALL SELECT k, 'manifest', 'versionCode', (k % 1000)::VARCHAR, k % 1000 FROM c
    UNION ALL SELECT k, 'manifest', 'versionName', n || '.' || k, NULL FROM c WHERE n % 2 = 1
    UNION ALL SELECT k, 'uses-sdk', 'minSdkVersion', (14 + n % 10)::VARCHAR, 14 + n % 10 FROM c
    UNION ALL SELECT k, 'uses-sdk', 'targetSdkVersion', (24 + k % 10)::VARCHAR, 24 + k % 10 FROM c WHERE k % 3 > 0
    UNION ALL SELECT k, 'uses-sdk', 'minSdkVersion', '20', 20 FROM c WHERE k % 4 = 0
    UNION ALL SELECT k, 'uses-permission', 'name', 'P' || n % 7, NULL FROM c
    UNION ALL SELECT k, 'uses-permission', 'name', 'P' || (n + k) % 7, NULL FROM c
    UNION ALL SELECT k, 'uses-permission', 'maxSdkVersion', (20 + n)::VARCHAR, 20 + n FROM c
    UNION ALL SELECT k, 'uses-permission', 'required', CASE k % 2 WHEN 0 THEN 'true' ELSE 'false' END, NULL FROM c
    UNION ALL SELECT k, 'uses-permission-sdk-23', 'name', ' P' || n % 7 || ' ', NULL FROM c
    UNION ALL SELECT k, 'uses-permission-sdk-23', 'maxSdkVersion', '99', 99 FROM c
    UNION ALL SELECT k, 'application', 'label', CASE k % 2 WHEN 1 THEN '@7f010000' ELSE name END, NULL FROM c
    UNION ALL SELECT k, 'application', 'icon', CASE k % 5 WHEN 0 THEN '@7f020000' WHEN 4 THEN '@7f020001' ELSE '@mipmap/ic_launcher' END, NULL FROM c WHERE k % 5 IN (0, 1, 4)
    UNION ALL SELECT k, 'activity-alias', 'enabled', 'false', NULL FROM c WHERE k % 5 = 2
    UNION ALL SELECT k, 'activity-alias', 'icon', unnest(['@drawable/no', '@drawable/alias']), NULL FROM c WHERE k % 5 = 2)
    SELECT k AS c_custkey, tag, name, text, coalesce(number, -1)::INTEGER AS number FROM a""",
)
def manifest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as text and as number, whatever type they are written in."""
    rows = tables.manifest_rows(shops(spark, sf_dir)).where("name IS NOT NULL")
    return rows.select(key(), "tag", "name", metadata.attribute_text().alias("text"), F.coalesce(metadata.attribute_int(), F.lit(-1)).alias("number"))


VALUES = f"""
v AS (SELECT k, 2130771968 AS res_id, 0 AS config_ord, CASE k % 4 WHEN 1 THEN 'reference' ELSE 'string' END AS kind, CASE k % 4 WHEN 1 THEN '' ELSE 'Label ' || name END AS str,
 0 AS argb, CASE k % 4 WHEN 1 THEN 2130771969 ELSE 0 END AS ref_id FROM c
UNION ALL SELECT k, 2130771969, 0, 'string', 'Long ' || name, 0, 0 FROM c
UNION ALL SELECT k, 2130837504, i, 'path', ['{SCAN}', '{XXHDPI}', '{MDPI}'][i + 1], 0, 0 FROM c, (SELECT unnest(range(3)) AS i)
UNION ALL SELECT k, 2130837505, 0, 'reference', '', 0, 2130837504 FROM c
UNION ALL SELECT k, 2130837506, 0, 'path', '{ART}', 0, 0 FROM c
UNION ALL SELECT k, 2130903040, 0, 'colour', '', argb, 0 FROM c)"""


@query("q_resource_values", f"WITH {C}, {VALUES} SELECT k AS c_custkey, res_id::INTEGER AS res_id, config_ord::INTEGER AS config_ord, kind, str, argb::INTEGER AS argb, ref_id::INTEGER AS ref_id FROM v")
def resource_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("argb", "ref_id")]
    return tables.res_values(shops(spark, sf_dir)).select(key(), "res_id", "config_ord", "kind", F.coalesce("str", F.lit("")).alias("str"), *zero)


@query(
    "q_resource_references",
    f"""WITH {C}, {VALUES} SELECT k AS c_custkey, res_id::INTEGER AS res_id, str, 0::INTEGER AS steps FROM v WHERE kind IN ('string', 'path')
    UNION ALL SELECT k, 2130771968, 'Long ' || name, 1 FROM c WHERE k % 4 = 1
    UNION ALL SELECT k, 2130837505, unnest(['{SCAN}', '{XXHDPI}', '{MDPI}']), 1 FROM c""",
)
def resource_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every resource, references followed. Each step joins the values again, so they are read from the blobs once."""
    found = metadata.resolve_references(tables.res_values(shops(spark, sf_dir)).persist()).where("str IS NOT NULL")
    return found.select(key(), F.col("root").alias("res_id"), "str", (F.size("route") - 1).alias("steps"))


#: Metadata as columns that both sides write alike.
METADATA_SQL = f"""
WITH {C}, p AS (
  SELECT k, 'P' || n % 7 || ':-:true' AS text FROM c
  UNION ALL SELECT k, 'P' || (n + k) % 7 || ':' || (20 + n) || ':' || CASE k % 2 WHEN 0 THEN 'true' ELSE 'false' END FROM c WHERE k % 7 > 0),
l AS (SELECT k, unnest(['x86', 'arm64-v8a', 'armeabi-v7a']) AS abi, unnest([k % 2, (k // 2) % 2, (k // 8) % 2]) AS there FROM c)
SELECT k AS c_custkey, 'com.' || segment || '.c' || k AS package_name,
 CASE WHEN k % 2 = 0 THEN name WHEN k % 4 = 1 THEN 'Long ' || name ELSE 'Label ' || name END AS application_label,
 greatest(k % 1000, 1)::INTEGER AS version_code, CASE n % 2 WHEN 1 THEN n || '.' || k ELSE '-' END AS version_name,
 CASE k % 4 WHEN 0 THEN 20 ELSE 14 + n % 10 END::INTEGER AS min_sdk,
 CASE WHEN k % 3 > 0 THEN 24 + k % 10 WHEN k % 4 = 0 THEN 20 ELSE 14 + n % 10 END::INTEGER AS target_sdk,
 coalesce((SELECT string_agg(abi, ',' ORDER BY abi) FROM l WHERE l.k = c.k AND there = 1), '') AS architectures,
 (SELECT string_agg(text, ',' ORDER BY text) FROM p WHERE p.k = c.k) AS permissions,
 CASE k % 5 WHEN 0 THEN '@7f020000' WHEN 1 THEN '@mipmap/ic_launcher' WHEN 2 THEN '@drawable/alias' WHEN 4 THEN '@7f020001' ELSE '-' END AS launcher_icon_ref
FROM c"""


def flat_metadata(found: DataFrame) -> DataFrame:
    one = F.transform("permissions", lambda p: F.concat_ws(":", p["name"], F.coalesce(p["max_sdk_version"].cast("string"), F.lit("-")), p["required"].cast("string")))
    missing = [F.coalesce(c, F.lit("-")).alias(c) for c in ("version_name", "launcher_icon_ref")]
    names = ["package_name", "application_label", "version_code", "min_sdk", "target_sdk"]
    return found.select(key(), *names, *missing, F.array_join("architectures", ",").alias("architectures"), F.array_join(one, ",").alias("permissions"))


@query("q_metadata_fixture", METADATA_SQL)
def metadata_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, derived where a package is read."""
    return flat_metadata(metadata.metadata(shops(spark, sf_dir)))


@query("q_metadata_tables", METADATA_SQL)
def metadata_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the tables of attributes, entries and resource values."""
    df = shops(spark, sf_dir)
    return flat_metadata(metadata.metadata_of(tables.manifest_rows(df), tables.entries(df), metadata.texts_of(tables.res_values(df).persist())))


@query(
    "q_permissions",
    f"""WITH {C} SELECT k AS c_custkey, 'P' || n % 7 AS name, -1::INTEGER AS max_sdk_version, true AS required FROM c
    UNION ALL SELECT k, 'P' || (n + k) % 7, 20 + n, k % 2 = 0 FROM c WHERE k % 7 > 0""",
)
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.permissions(shops(spark, sf_dir))
    return found.select(key(), "name", F.coalesce("max_sdk_version", F.lit(-1)).alias("max_sdk_version"), "required")


@query(
    "q_icon_inspect",
    f"""WITH {C} SELECT k AS c_custkey, CASE k % 5 WHEN 0 THEN '@7f020000' WHEN 1 THEN '@mipmap/ic_launcher' WHEN 2 THEN '@drawable/alias' WHEN 4 THEN '@7f020001' ELSE '-' END AS icon_ref,
    CASE WHEN k % 5 = 2 THEN 'res/drawable-hdpi/alias.png' WHEN k % 5 IN (0, 4) AND k % 2 = 0 THEN '{ART}'
    WHEN k % 5 IN (0, 4) THEN CASE k % 3 WHEN 2 THEN '{XXHDPI}' ELSE '{MDPI}' END ELSE {BEST} END AS resolved_path FROM c""",
)
def icon_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icons.inspect(shops(spark, sf_dir)).select(key(), F.coalesce("icon_ref", F.lit("-")).alias("icon_ref"), "resolved_path")


def _corner_and_centre(png: bytes) -> tuple[int, int, int, int]:
    bitmap = images.decode(png)
    height, width = bitmap.shape[:2]
    argb = [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in (bitmap[0, 0], bitmap[height // 2, width // 2])]
    return height, width, *argb


@query(
    "q_icon_png",
    f"""WITH {C} SELECT k AS c_custkey, size::INTEGER AS size, size::INTEGER AS height, size::INTEGER AS width, CASE k % 5 WHEN 2 THEN 'alias' WHEN 3 THEN CASE k % 2 WHEN 0 THEN 'adaptive_scan' ELSE 'raster_scan' END ELSE 'manifest' END AS tier,
    CASE WHEN k % 5 = 2 THEN 'res/drawable-hdpi/alias.png' WHEN k % 2 = 0 THEN 'adaptive-icon' WHEN k % 5 IN (0, 4) THEN CASE k % 3 WHEN 2 THEN '{XXHDPI}' ELSE '{MDPI}' END ELSE {BEST} END AS source_path,
    4294967296 + argb AS corner, CASE WHEN k % 5 = 2 OR k % 2 = 1 THEN 4294967296 + argb ELSE 4279312947 END AS centre FROM c, (SELECT unnest([16, 24]) AS size)""",
)
def icon_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Icons rendered, encoded, decoded again: size, origin, and the pixels in the corner and in the middle."""
    found = icons.icons(shops(spark, sf_dir), IconOptions(mask="none"), sizes=(16, 24)).select("container_id", "size", "source_path", "tier", "png")
    run = lambda k, size, path, tier, png: (int(k), size, path, tier, *_corner_and_centre(png))
    return mapped(found, run, "c_custkey long, size int, source_path string, tier string, height int, width int, corner long, centre long")


@query("q_preview", f"WITH {C} SELECT k AS c_custkey, 'com.' || segment || '.c' || k AS package_name, 192 AS width, 0 AS corner_alpha FROM c")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with the masked icon: its corners are clear."""
    found = icons.preview(shops(spark, sf_dir)).select(key(), "package_name", "png")

    def run(k: int, name: str, png: bytes) -> tuple:
        _, width, corner, _ = _corner_and_centre(png)
        return k, name, width, corner >> 24

    return mapped(found, run, "c_custkey long, package_name string, width int, corner_alpha int")


@query(
    "q_raster_candidates",
    f"""WITH {C}, e AS ({_entries_sql()}), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k, path ORDER BY place DESC) = 1)
    SELECT k AS c_custkey, path, CASE path WHEN '{XXHDPI}' THEN 0 WHEN '{XHDPI}' THEN 1 ELSE 3 END::INTEGER AS distance,
    row_number() OVER (PARTITION BY k ORDER BY CASE path WHEN '{XXHDPI}' THEN 0 WHEN '{XHDPI}' THEN 1 ELSE 3 END)::INTEGER AS rank FROM b WHERE path LIKE 'res/mipmap-%.png'""",
)
def raster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.last_duplicates(tables.entries(shops(spark, sf_dir)))
    return ranking.raster_candidates(found).select(key(), "path", "distance", "rank")


@query(
    "q_adaptive_candidates",
    f"""WITH {C} SELECT k AS c_custkey, '{SCAN}' AS path, 7::INTEGER AS score, 1::INTEGER AS rank FROM c WHERE k % 2 = 0
    UNION ALL SELECT k, '{ART}', 0, 2 FROM c WHERE k % 2 = 0""",
)
def adaptive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.adaptive_candidates(tables.entries(shops(spark, sf_dir))).select(key(), "path", "score", "rank")


def bundle(supplier: int, nation: int) -> bytes:
    """A bundle of packages named by the member that holds them, or the start of one that breaks off."""
    inner = {name: write_archive([("AndroidManifest.xml", write_xml(element("manifest", package=f"in.{name.split('.')[0].lower()}")), STORED)]) for name in ("Split_base.apk", "other.apk", "base.apk", "Universal.apk")}
    names = ["other.apk", *(n for bit, n in enumerate(("Split_base.apk", "base.apk", "Universal.apk")) if supplier >> bit & 1)]
    whole = write_archive([(n, inner[n], STORED) for n in names])
    return whole[: len(whole) // 2] if nation == 0 else whole


@query(
    "q_bundles",
    """SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN '-' WHEN (s_suppkey // 4) % 2 = 1 THEN 'in.universal' WHEN (s_suppkey // 2) % 2 = 1 THEN 'in.base'
    WHEN s_suppkey % 2 = 1 THEN 'in.split_base' ELSE 'in.other' END AS package_name, s_nationkey = 0 AS broken FROM supplier""",
)
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles stand for their base package; what cannot be read gives a row with an error and stops nothing."""
    df = packages(spread(t(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")), bundle, "s_suppkey")
    read = tables.base_members(df).select("container_id", F.col("error").isNotNull().alias("broken"))
    found = metadata.metadata(df).select("container_id", "package_name")
    return read.join(tables.by_sorting(found), "container_id", "left").select(F.col("container_id").cast("long").alias("s_suppkey"), F.coalesce("package_name", F.lit("-")).alias("package_name"), "broken")


# --- images, drawings and values, one per row of a table ---


def _pictures(part: int, size: int) -> tuple:
    argb = 0xFF000000 | part * 7919 % 0xFFFFFF
    bitmap = raster.filled(size % 16 + 1, size % 7 + 1, argb - (1 << 32))
    png, jpeg = images.encode_png(bitmap), images.encode_jpeg(bitmap)
    back, near = images.decode(png), images.decode(jpeg)
    height, width, corner, _ = _corner_and_centre(png)
    same = near.shape == bitmap.shape and bool((np.abs(near.astype(int) - bitmap) <= 12).all())
    return part, png, jpeg, height, width, corner, bool((back == bitmap).all()), same, zlib.crc32(png[12:29]) == int.from_bytes(png[29:33], "big")


@query(
    "q_image_codecs",
    """SELECT p_partkey, 'png' AS png_kind, 'jpeg' AS jpeg_kind, (p_size % 7 + 1)::INTEGER AS height, (p_size % 16 + 1)::INTEGER AS width, 4278190080 + (p_partkey * 7919) % 16777215 AS argb,
    true AS png_same, true AS jpeg_near, true AS checksum FROM part""",
)
def image_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written and read back: PNG as it was, JPEG within 12 of each channel."""
    schema = "p_partkey long, png binary, jpeg binary, height int, width int, argb long, png_same boolean, jpeg_near boolean, checksum boolean"
    found = mapped(spread(t(spark, sf_dir, "part", "p_partkey", "p_size")), _pictures, schema)
    return found.select("p_partkey", image_kind(F.col("png")).alias("png_kind"), image_kind(F.col("jpeg")).alias("jpeg_kind"), "height", "width", "argb", "png_same", "jpeg_near", "checksum")


def _layers(order: int, customer: int) -> tuple:
    under, over = raster.filled(9, 9, (customer % 256) << 24 | 0x203040), raster.filled(4, 4, (order % 256) << 24 | 0xA0B0C0)
    mixed = raster.composite(under, over, 3, 3)
    whole = raster.resize(raster.filled(5, 3, 0xFF000000 - (1 << 32) | order % 65536), 8, 8)
    round_ = raster.circle_mask(raster.filled(8, 8, -1))
    a = [int(v) for v in (*mixed[5, 5], *mixed[0, 0])]
    return order, a[3], a[0], a[7], a[4], int(raster.scale_alpha(over, 0.5)[0, 0, 3]), raster.uniform(whole) + (1 << 32), int(round_[0, 0, 3]), int(round_[4, 4, 3])


@query(
    "q_bitmap_operations",
    """SELECT o_orderkey, a::INTEGER AS alpha, CASE WHEN a > 0 THEN (160 * sa + 32 * rest + a // 2) // a ELSE 0 END::INTEGER AS red, da::INTEGER AS rim_alpha, 32 AS rim_red,
    floor(sa * 0.5 + 0.5)::INTEGER AS half, 4278190080 + o_orderkey % 65536 AS resized, 0 AS corner, 255 AS centre FROM (
    SELECT *, (da * (255 - sa) + 127) // 255 AS rest, sa + (da * (255 - sa) + 127) // 255 AS a FROM (SELECT o_orderkey, o_orderkey % 256 AS sa, o_custkey % 256 AS da FROM orders))""",
)
def bitmap_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitmap laid on another, one with its alpha scaled, one resized, one masked."""
    schema = "o_orderkey long, alpha int, red int, rim_alpha int, rim_red int, half int, resized long, corner int, centre int"
    return mapped(spread(t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")), _layers, schema)


def _shape(part: int, size: int) -> tuple:
    x, y, w, h = part % 5, part % 7, size % 11 + 1, size % 6 + 1
    text = (f"M{x},{y}h{w}v{h}h-{w}z", f"m {x} {y} l{w},0 0 {h} -{w} 0Z", f"M{x} {y}L{x + w} {y}V{y + h}H{x}")[part % 3]
    commands = vector.parse_path(text)
    drawing = vector.Drawing([vector.Path(commands, vector.Solid(-1))], 24.0, 24.0)
    bitmap, twice = vector.rasterise(drawing, 24), vector.rasterise(drawing, 48)
    alpha = bitmap[..., 3]
    ys, xs = np.nonzero(alpha)
    r = size % 9 + 2
    disc = vector.Drawing([vector.Path(vector.parse_path(f"M{12 - r},12a{r},{r} 0 1,0 {2 * r},0a{r},{r} 0 1,0 -{2 * r},0"), vector.Solid(-1))], 24.0, 24.0)
    share = float(vector.rasterise(disc, 96)[..., 3].sum()) / 255 / 16 / (np.pi * r * r)
    return part, len(commands), int((alpha == 255).sum()), int(alpha.any(axis=0).sum()), int(xs.min()), int(ys.min()), int((twice[..., 3] == 255).sum()), abs(share - 1) < 0.05


@query(
    "q_drawings",
    """SELECT p_partkey, (5 - (p_partkey % 3 = 2)::INT)::INTEGER AS commands, (w * h)::INTEGER AS area, w::INTEGER AS width, (p_partkey % 5)::INTEGER AS x, (p_partkey % 7)::INTEGER AS y,
    (4 * w * h)::INTEGER AS twice, true AS disc FROM (SELECT *, p_size % 11 + 1 AS w, p_size % 6 + 1 AS h FROM part)""",
)
def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path text in three spellings, filled: covered pixels of a rectangle, and a disc of arcs within five per cent."""
    schema = "p_partkey long, commands int, area int, width int, x int, y int, twice int, disc boolean"
    return mapped(spread(t(spark, sf_dir, "part", "p_partkey", "p_size")), _shape, schema)


def _written(part: int, size: int, price: float) -> tuple:
    wide = part * 2654435761 % (1 << 32)
    unsigned = [c + (1 << 32) if c < 0 else c for c in (vector.colour(f"#{wide:08x}"), vector.colour(f"#{wide % 4096:03x}"), vector.colour(f"0x{wide % (1 << 24):06x}"))]
    bits = int(np.float32(size).view(np.uint32))
    return part, *unsigned, vector.number(f"{size}.5dp"), vector.number(f"0x{bits:x}"), vector.colour("#12") is None and vector.number("x") is None


@query(
    "q_written_values",
    """SELECT p_partkey, wide AS argb, 4278190080 + ((wide // 256) % 16) * 17 * 65536 + ((wide // 16) % 16) * 17 * 256 + (wide % 16) * 17 AS short_argb, 4278190080 + wide % 16777216 AS bare_argb,
    p_size + 0.5::DOUBLE AS measure, p_size::DOUBLE AS bits, true AS refused FROM (SELECT *, p_partkey * 2654435761 % 4294967296 AS wide FROM part)""",
)
def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and numbers in the spellings of drawable files."""
    schema = "p_partkey long, argb long, short_argb long, bare_argb long, measure double, bits double, refused boolean"
    return mapped(spread(t(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")), _written, schema)


@query("q_resource_ids", "SELECT o_orderkey, ((id // 16777216) % 256)::INTEGER AS package, ((id // 65536) % 256)::INTEGER AS type, (id % 65536)::INTEGER AS entry FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS id FROM orders)")
def resource_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    package, kind, entry = resource_id(F.expr("o_orderkey * 2654435761 % 4294967296"))
    return t(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", package.alias("package"), kind.alias("type"), entry.alias("entry"))
