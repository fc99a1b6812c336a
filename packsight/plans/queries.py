"""Queries over the driver's relational tables: each applies one rule of the engine there, with its DuckDB equivalent.

The rules are those of ``operators`` and ``functions``; the tables stand in for packages (suppliers as containers,
parts as candidates, events as attributes and so on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsight.functions.columns import hex_colour
from packsight.functions.vector import lut
from packsight.operators import icons, metadata, ranking, rules, tables
from packsight.operators.rules import target_rank_col
from packsight.plans.registry import ORACLE, QUERIES, Query, query, t
from packsight.sources import chunks


def bucket(size: Column) -> Column:
    """A part's size as the dpi of a candidate: 12 dpi a unit."""
    return target_rank_col(size * 12)


BUCKET_SQL = "CASE WHEN {0} * 12 >= 560 THEN 0 WHEN {0} * 12 >= 400 THEN 1 WHEN {0} * 12 >= 280 THEN 2 WHEN {0} * 12 >= 200 THEN 3 WHEN {0} * 12 >= 140 THEN 4 ELSE 5 END"


@query(
    "q_candidate_fallback",
    f"""
    WITH c AS (SELECT DISTINCT l_suppkey, p_partkey, p_retailprice, {BUCKET_SQL.format('p_size')} AS bucket
               FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 47 AND p_type = 'PROMO'),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(bucket - 1), p_retailprice DESC, p_partkey) AS rank FROM c)
    SELECT s_suppkey, coalesce(p_partkey, -1)::BIGINT AS partkey, coalesce(bucket, 50)::INTEGER AS bucket
    FROM supplier LEFT JOIN (SELECT * FROM r WHERE rank = 1) ON l_suppkey = s_suppkey""",
)
def candidate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest bucket, then dearer, then smaller key; containers without a candidate fall back."""
    parts = t(spark, sf_dir, "part", "p_partkey", "p_type", "p_size", "p_retailprice").where("p_type = 'PROMO'")
    returned = t(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' AND l_quantity >= 47")
    candidates = returned.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("bucket", bucket(F.col("p_size")))
    first = ranking.best(candidates, ["l_suppkey"], [F.abs(F.col("bucket") - 1), -F.col("p_retailprice"), F.col("p_partkey")])
    suppliers = t(spark, sf_dir, "supplier", "s_suppkey")
    joined = suppliers.join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("s_suppkey", ranking.tiers("p_partkey", F.lit(-1)).cast("long").alias("partkey"), ranking.tiers("bucket", F.lit(50)).cast("int").alias("bucket"))


@query(
    "q_rank_top1",
    f"""SELECT p_brand, p_partkey, p_retailprice FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs({BUCKET_SQL.format('p_size')} - 1), p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank = 1""",
)
def rank_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t(spark, sf_dir, "part", "p_brand", "p_partkey", "p_retailprice", "p_size")
    order = [F.abs(bucket(F.col("p_size")) - 1), -F.col("p_retailprice"), F.col("p_partkey")]
    return ranking.best(parts, ["p_brand"], order).select("p_brand", "p_partkey", "p_retailprice")


@query(
    "q_first_wins",
    """SELECT user_id, event_type AS name, arg_min(floor(value)::INTEGER, event_id) AS max_sdk_version, arg_min(event_id % 3 > 0, event_id) AS required
    FROM events GROUP BY ALL""",
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as packages that declare their events: of each name the first declaration counts."""
    declared = t(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value").select(
        "user_id", F.lit("uses-permission").alias("tag"), F.col("event_id").alias("node_id"), F.concat(F.lit(" "), "event_type").alias("a_name"),
        F.floor("value").cast("int").alias("a_maxSdkVersion"), F.when(F.col("event_id") % 3 == 0, "No").otherwise("yes").alias("a_required"),
    )
    listed = declared.groupBy("user_id").agg(metadata.declared_permissions().alias("listed"))
    return listed.select("user_id", F.explode(metadata.first_of_each("listed")).alias("p")).select("user_id", "p.*")


@query(
    "q_first_last",
    """SELECT user_id, coalesce(arg_min(value, event_id) FILTER (WHERE event_type = 'click' AND value > 100), -1) AS label,
    coalesce(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), -1) AS sdk FROM events GROUP BY user_id""",
)
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that a kind of node has, and the last."""
    nodes = t(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value").withColumnsRenamed({"event_id": "node_id", "event_type": "tag"})
    first, last = metadata.first_in("click", F.when(F.col("value") > 100, F.col("value"))), metadata.last_in("purchase", F.col("value"))
    return nodes.groupBy("user_id").agg(F.coalesce(first, F.lit(-1.0)).alias("label"), F.coalesce(last, F.lit(-1.0)).alias("sdk"))


ABI_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, a in (("click", "x86"), ("view", "arm64-v8a"), ("purchase", "armeabi"))) + " END"


@query("q_sorted_distinct", f"SELECT user_id, string_agg(DISTINCT {ABI_SQL}, ',' ORDER BY {ABI_SQL}) AS abis FROM events WHERE {ABI_SQL} IS NOT NULL GROUP BY user_id")
def sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as packages with a library for each event: the distinct ABIs, sorted."""
    events = t(spark, sf_dir, "events", "user_id", "event_type")
    entries = events.select(F.col("user_id").alias("container_id"), F.concat(F.lit("lib/"), F.expr(ABI_SQL.replace(" END", " ELSE event_type END")), F.lit("/libx.so")).alias("path"))
    return metadata.architectures_of(entries).select(F.col("container_id").alias("user_id"), F.array_join("architectures", ",").alias("abis"))


@query(
    "q_lower_percentile",
    """SELECT event_type, value AS p95 FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    WHERE r = floor((n - 1) * 0.95) + 1""",
)
def lower_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact order statistic from counts of values: no group is held or sorted as a list."""
    events = t(spark, sf_dir, "events", "event_type", "value")
    return ranking.order_statistic(events, "event_type", "value", 0.95).select("event_type", F.col("value").alias("p95"))


@query(
    "q_stats",
    """SELECT stage, count(*) AS n, round(sum(ms), 4) AS total_ms, min(ms) AS min_ms, round(avg(ms), 6) AS avg_ms, round(stddev_pop(ms), 6) AS std_ms, max(ms) AS max_ms,
    max(ms) FILTER (WHERE r = (n - 1) // 2 + 1) AS p50_ms, max(ms) FILTER (WHERE r = floor((n - 1) * 0.95) + 1) AS p95_ms FROM (
    SELECT event_type AS stage, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY stage""",
)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage report, over events as timings."""
    report = icons.stage_report(t(spark, sf_dir, "events", "event_type", "value").toDF("stage", "ms"))
    return report.withColumns({"total_ms": F.round("total_ms", 4), "avg_ms": F.round("avg_ms", 6), "std_ms": F.round("std_ms", 6)})


@query(
    "q_tier_coalesce",
    """SELECT event_id, coalesce(CASE WHEN value > 400 THEN 'manifest' END, CASE WHEN event_type = 'purchase' THEN 'alias' END,
    CASE WHEN user_id % 5 = 0 THEN 'scan' END, 'none') AS tier FROM events""",
)
def tier_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events", "event_id", "value", "event_type", "user_id")
    found = [F.when(F.col("value") > 400, "manifest"), F.when(F.col("event_type") == "purchase", "alias"), F.when(F.col("user_id") % 5 == 0, "scan"), F.lit("none")]
    return events.select("event_id", ranking.tiers(*found).alias("tier"))


@query("q_exists_semi", "SELECT c_custkey AS container_id, c_mktsegment AS path FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths of packages are there."""
    return tables.existing(*_paths_and_entries(spark, sf_dir))


@query("q_missing_anti", "SELECT c_custkey AS container_id, c_mktsegment AS path FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing(*_paths_and_entries(spark, sf_dir))


def _paths_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers ask for a path; those with a dear order have it."""
    paths = t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").toDF("container_id", "path")
    dear = t(spark, sf_dir, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 490000").select(F.col("o_custkey").alias("container_id"))
    return paths, dear.join(paths, "container_id")


FOLDER = "CASE p_partkey % 4 WHEN 0 THEN 'mipmap' WHEN 1 THEN 'drawable' WHEN 2 THEN 'layout' ELSE 'Mipmap' END"
DENSITY = "CASE p_size % 8 WHEN 0 THEN '-xxxhdpi' WHEN 1 THEN '-XXHDPI' WHEN 2 THEN '-xhdpi' WHEN 3 THEN '-hdpi' WHEN 4 THEN '-mdpi' WHEN 5 THEN '-ldpi' WHEN 6 THEN '-anydpi-v26' ELSE '' END"
FILE = "CASE p_partkey % 3 WHEN 0 THEN 'ic_launcher_round' WHEN 1 THEN 'launcher_icon' ELSE 'logo' END"
ENDING = "CASE p_partkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.xml' WHEN 2 THEN '.WEBP' WHEN 3 THEN '.jpeg' ELSE '.txt' END"


@query(
    "q_prefix_filter",
    """SELECT p_partkey, p_partkey % 4 != 2 AND p_partkey % 3 != 2 AND p_partkey % 5 IN (0, 2, 3) AS raster, p_partkey % 5 = 1 AS adaptive,
    (4 * (p_partkey % 4 IN (0, 3))::INT + 3 * (p_partkey % 3 != 2)::INT)::INTEGER AS score,
    CASE p_size % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 0 ELSE 50 END::INTEGER AS distance FROM part""",
)
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as paths: which are launcher images or adaptive documents, how they score, how far their density is."""
    path = F.expr(f"concat('res/', {FOLDER}, {DENSITY}, '/', {FILE}, {ENDING})")
    return t(spark, sf_dir, "part", "p_partkey", "p_size").select(
        "p_partkey", rules.is_raster_candidate_col(path).alias("raster"), rules.is_adaptive_candidate_col(path).alias("adaptive"),
        rules.adaptive_score_col(path).alias("score"), rules.density_distance_col(path, 480).alias("distance"),
    )


@query(
    "q_path_split",
    """SELECT p_partkey, CASE WHEN p_size % 5 < 3 AND p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN ['x86_64', 'mips', 'arm64-v8a'][p_size % 5 + 1] ELSE '-' END AS abi FROM part""",
)
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as library paths: the ABI, if folder, name and ending are right."""
    path = F.expr("concat(if(p_partkey % 3 = 0, 'lib/', 'libs/'), element_at(array('x86_64', 'mips', 'arm64-v8a', 'sparc', ''), p_size % 5 + 1), '/libz', if(p_partkey % 2 = 0, '.so', '.a'))")
    return t(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.coalesce(rules.abi_col(path), F.lit("-")).alias("abi"))


@query(
    "q_reference_chain",
    """WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN value < 300 THEN event_id - 1 - (user_id * 7 + event_id) % 900 END AS ref, event_type FROM events),
    chain AS (SELECT id AS root, ref, event_type, 0 AS steps FROM e
              UNION ALL SELECT root, e.ref, e.event_type, steps + 1 FROM chain JOIN e ON e.id = chain.ref WHERE steps < 6)
    SELECT root::INTEGER AS root, event_type AS str, steps::INTEGER AS steps FROM chain WHERE ref IS NULL""",
)
def reference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as resources: small ones refer to an earlier event, and references are followed at most six times."""
    events = t(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    ref = F.when(F.col("value") < 300, F.expr("event_id - 1 - (user_id * 7 + event_id) % 900")).cast("int")
    values = events.select(
        F.lit("all").alias("container_id"), F.col("event_id").cast("int").alias("res_id"), F.lit(0).alias("config_ord"), F.lit(0).alias("value_ord"),
        F.when(ref.isNotNull(), "reference").otherwise("string").alias("kind"), F.when(ref.isNull(), F.col("event_type")).alias("str"),
        F.lit(None).cast("int").alias("argb"), ref.alias("ref_id"), F.lit(None).cast("string").alias("error"),
    )
    return metadata.resolve_references(values).select("root", "str", (F.size("route") - 1).alias("steps"))


@query("q_argb_split", "SELECT o_orderkey, (h >> 24) & 255 AS a, (h >> 16) & 255 AS r, (h >> 8) & 255 AS g, h & 255 AS b FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS h FROM orders)")
def argb_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsight.functions.columns import channels

    orders = t(spark, sf_dir, "orders", "o_orderkey").withColumn("h", F.expr("o_orderkey * 2654435761 % 4294967296"))
    return orders.select("o_orderkey", *[c.alias(n) for n, c in zip("argb", channels(F.col("h")), strict=True)])


@query(
    "q_src_over",
    """SELECT l_orderkey, l_linenumber, a, CASE WHEN a > 0 THEN (c1 * sa + c2 * rest + a // 2) // a ELSE 0 END AS c FROM (
    SELECT *, (da * (255 - sa) + 127) // 255 AS rest, sa + (da * (255 - sa) + 127) // 255 AS a FROM (
    SELECT l_orderkey, l_linenumber, l_partkey % 256 AS sa, l_suppkey % 256 AS da, l_orderkey % 256 AS c1, (l_orderkey // 256) % 256 AS c2 FROM lineitem))""",
)
def src_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsight.functions.columns import source_over

    lines = t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a, c = source_over(F.col("l_partkey") % 256, F.col("l_orderkey") % 256, F.col("l_suppkey") % 256, F.expr("(l_orderkey div 256) % 256"))
    return lines.select("l_orderkey", "l_linenumber", a.alias("a"), c.alias("c"))


@query("q_smoothstep", "SELECT event_id, round(s * s * (3 - 2 * s), 9) AS fade FROM (SELECT event_id, greatest(0, least(1, value / 400)) AS s FROM events)")
def smoothstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsight.functions.columns import fade

    return t(spark, sf_dir, "events", "event_id", "value").select("event_id", F.round(fade(F.col("value") / 400), 9).alias("fade"))


@query(
    "q_hex_ref",
    """SELECT c_custkey, ref, ('0x' || substr(ref, 2))::BIGINT AS id FROM (
    SELECT c_custkey, '@' || lpad(lower(to_hex((2130837504 + c_custkey * 65537) % 4294967296)), 8, '0') AS ref FROM customer)""",
)
def hex_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id as a reference and, read as a colour, back."""
    ref = metadata.hex_ref(F.expr("(2130837504 + c_custkey * 65537) % 4294967296"))
    refs = t(spark, sf_dir, "customer", "c_custkey").select("c_custkey", ref.alias("ref"))
    return refs.withColumn("id", hex_colour(F.concat(F.lit("#"), F.substring("ref", 2, 8))))


@query(
    "q_type_widening",
    """WITH a AS (SELECT p_brand, p_partkey, ['drawable', 'mipmap', 'layout', 'color'][p_size % 4 + 1] AS kind FROM part),
    e AS (SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'mipmap' WHEN 1 THEN 'drawable' ELSE 'layout' END AS kind FROM part WHERE p_partkey % 5 < 4)
    SELECT p_brand AS container_id, a.kind AS asked, 'n' || p_partkey AS res_name, 'res/' || e.kind || '-hdpi/n' || p_partkey || '.png' AS path
    FROM a JOIN e USING (p_brand, p_partkey) WHERE a.kind = e.kind OR (a.kind IN ('drawable', 'mipmap') AND e.kind IN ('drawable', 'mipmap'))
    UNION ALL SELECT p_brand, a.kind, 'n' || p_partkey, 'r/a/N' || p_partkey || '.png' FROM a LEFT JOIN e USING (p_brand, p_partkey)
    WHERE a.kind != 'color' AND coalesce(NOT (a.kind = e.kind OR (a.kind IN ('drawable', 'mipmap') AND e.kind IN ('drawable', 'mipmap'))), true) AND p_partkey % 2 = 0""",
)
def type_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as packages, parts as names that are looked up: drawable and mipmap stand in for each other, short paths for
    names without a long one."""
    parts = t(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size").withColumnRenamed("p_brand", "container_id")
    refs = parts.select("container_id", F.expr("element_at(array('drawable', 'mipmap', 'layout', 'color'), p_size % 4 + 1)").alias("res_type"), F.expr("concat('n', p_partkey)").alias("res_name"))
    long = parts.where("p_partkey % 5 < 4").select("container_id", "p_partkey", F.expr("concat('res/', element_at(array('mipmap', 'drawable', 'layout'), cast(p_partkey % 3 + 1 as int)), '-hdpi/n', p_partkey, '.png')").alias("path"))
    short = parts.where("p_partkey % 2 = 0").select("container_id", "p_partkey", F.expr("concat('r/a/N', p_partkey, '.png')").alias("path"))
    entries = long.unionByName(short).select("container_id", "path", F.lit(1).cast("long").alias("usize"), F.col("p_partkey").cast("int").alias("cd_index"))
    return ranking.by_name(refs, entries).select("container_id", "asked", "res_name", "path")


@query(
    "q_json_attr",
    """SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN user_id ELSE coalesce(try_cast(raw AS INTEGER), -1) END::INTEGER AS number,
    coalesce(CASE event_id % 5 WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN user_id::VARCHAR WHEN 3 THEN CASE WHEN user_id != 0 THEN 'true' ELSE 'false' END
    WHEN 4 THEN coalesce(nullif(raw, ''), '@' || lpad(lower(to_hex(user_id)), 8, '0')) ELSE nullif(raw, '') END, '-') AS text,
    raw NOT IN ('0', 'no') AS flag FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE regexp_extract(props, '([0-9]+)', 1) END AS raw FROM events)""",
)
def json_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attributes of five types: their number, their text, and whether they are true."""
    types = f"element_at(array({chunks.T_STRING}, {chunks.T_DEC}, {chunks.T_HEX}, {chunks.T_BOOL}, {chunks.T_REFERENCE}), cast(event_id % 5 + 1 as int))"
    rows = t(spark, sf_dir, "events", "event_id", "user_id", "props").select(
        "event_id", F.expr("if(event_id % 7 = 0, '', regexp_extract(props, '([0-9]+)', 1))").alias("raw"), F.expr(types).alias("vtype"), F.col("user_id").cast("int").alias("vdata")
    )
    text = F.coalesce(metadata.attribute_text(), F.lit("-"))
    return rows.select("event_id", F.coalesce(metadata.attribute_int(), F.lit(-1)).alias("number"), text.alias("text"), metadata.boolean_text(F.col("raw")).alias("flag"))


@query(
    "q_affine",
    """SELECT p_partkey, round(20 + 10 + (p_retailprice - 10) * 2 * cos(pi() / 6) - (p_size - 5) * 3 * sin(pi() / 6), 6) AS x,
    round(30 + 5 + (p_retailprice - 10) * 2 * sin(pi() / 6) + (p_size - 5) * 3 * cos(pi() / 6), 6) AS y FROM part""",
)
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsight.functions.columns import transformed
    from packsight.functions.vector import group

    x, y = transformed(F.col("p_retailprice"), F.col("p_size"), group(20, 30, 2, 3, 30, 10, 5))
    return t(spark, sf_dir, "part", "p_partkey", "p_retailprice", "p_size").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(
    "q_gradient_lut",
    """WITH lut AS (SELECT i, 255 * (1 - i / 255.0::DOUBLE) + 51 * (i / 255.0::DOUBLE) AS a, 17 * (1 - i / 255.0::DOUBLE) + 200 * 0.2::DOUBLE * (i / 255.0::DOUBLE) AS pre FROM (SELECT unnest(range(256)) AS i))
    SELECT event_id, i::INTEGER AS i, round(pre * 255 / a, 5) AS red, round(a, 5) AS alpha FROM events JOIN lut ON i = least(255, greatest(0, floor(value / 490 * 255 + 0.5)::BIGINT))""",
)
def gradient_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gradient's 256 colours, mixed premultiplied, as a table: its size is fixed, so it is broadcast."""
    colours = [(i, float(c[0]), float(c[3])) for i, c in enumerate(lut(((0.0, 0xFF110000), (1.0, 0x33C80000))))]
    table = spark.createDataFrame(colours, "i int, red double, alpha double").select("i", F.round("red", 5).alias("red"), F.round("alpha", 5).alias("alpha"))
    step = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("value") / 490 * 255 + 0.5))).cast("int")
    return t(spark, sf_dir, "events", "event_id", "value").select("event_id", step.alias("i")).join(F.broadcast(table), "i").select("event_id", "i", "red", "alpha")


@query("q_density_distance", f"SELECT bucket::INTEGER AS bucket, count(*) AS n FROM (SELECT {BUCKET_SQL.format('p_size')} AS bucket FROM part) GROUP BY bucket")
def density_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part", "p_size").groupBy(bucket(F.col("p_size")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


PLACE = "(l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"


@query("q_lww_dup", f"SELECT l_suppkey AS container_id, l_partkey AS path, max({PLACE}) AS cd_index, arg_max(l_extendedprice, {PLACE}) AS usize FROM lineitem GROUP BY ALL")
def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages, line items as entries: of those with one path the last counts."""
    lines = t(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    entries = lines.select(F.col("l_suppkey").alias("container_id"), F.col("l_partkey").alias("path"), F.expr(PLACE).alias("cd_index"), F.col("l_extendedprice").alias("usize"), F.lit(None).cast("string").alias("error"))
    return tables.last_duplicates(entries)


from packsight.plans import package_queries  # noqa: E402, F401 - it adds its queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
