"""Package metadata: in one pass over each blob, or as a Catalyst plan over the node, attribute, entry and resource tables.

``metadata`` reads a container once and shuffles nothing. For tables that were written earlier, ``metadata_of`` and its
parts say the same with grouped aggregates and equi-joins on container_id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsight.operators import rules, tables
from packsight.operators.package import Package
from packsight.operators.rules import abi_col
from packsight.sources import chunks
from packsight.sources.chunks import named

PERMISSION_TAGS = ("uses-permission", "uses-permission-sdk-23")


def not_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def named_col(name: str) -> Column:
    return (F.col("name") == name) | F.col("name").endswith(f":{name}")


def hex_ref(data: Column) -> Column:
    """``@`` and eight hex digits of a 32-bit id."""
    return F.concat(F.lit("@"), F.lpad(F.lower(F.hex(data.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))


def attribute_text() -> Column:
    """An attribute of xml_attrs as metadata text; null lets a later attribute of the name count."""
    raw = not_blank(F.col("raw"))
    return (
        F.when(F.col("vtype") == chunks.T_REFERENCE, F.coalesce(raw, hex_ref(F.col("vdata"))))
        .when(F.col("vtype").isin(chunks.T_DEC, chunks.T_HEX), F.col("vdata").cast("string"))
        .when(F.col("vtype") == chunks.T_BOOL, F.when(F.col("vdata") != 0, "true").otherwise("false"))
        .otherwise(raw)
    )


def attribute_int() -> Column:
    typed = F.when(F.col("vtype").isin(chunks.T_DEC, chunks.T_HEX), F.col("vdata"))
    return F.coalesce(typed, F.when(F.col("raw").rlike("^[+-]?[0-9]+$"), F.expr("try_cast(raw AS int)")))


def boolean_text(c: Column) -> Column:
    """true, 1, yes; false, 0, no; anything else is true."""
    return ~F.lower(F.trim(c)).isin("false", "0", "no")


def attributes_by_node(manifest: DataFrame) -> DataFrame:
    """One row per node with the attributes that metadata reads, the first of each name that has a value.

    Rows are dealt by container alone, before they are aggregated: the grouping by node here and that by container later
    both accept it, so there is one shuffle, of the attribute rows.
    """
    wanted = {
        "package": attribute_text(), "versionCode": attribute_int(), "versionName": attribute_text(), "minSdkVersion": attribute_int(),
        "targetSdkVersion": attribute_int(), "label": attribute_text(), "icon": attribute_text(), "enabled": attribute_text(),
        "name": attribute_text(), "required": attribute_text(), "maxSdkVersion": attribute_int(),
    }
    picked = [F.min_by(value, F.when(named_col(n) & value.isNotNull(), F.col("ord"))).alias(f"a_{n}") for n, value in wanted.items()]
    return manifest.where("error IS NULL").repartition("container_id").groupBy("container_id", "node_id", "parent_id", "tag").agg(*picked)


def declared_permissions() -> Column:
    """Of a container's nodes, the permissions by name, the first declaration of each."""
    name = F.trim("a_name")
    required = F.coalesce(boolean_text(F.col("a_required")), F.lit(True))
    row = F.struct(name.alias("name"), F.col("node_id"), F.col("a_maxSdkVersion").alias("max_sdk_version"), required.alias("required"))
    return F.array_sort(F.collect_list(F.when(F.col("tag").isin(*PERMISSION_TAGS) & (name != ""), row)))


def first_of_each(listed: str) -> Column:
    distinct = F.filter(listed, lambda x, i: (i == 0) | (F.get(F.col(listed), i - 1)["name"] != x["name"]))
    return F.transform(distinct, lambda x: F.struct(x["name"].alias("name"), x["max_sdk_version"].alias("max_sdk_version"), x["required"].alias("required")))


def permissions_of(manifest: DataFrame) -> DataFrame:
    """(container_id, name, max_sdk_version, required)."""
    listed = attributes_by_node(manifest).groupBy("container_id").agg(declared_permissions().alias("listed"))
    return listed.select("container_id", F.explode(first_of_each("listed")).alias("p")).select("container_id", "p.*")


def architectures_of(entries: DataFrame) -> DataFrame:
    """(container_id, architectures): the distinct ABIs of native libraries, sorted."""
    found = entries.select("container_id", abi_col(F.col("path")).alias("abi")).where("abi IS NOT NULL")
    return found.groupBy("container_id").agg(F.array_sort(F.collect_set("abi")).alias("architectures"))


def resolve_references(values: DataFrame, depth: int = 6) -> DataFrame:
    """(container_id, root, str, argb, route): values with references followed, at most ``depth`` of them, cycles cut.

    route orders a root's values: the order of each step on the way. A bounded unrolled join rather than a recursive
    query: each step is an equi-join on (container_id, res_id) whose plan Catalyst sees whole.
    """
    good = values.where("error IS NULL").select("container_id", "res_id", F.struct("config_ord", "value_ord").alias("at"), "kind", "str", "argb", "ref_id")
    step = good.select("container_id", F.col("res_id").alias("root"), F.array("res_id").alias("seen"), F.array("at").alias("route"), "kind", "str", "argb", "ref_id")
    out = step.where("kind != 'reference'").select("container_id", "root", "kind", "str", "argb", "route")
    for _ in range(depth):
        onward = step.where("kind = 'reference' AND NOT array_contains(seen, ref_id)").select("container_id", "root", "seen", "route", F.col("ref_id").alias("res_id"))
        step = onward.join(tables.by_sorting(good), ["container_id", "res_id"]).select(
            "container_id", "root", F.array_append("seen", F.col("res_id")).alias("seen"), F.array_append("route", F.col("at")).alias("route"), "kind", "str", "argb", "ref_id"
        )
        out = out.unionByName(step.where("kind != 'reference'").select("container_id", "root", "kind", "str", "argb", "route"))
    return out


def texts_of(values: DataFrame) -> DataFrame:
    """(container_id, res_id, str): the first text that is not blank, from a res_values table."""
    good = resolve_references(values).where("trim(str) != ''")
    return good.groupBy("container_id", "root").agg(F.min_by("str", "route").alias("str")).withColumnRenamed("root", "res_id")


def label_texts(df: DataFrame) -> DataFrame:
    """The same for the label of each container's application alone, resolved where the blob is read."""

    def rows(data: bytes) -> list[tuple]:
        found = Package(data)
        if found.manifest is None or found.table is None:
            return []
        labels = [a for n in found.manifest.walk() if n.tag == "application" for a in n.attributes if named(a, "label")]
        written = [re.fullmatch(r"@(?:0[xX])?([0-9a-fA-F]{1,8})", a.raw or "") for a in labels]
        ids = [a.data for a in labels if a.type == chunks.T_REFERENCE] + [chunks.signed(int(m[1], 16)) for m in written if m]
        return [(i, found.table.string(i)) for i in dict.fromkeys(ids)]

    return tables.flat_map(df, rows, "container_id string, res_id int, str string")


def _in(tag: str, value: Column) -> Column:
    return F.when((F.col("tag") == tag) & value.isNotNull(), F.col("node_id"))


def first_in(tag: str, value: Column) -> Column:
    """Aggregates nodes: the first value that a node of this tag has."""
    return F.min_by(value, _in(tag, value))


def last_in(tag: str, value: Column) -> Column:
    return F.max_by(value, _in(tag, value))


def metadata_of(manifest: DataFrame, entries: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per container whose manifest names a package."""
    root = lambda name: F.min_by(F.col(f"a_{name}"), F.when(F.col("parent_id").isNull(), F.col("node_id")))
    icon = F.nullif(F.trim("a_icon"), F.lit(""))
    alias = F.when(F.coalesce(F.col("a_enabled"), F.lit("true")) != "false", icon)
    one = attributes_by_node(manifest).groupBy("container_id").agg(
        root("package").alias("package_name"), root("versionCode").alias("code"), root("versionName").alias("version_name"),
        last_in("uses-sdk", F.col("a_minSdkVersion")).alias("min1"), root("minSdkVersion").alias("min2"),
        last_in("uses-sdk", F.col("a_targetSdkVersion")).alias("target1"), root("targetSdkVersion").alias("target2"),
        first_in("application", F.col("a_label")).alias("label"), first_in("application", icon).alias("icon1"), first_in("activity-alias", alias).alias("icon2"),
        declared_permissions().alias("listed"),
    ).where("trim(package_name) != ''")
    label_id = F.regexp_replace("label", "^@(?:0[xX])?", "")
    unsigned = F.when(F.col("label").startswith("@") & label_id.rlike("^[0-9a-fA-F]{1,8}$"), F.conv(label_id, 16, 10).cast("long"))
    one = one.withColumn("res_id", F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned).cast("int"))
    texts = texts.where("trim(str) != ''").select("container_id", "res_id", F.col("str").alias("resolved"))
    min_sdk = F.coalesce("min1", "min2")
    return one.join(tables.by_sorting(architectures_of(entries)), "container_id", "left").join(tables.by_sorting(texts), ["container_id", "res_id"], "left").select(
        "container_id", "package_name", F.when(F.col("label").startswith("@"), F.col("resolved")).otherwise(F.col("label")).alias("application_label"),
        F.greatest(F.coalesce("code", F.lit(1)), F.lit(1)).alias("version_code"), "version_name", min_sdk.alias("min_sdk"),
        F.coalesce("target1", "target2", min_sdk).alias("target_sdk"), F.coalesce("architectures", F.array().cast("array<string>")).alias("architectures"),
        first_of_each("listed").alias("permissions"), F.coalesce("icon1", "icon2").alias("launcher_icon_ref"),
    )


METADATA = (
    "container_id string, package_name string, application_label string, version_code int, version_name string, min_sdk int, target_sdk int, "
    "architectures array<string>, permissions array<struct<name:string,max_sdk_version:int,required:boolean>>, launcher_icon_ref string"
)


def text_value(a: chunks.Attribute) -> str | None:
    """``attribute_text`` for one attribute."""
    raw = a.raw if a.raw and a.raw.strip(" ") else None
    if a.type == chunks.T_REFERENCE:
        return raw if raw is not None else f"@{(a.data or 0) & 0xFFFFFFFF:08x}"
    if a.type in (chunks.T_DEC, chunks.T_HEX):
        return str(a.data)
    if a.type == chunks.T_BOOL:
        return "true" if a.data else "false"
    return raw


def int_value(a: chunks.Attribute) -> int | None:
    if a.type in (chunks.T_DEC, chunks.T_HEX):
        return a.data
    written = re.fullmatch(r"[+-]?[0-9]+", a.raw or "", re.ASCII)
    return n if written and -(1 << 31) <= (n := int(a.raw)) < 1 << 31 else None


def derived(data: bytes) -> list[tuple]:
    """One package's metadata, read once: the rules of ``metadata_of`` node by node. No manifest or name: no row."""
    return derived_from(Package(data))


def derived_from(found: Package) -> list[tuple]:
    if found.manifest is None:
        return []
    nodes = list(found.manifest.walk())

    def value(node, name: str, read=text_value):
        return next((v for a in node.attributes if named(a, name) and (v := read(a)) is not None), None)

    root = nodes[0]
    package = value(root, "package")
    if package is None or not package.strip(" "):
        return []
    sdk = {}
    for name in ("minSdkVersion", "targetSdkVersion"):
        stated = [v for n in nodes if n.tag == "uses-sdk" and (v := value(n, name, int_value)) is not None]
        sdk[name] = stated[-1] if stated else value(root, name, int_value)
    target = sdk["targetSdkVersion"] if sdk["targetSdkVersion"] is not None else sdk["minSdkVersion"]
    permissions: dict[str, tuple] = {}
    for n in nodes:
        name = (value(n, "name") or "").strip(" ") if n.tag in PERMISSION_TAGS else ""
        if name and name not in permissions:
            required = value(n, "required")
            permissions[name] = value(n, "maxSdkVersion", int_value), required is None or required.strip(" ").lower() not in ("false", "0", "no")
    label = next((v for n in nodes if n.tag == "application" and (v := value(n, "label")) is not None), None)
    if label and label.startswith("@"):
        written = re.fullmatch(r"@(?:0[xX])?([0-9a-fA-F]{1,8})", label)
        label = found.table.string(chunks.signed(int(written[1], 16))) if written and found.table else None
    icons = [(n.tag, icon, value(n, "enabled")) for n in nodes if n.tag in ("application", "activity-alias") and (icon := (value(n, "icon") or "").strip(" "))]
    icon = next((i for tag, i, _ in icons if tag == "application"), None) or next((i for tag, i, on in icons if tag == "activity-alias" and on != "false"), None)
    code = value(root, "versionCode", int_value)
    abis = sorted({abi for path in found.archive.entries if (abi := rules.abi(path))})
    rows = [{"name": n, "max_sdk_version": most, "required": needed} for n, (most, needed) in sorted(permissions.items())]
    return [(package, label, max(1, code or 1), value(root, "versionName"), sdk["minSdkVersion"], target, abis, rows, icon)]


def metadata(df: DataFrame) -> DataFrame:
    """Metadata of containers, one pass over each blob and no shuffle; those without a readable manifest or package name
    have no row. ``metadata_of`` says the same of tables that are there already."""
    return tables.flat_map(df, derived, METADATA).where("error IS NULL").drop("error")


def permissions(df: DataFrame) -> DataFrame:
    return permissions_of(tables.manifest_rows(df))
