"""Packages written from rows of a table: a corpus as large as the table, whose content a query can foretell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from packsight.functions.images import encode_png
from packsight.functions.raster import filled
from packsight.operators.tables import CONTAINERS
from packsight.session import ship
from packsight.sources.archive import DEFLATED, MANIFEST, STORED, TABLE, write_archive
from packsight.sources.chunks import Value, write_table, write_xml
from packsight.sources.samples import SQUARE, element

LABEL, LONG, ICON, CHAIN, ART, COLOUR = 0x7F010000, 0x7F010001, 0x7F020000, 0x7F020001, 0x7F020002, 0x7F030000
#: Packages written before they are handed on.
AT_ONCE = 64
ABIS = ("x86", "arm64-v8a", "other", "armeabi-v7a")


def shop(key: int, name: str, nation: int, segment: str) -> bytes:
    """A customer as a package. What is in it goes by remainders of the key and the nation, so that every rule of the
    engine has packages on either side of it."""
    kind, argb = key % 5, (0xFF000000 | key * 7919 % 0xFFFFFF) - (1 << 32)
    sdk = {"minSdkVersion": 14 + nation % 10} | ({"targetSdkVersion": 24 + key % 10} if key % 3 else {})
    children = [element("uses-sdk", **sdk)] + ([element("uses-sdk", minSdkVersion=20)] if key % 4 == 0 else [])
    children.append(element("uses-permission", name=f"P{nation % 7}"))
    children.append(element("uses-permission", name=f"P{(nation + key) % 7}", maxSdkVersion=20 + nation, required=key % 2 == 0))
    children.append(element("uses-permission-sdk-23", name=f" P{nation % 7} ", maxSdkVersion=99))
    icon = {0: {"icon": ("ref", ICON)}, 1: {"icon": "@mipmap/ic_launcher"}, 4: {"icon": ("ref", CHAIN)}}.get(kind, {})
    aliases = [element("activity-alias", enabled=False, icon="@drawable/no"), element("activity-alias", icon="@drawable/alias")] if kind == 2 else []
    children.append(element("application", *aliases, label=("ref", LABEL) if key % 2 else name, **icon))
    version = {"versionCode": key % 1000} | ({"versionName": f"{nation}.{key}"} if nation % 2 else {})
    manifest = element("manifest", *children, package=f"com.{segment.lower()}.c{key}", **version)
    adaptive = element("adaptive-icon", element("background", drawable=("ref", COLOUR)), element("foreground", drawable=("ref", ART)))
    art = element("vector", element("group", element("path", pathData=SQUARE, fillColor="#ff112233"), translateX="27", translateY="27", scaleX="2", scaleY="2"), viewportWidth="108", viewportHeight="108")
    scan = "res/mipmap-anydpi-v26/ic_launcher.xml"
    values = {
        LABEL: [Value("reference", ref=LONG) if key % 4 == 1 else Value("string", text=f"Label {name}")], LONG: [Value("string", text=f"Long {name}")],
        ICON: [Value("path", text=p) for p in (scan, "res/mipmap-xxhdpi/ic_launcher.png", "res/mipmap-mdpi/ic_launcher.png")],
        CHAIN: [Value("reference", ref=ICON)], ART: [Value("path", text="res/drawable/art.xml")], COLOUR: [Value("colour", argb=argb)],
    }
    members = [("META-INF/skipped", b"x", STORED), ("res/", b"", STORED), (MANIFEST, write_xml(manifest, utf8=key % 2 == 0), DEFLATED), (TABLE, write_table(values, utf8=key % 3 == 0), STORED)]
    members += [(f"lib/{abi}/libc.so", b"\x7fELF" * (i + 1), STORED) for i, abi in enumerate(ABIS) if key >> i & 1]
    if key % 2 == 0:
        members += [(scan, write_xml(adaptive), DEFLATED), ("res/drawable/art.xml", write_xml(art), DEFLATED)]
    if kind == 2:
        members.append(("res/drawable-hdpi/alias.png", encode_png(filled(12, 12, argb)), STORED))
    if key % 6 == 0:
        members.append(("res/mipmap-mdpi/ic_launcher.png", b"replaced by the next", STORED))
    for density, size in (("mdpi", 12), ("xhdpi", 24), ("xxhdpi", 36))[: 1 + key % 3]:
        members.append((f"res/mipmap-{density}/ic_launcher.png", encode_png(filled(size, size, argb)), STORED))
    return write_archive(members)


def packages(df: DataFrame, write: Callable[..., bytes], name: str) -> DataFrame:
    """A container for each row: ``write`` gets the row's values, ``name`` is the column that names it."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            ids = [str(r[names.index(name)]) for r in rows]
            content = [write(*r) for r in rows]
            columns = pa.array(ids, pa.string()), pa.array(ids, pa.string()), pa.array(map(len, content), pa.int64()), pa.array(content, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in CONTAINERS.split(", ")])

    return df.mapInArrow(run, CONTAINERS)
