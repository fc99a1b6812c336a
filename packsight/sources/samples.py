"""Generated packages: a corpus of any size for queries, benchmarks and tests."""

from __future__ import annotations

from packsight.functions.images import encode_jpeg, encode_png
from packsight.functions.raster import filled
from packsight.sources.archive import DEFLATED, MANIFEST, STORED, TABLE, write_archive
from packsight.sources.chunks import T_BOOL, T_DEC, T_REFERENCE, T_STRING, Attribute, Node, Value, write_table, write_xml

ANDROID = "http://schemas.android.com/apk/res/android"


def element(tag: str, *children: Node, **attributes) -> Node:
    """Text, int, bool, or ("ref", id) by the name of the attribute."""
    out = Node(tag, None, [], list(children))
    for name, v in attributes.items():
        ns = None if name == "package" else ANDROID
        if isinstance(v, bool):
            out.attributes.append(Attribute(ns, name, None, T_BOOL, -1 if v else 0))
        elif isinstance(v, int):
            out.attributes.append(Attribute(ns, name, None, T_DEC, v))
        elif isinstance(v, tuple):
            out.attributes.append(Attribute(ns, name, None, T_REFERENCE, v[1]))
        else:
            out.attributes.append(Attribute(ns, name, v, T_STRING, 0))
    return out


LABEL, ICON, COLOUR, CHAIN, ART = 0x7F010000, 0x7F020000, 0x7F030000, 0x7F020001, 0x7F020002
SQUARE = "M0,0h24v24h-24z"


def package(number: int) -> bytes:
    """Package ``number`` of the corpus: its icon comes by one of five ways, its manifest varies with the number."""
    kind = number % 5
    argb = -(1 + number * 7919 % 0xFFFFFF)
    permissions = [element("uses-permission", name=f"android.permission.P{(number + i) % 7}") for i in range(number % 4)]
    permissions.append(element("uses-permission", name="android.permission.CAMERA", maxSdkVersion=20 + number % 15, required=number % 2 == 0))
    icon = {0: {"icon": ("ref", CHAIN)}, 1: {"icon": "@mipmap/ic_launcher"}, 4: {"icon": ("ref", ICON)}}.get(kind, {})
    children = [element("uses-sdk", minSdkVersion=21 + number % 9, targetSdkVersion=30 + number % 6), *permissions]
    application = element("application", label=("ref", LABEL) if number % 2 else f"App {number}", **icon)
    if kind == 2:
        application.children = [element("activity-alias", enabled=False, icon="@drawable/no"), element("activity-alias", enabled=True, icon="@drawable/alias")]
    children.append(application)
    manifest = element("manifest", *children, package=f"com.example.app{number}", versionCode=number, versionName=f"1.{number}")
    adaptive = element("adaptive-icon", element("background", drawable=("ref", COLOUR)), element("foreground", drawable=("ref", ART)))
    art = element("vector", element("group", element("path", pathData=SQUARE, fillColor="#ff112233"), translateX="27", translateY="27", scaleX="2", scaleY="2"), viewportWidth="108", viewportHeight="108")
    values = {
        LABEL: [Value("string", text=f"Label {number}")], ICON: [Value("path", text="res/mipmap-anydpi-v26/ic_launcher.xml"), Value("path", text="res/mipmap-xxhdpi/ic_launcher.png")],
        COLOUR: [Value("colour", argb=argb)], CHAIN: [Value("reference", ref=ICON)], ART: [Value("path", text="res/drawable/art.xml")],
    }
    picture = filled(48, 48, argb)
    members = [(MANIFEST, write_xml(manifest, utf8=number % 2 == 0), DEFLATED), (TABLE, write_table(values), STORED)]
    members += [(f"lib/{abi}/lib{number}.so", b"\x7fELF", STORED) for abi in ("x86", "arm64-v8a", "other")[: 1 + number % 3]]
    if kind in (0, 3, 4):
        members += [("res/mipmap-anydpi-v26/ic_launcher.xml", write_xml(adaptive), DEFLATED), ("res/drawable/art.xml", write_xml(art), DEFLATED)]
    if kind == 2:
        members.append(("res/drawable-hdpi/alias.jpg", encode_jpeg(picture), STORED))
    for density, size in (("mdpi", 48), ("xhdpi", 96), ("xxhdpi", 144))[: 1 + number % 3]:
        members.append((f"res/mipmap-{density}/ic_launcher.png", encode_png(filled(size, size, argb)), STORED))
    return write_archive(members)


def corpus(n: int) -> list[tuple[str, bytes]]:
    return [(f"app{i}.apk", package(i)) for i in range(n)]
