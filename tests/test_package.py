import pytest

from packsight.functions import images, raster, vector
from packsight.functions.images import encode_png
from packsight.functions.raster import filled
from packsight.operators.package import IconOptions, Package, Recording, render
from packsight.operators.rules import adaptive_score, density_distance, is_raster_candidate, target_rank
from packsight.sources.archive import MANIFEST, TABLE, write_archive
from packsight.sources.chunks import Value, write_table, write_xml
from packsight.sources.samples import element, package


def packed(files, application=None, values=None, aliases=()):
    members = [(n, d, 0) for n, d in files.items()]
    if application is not None or aliases:
        members.append((MANIFEST, write_xml(element("manifest", element("application", *aliases, **(application or {})), package="a.b")), 8))
    if values:
        members.append((TABLE, write_table(values), 0))
    return write_archive(members)


def test_lone_image_by_name():
    for density, size in (("xxxhdpi-v4", 48), ("mdpi", 16), ("xxhdpi", 64)):
        data = packed({f"res/mipmap-{density}/ic_launcher.png": encode_png(filled(size, size, -65536))})
        found = Package(data).record()
        assert found.tier == "raster_scan" and render(found, size, mask="none").shape[:2] == (size, size)
        assert encode_png(render(found, size)) == encode_png(render(found, size))


@pytest.mark.parametrize(("number", "tier"), [(0, "manifest"), (1, "manifest"), (2, "alias"), (3, "adaptive_scan"), (4, "manifest")])
def test_tiers(number, tier):
    assert Package(package(number)).record().tier == tier


def test_inspect_and_record_differ_in_tier_order():
    assert Package(package(3)).inspect() == (None, "res/mipmap-mdpi/ic_launcher.png")
    assert Package(package(3)).record().source_path == "adaptive-icon"


def test_no_icon_at_all():
    p = Package(packed({}, application={}))
    assert p.record() is None and p.inspect() == (None, None)


def test_density_order_and_ties():
    png = lambda n: encode_png(filled(n, n, -1))
    names = ("mdpi", "xxhdpi", "hdpi", "nodpi")
    files = {f"res/drawable-{d}/ic_launcher.png": png(8) for d in names} | {"res/drawable/ic_launcher.png": png(8)}
    assert Package(packed(files)).raster_candidates()[0] == "res/drawable-xxhdpi/ic_launcher.png"
    assert Package(packed(files), IconOptions(dpi=160)).raster_candidates()[0] == "res/drawable-mdpi/ic_launcher.png"
    assert Package(packed(files)).raster_candidates()[-1] == "res/drawable/ic_launcher.png"
    tie = {"res/drawable-hdpi-v4/ic_launcher.png": png(4), "res/drawable-hdpi/ic_launcher.png": png(40)}
    assert Package(packed(tie)).raster_candidates()[0] == "res/drawable-hdpi/ic_launcher.png"


def test_rules():
    assert [target_rank(d) for d in (640, 480, 320, 240, 160, 120)] == [0, 1, 2, 3, 4, 5]
    assert density_distance("res/mipmap-xxxhdpi/a.png", 480) == 1 and density_distance("res/x/a.png", 480) == 50
    assert is_raster_candidate("r/q/ic_launcher.webp") and not is_raster_candidate("res/raw/ic_launcher.png") and not is_raster_candidate("res/mipmap/ic_launcher.xml")
    assert adaptive_score("res/mipmap/ic_launcher_e4.xml") == 9


def test_reference_cycle_and_missing_file_fall_through():
    values = {0x7F020000: [Value("reference", ref=0x7F020001)], 0x7F020001: [Value("reference", ref=0x7F020000), Value("path", text="res/gone.png")]}
    files = {"res/mipmap-hdpi/ic_launcher.png": encode_png(filled(4, 4, -1))}
    assert Package(packed(files, {"icon": ("ref", 0x7F020000)}, values)).record().tier == "raster_scan"


def test_colour_icon_by_reference_and_text():
    assert render(Package(packed({}, {"icon": "#ff102030"})).record(), 4, mask="none")[0, 0].tolist() == [16, 32, 48, 255]
    found = Package(packed({}, {"icon": ("ref", 0x7F030000)}, {0x7F030000: [Value("colour", argb=-1)]})).record()
    assert render(found, 4, mask="none").min() == 255


def test_disabled_alias_with_a_typed_boolean():
    aliases = [element("activity-alias", enabled=False, icon="#ff000000"), element("activity-alias", icon=" "), element("activity-alias", icon="#ffffffff")]
    found = Package(packed({}, {}, aliases=aliases)).record()
    assert found.tier == "alias" and found.icon_ref == "#ffffffff"


def test_layers_shape_inset_and_bitmap():
    png = encode_png(filled(4, 4, -16776961))
    files = {
        "res/drawable/shape.xml": write_xml(element("shape", element("solid", color="#ff00ff00"))),
        "res/drawable/list.xml": write_xml(element("layer-list", element("item", drawable="@drawable/shape"), element("item", element("color", color="#80000000")))),
        "res/drawable/inset.xml": write_xml(element("inset", drawable="@drawable/bits")),
        "res/drawable/bits.xml": write_xml(element("bitmap", src="@drawable/pic")),
        "res/drawable/pic.png": png,
    }
    shot = lambda ref: render(Package(packed(files, {"icon": ref})).record(), 8, mask="none")[0, 0].tolist()
    assert shot("@drawable/shape") == [0, 255, 0, 255]
    assert shot("@drawable/list")[1] in (127, 128) and shot("@drawable/list")[3] == 255
    assert shot("@drawable/inset") == shot("@mipmap/bits") == [0, 0, 255, 255]


def test_group_alpha_isolates_the_foreground():
    circle = "M54,24a30,30 0 1 1 0,60a30,30 0 1 1 0,-60z"
    group = element("group", element("path", pathData=circle, fillColor="#ffff0000"), element("path", pathData=circle, fillColor="#ff0000ff"), alpha="0.5")
    front = element("foreground", element("vector", group, viewportWidth="108", viewportHeight="108"))
    files = {"res/mipmap-anydpi/ic_launcher.xml": write_xml(element("adaptive-icon", element("background", drawable="#ffffff00"), front))}
    r, g, b, a = render(Package(packed(files, {"icon": "@mipmap/ic_launcher"})).record(), 108, mask="none")[54, 54].astype(int)
    assert abs(r - 128) <= 2 and abs(g - 128) <= 2 and abs(b - 128) <= 2 and a == 255


def test_one_recording_many_sizes():
    found = Package(package(1)).record()
    first = encode_png(render(found, 64))
    render(found, 96, mask="circle"), render(found, 64, mask="none")
    assert encode_png(render(Recording.unpack(found.pack()), 64)) == first


def test_gradient_fills():
    gradient = element("gradient", element("item", offset="0", color="#ff000000"), element("item", offset="1", color="#ffffffff"), startX="0", endX="108", startY="0", endY="0")
    files = {
        "res/drawable/g.xml": write_xml(gradient),
        "res/drawable/v.xml": write_xml(element("vector", element("path", pathData="M0,0h108v108h-108z", fillColor=("ref", 0x7F050000)), viewportWidth="108", viewportHeight="108")),
    }
    out = render(Package(packed(files, {"icon": "@drawable/v"}, {0x7F050000: [Value("path", text="res/drawable/g.xml")]})).record(), 32, mask="none")
    assert out[0, 0, 0] < 16 and out[0, 31, 0] > 240


def test_recordings_are_written_and_read_without_pickle():
    for number in range(5):
        found = Package(package(number)).record()
        packed = found.pack()
        back = Recording.unpack(packed)
        assert packed[:4] == b"PKR1" and (back.icon_ref, back.source_path, back.tier) == (found.icon_ref, found.source_path, found.tier)
        assert (render(back, 48) == render(found, 48)).all() and back.pack() == packed
    with pytest.raises(ValueError, match="version"):
        Recording.unpack(b"\x80\x05pickle")


def test_every_kind_of_layer_is_kept():
    stops = ((0.0, -1), (1.0, -16777216))
    square = [("M", 0.0, 0.0), ("L", 5.0, 0.0), ("L", 5.0, 5.0), ("Z",)]
    paints = [vector.Solid(-65536), vector.Linear((0.0, 0.0), (9.0, 9.0), stops), vector.Radial((5.0, 5.0), 4.0, stops), None]
    drawing = vector.Drawing([vector.Path(square, p, 0.5, True, -1, 2.0, 0.25) for p in paints], 10.0, 10.0, 0.75)
    found = Recording("@x", "res/x.xml", "manifest", background=[-256, drawing, Recording(None, None, bitmap=raster.filled(2, 3, -1)), None], foreground=drawing)
    back = Recording.unpack(found.pack())
    assert back.foreground == drawing and back.background[:2] == [-256, drawing] and (back.background[2].bitmap == raster.filled(2, 3, -1)).all()


def test_names_inside_drawables_mean_pictures_first():
    red, blue = -65536, -16776961
    art = element("vector", element("path", pathData="M0,0h24v24h-24z", fillColor="#ff0000ff"), viewportWidth="24", viewportHeight="24")
    icon = element("layer-list", element("item", drawable="@drawable/a"))
    manifest = element("manifest", element("application", icon="@drawable/icon"), package="p")
    members = [(MANIFEST, write_xml(manifest), 8), ("res/drawable/icon.xml", write_xml(icon), 8), ("res/drawable/a.xml", write_xml(art), 8), ("res/drawable/a.png", images.encode_png(raster.filled(4, 4, red)), 0)]
    shown = raster.uniform(render(Package(write_archive(members)).record(), 16, mask="none"))
    assert shown == red
    alone = raster.uniform(render(Package(write_archive(members[:3])).record(), 16, mask="none"))
    assert alone == blue


def test_metadata_and_icon_come_from_one_parse(monkeypatch):
    from packsight.operators import metadata, package as module

    seen, parse = [], module.parse_xml
    monkeypatch.setattr(module, "parse_xml", lambda data: seen.append(data) or parse(data))
    data = package(2)
    found = Package(data)
    assert metadata.derived_from(found) == metadata.derived(data)
    seen.clear()
    found.record()
    assert found.archive.read("AndroidManifest.xml") not in seen
