import struct

import pytest

from packsight.sources.archive import DEFLATED, STORED, Archive, BadPackage, base_package, base_score, open_package, write_archive
from packsight.sources.chunks import T_DEC, T_STRING, Attribute, Node, Pool, ResourceTable, Value, colour_of, parse_xml, write_pool, write_table, write_xml
from packsight.sources.samples import element, package


def test_stored_and_deflated_entries_read_alike():
    a = Archive(write_archive([("res/a.bin", b"abc" * 50, STORED), ("res/b.bin", b"abc" * 50, DEFLATED)]))
    assert bytes(a.read("res/a.bin")) == a.read("res/b.bin") == b"abc" * 50


def test_allow_list_folders_and_directories():
    members = [("AndroidManifest.xml", b"m", 0), ("res/", b"", 0), ("res/x.png", b"x", 0), ("META-INF/cert", b"c", 0), ("assets/a", b"a", 0)]
    assert list(Archive(write_archive(members)).entries) == ["AndroidManifest.xml", "res/x.png", "assets/a"]


def test_last_duplicate_wins():
    a = Archive(write_archive([("res/a", b"old", 0), ("res/a", b"new!", 0)]))
    assert bytes(a.read("res/a")) == b"new!" and len(a.listed) == 2


def test_unknown_method_and_missing_entry_are_null():
    data = bytearray(write_archive([("res/a", b"abcd", 0)]))
    at = data.index(b"PK\x01\x02")
    struct.pack_into("<H", data, at + 10, 12)
    a = Archive(bytes(data))
    assert a.read("res/a") is None and a.read("res/none") is None


@pytest.mark.parametrize("blob", [b"", b"PK", b"nothing here", package(1)[:-30]])
def test_no_archive_is_an_error(blob):
    with pytest.raises(BadPackage):
        Archive(blob)


def test_oversized_or_broken_deflate_is_null():
    data = bytearray(write_archive([("res/a", b"abc" * 99, DEFLATED)]))
    body = 30 + len("res/a")
    data[body : body + 4] = b"\xff\xff\xff\xff"
    assert Archive(bytes(data)).read("res/a") is None


def test_bundles_give_their_base_package():
    inner = package(3)
    bundle = write_archive([("split_config.apk", b"s", 0), ("base-master.apk", inner, 0)])
    assert base_package(bundle) == inner
    assert "AndroidManifest.xml" in open_package(bundle)
    assert [base_score(n) for n in ("universal.apk", "base-master.apk", "base-split.apk", "x.apk")] == [100, 90, 80, 10]


@pytest.mark.parametrize("utf8", [True, False])
def test_string_pools(utf8):
    strings = ["", "plain", "Grüße", "日本", "x" * 300, "y" * 40_000 if not utf8 else "y" * 30_000]
    pool = Pool(memoryview(write_pool(strings, utf8)), 0)
    assert [pool[i] for i in range(len(strings))] == strings
    assert pool[99] is None


@pytest.mark.parametrize("utf8", [True, False])
def test_binary_xml_round_trip(utf8):
    root = element("manifest", element("a", element("b", n=5)), element("c", flag=True), package="p.q")
    back = parse_xml(write_xml(root, utf8))
    assert [n.tag for n in back.walk()] == ["manifest", "a", "b", "c"]
    assert back.attributes[0].raw == "p.q" and back.children[0].children[0].attributes[0].data == 5


@pytest.mark.parametrize("blob", [b"", b"\x02\0\x08\0", b"<xml/>", write_xml(Node("a", None))[:40]])
def test_broken_xml_is_an_error(blob):
    with pytest.raises(BadPackage):
        parse_xml(blob)


def test_hostile_nesting_is_refused():
    node = Node("x", None, [Attribute(None, "n", "1", T_STRING, 0)])
    for _ in range(300):
        node = Node("x", None, [Attribute(None, "n", None, T_DEC, 1)], [node])
    with pytest.raises(BadPackage):
        parse_xml(write_xml(node))


def test_resource_table_references_cycles_and_packages():
    values = {
        0x7F010000: [Value("reference", ref=0x7F010001), Value("string", text="two")],
        0x7F010001: [[Value("path", text="res/a.png"), Value("colour", argb=-2)]],
        0x7F010005: [Value("reference", ref=0x7F010006)],
        0x7F010006: [Value("reference", ref=0x7F010005), Value("string", text="out")],
        0x01020003: [Value("string", text="other package")],
    }
    table = ResourceTable(write_table(values))
    assert [(v.kind, v.text, v.argb) for v in table.resolve(0x7F010000)] == [("path", "res/a.png", None), ("colour", None, -2), ("string", "two", None)]
    assert [v.text for v in table.resolve(0x7F010005)] == ["out"]
    assert table.string(0x01020003) == "other package" and table.resolve(0x7F01FFFF) == []
    assert sorted(table.all_ids) == sorted(values)


def test_four_colour_types():
    assert colour_of(0x1C, 0x11223344) == 0x11223344
    assert colour_of(0x1D, 0x00223344) == 0xFF223344 - (1 << 32)
    assert colour_of(0x1E, 0x1234) == 0x11223344
    assert colour_of(0x1F, 0x0234) == 0xFF223344 - (1 << 32)
