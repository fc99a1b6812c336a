"""Binary XML and the resource table: Android's chunked formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from packsight.sources.archive import BadPackage

# Chunk types.
POOL, TABLE, XML = 0x0001, 0x0002, 0x0003
START_NAMESPACE, END_NAMESPACE, START_TAG, END_TAG, TEXT, ID_MAP = 0x0100, 0x0101, 0x0102, 0x0103, 0x0104, 0x0180
PACKAGE, TYPE = 0x0200, 0x0201
# Types of a typed value.
T_REFERENCE, T_STRING, T_FLOAT, T_DEC, T_HEX, T_BOOL = 0x01, 0x03, 0x04, 0x10, 0x11, 0x12
T_ARGB8, T_RGB8, T_ARGB4, T_RGB4 = 0x1C, 0x1D, 0x1E, 0x1F
COLOURS = (T_ARGB8, T_RGB8, T_ARGB4, T_RGB4)

NONE = 0xFFFFFFFF
UTF8 = 1 << 8
#: Nesting and node limits for hostile documents.
MAX_DEPTH, MAX_NODES = 256, 200_000


class Pool:
    """Strings by index; what is cut off or not there is empty."""

    def __init__(self, data: memoryview, at: int):
        kind, _, self.size = struct.unpack_from("<HHI", data, at)
        if kind != POOL:
            raise BadPackage("no string pool")
        self.count, _, flags, strings, _ = struct.unpack_from("<IIIII", data, at + 8)
        self.count = min(self.count, max(0, (len(data) - at - 28) // 4))
        self.utf8 = bool(flags & UTF8)
        self.data, self.at, self.strings = data, at, at + strings
        self.known: dict[int, str] = {}

    def _length(self, place: int) -> tuple[int, int]:
        if self.utf8:
            n = self.data[place]
            return ((n & 0x7F) << 8 | self.data[place + 1], place + 2) if n & 0x80 else (n, place + 1)
        n, = struct.unpack_from("<H", self.data, place)
        if n & 0x8000:
            low, = struct.unpack_from("<H", self.data, place + 2)
            return (n & 0x7FFF) << 16 | low, place + 4
        return n, place + 2

    def __getitem__(self, index: int) -> str | None:
        if index == NONE or not 0 <= index < self.count:
            return None
        if index not in self.known:
            try:
                offset, = struct.unpack_from("<I", self.data, self.at + 28 + 4 * index)
                n, place = self._length(self.strings + offset)
                if self.utf8:
                    n, place = self._length(place)
                raw = bytes(self.data[place : place + (n if self.utf8 else 2 * n)])
                self.known[index] = raw.decode("utf-8" if self.utf8 else "utf-16-le", "replace")
            except (struct.error, IndexError):
                self.known[index] = ""
        return self.known[index]


@dataclass
class Attribute:
    ns: str | None
    name: str
    raw: str | None
    type: int | None
    data: int | None


@dataclass
class Node:
    tag: str
    ns: str | None
    attributes: list[Attribute] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """Pre-order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


def named(attribute: Attribute, name: str) -> bool:
    return attribute.name == name or attribute.name.endswith(f":{name}")


def parse_xml(data: bytes | memoryview) -> Node:
    """Binary XML to its root node."""
    data = memoryview(data)
    try:
        kind, header, size = struct.unpack_from("<HHI", data, 0)
        if kind != XML:
            raise BadPackage("not binary XML")
        at, end = header, min(size, len(data))
        pool: Pool | None = None
        root, stack, nodes = None, [], 0
        while at + 8 <= end:
            kind, header, size = struct.unpack_from("<HHI", data, at)
            if size < 8:
                raise BadPackage("a chunk without size")
            if kind == POOL and pool is None:
                pool = Pool(data, at)
            elif kind == START_TAG:
                if pool is None:
                    raise BadPackage("a tag before the string pool")
                ns, name, begin, width, count = struct.unpack_from("<IIHHH", data, at + header)
                node = Node(pool[name] or "", pool[ns])
                for i in range(count):
                    a_ns, a_name, raw, _, _, a_type, value = struct.unpack_from("<IIIHBBi", data, at + header + begin + i * max(width, 20))
                    text = pool[raw]
                    if text is None and a_type == T_STRING:
                        text = pool[value & NONE]
                    node.attributes.append(Attribute(pool[a_ns], pool[a_name] or "", text, a_type, value))
                nodes += 1
                if nodes > MAX_NODES or len(stack) >= MAX_DEPTH:
                    raise BadPackage("too many or too deeply nested nodes")
                if stack:
                    stack[-1].children.append(node)
                elif root is None:
                    root = node
                stack.append(node)
            elif kind == END_TAG and stack:
                stack.pop()
            at += size
    except (struct.error, IndexError) as e:
        raise BadPackage(f"broken binary XML: {e}") from e
    if root is None:
        raise BadPackage("binary XML without a tag")
    return root


@dataclass(frozen=True)
class Value:
    """kind: path, string, colour or reference."""

    kind: str
    text: str | None = None
    argb: int | None = None
    ref: int | None = None


def signed(x: int) -> int:
    x &= NONE
    return x - (1 << 32) if x >> 31 else x


def colour_of(kind: int, data: int) -> int:
    """A colour value of any of the four types as signed ARGB."""
    data &= NONE
    if kind == T_RGB8:
        data |= 0xFF000000
    elif kind in (T_ARGB4, T_RGB4):
        nibbles = [(data >> s & 0xF) * 17 for s in (12, 8, 4, 0)]
        if kind == T_RGB4:
            nibbles[0] = 255
        data = nibbles[0] << 24 | nibbles[1] << 16 | nibbles[2] << 8 | nibbles[3]
    return signed(data)


class ResourceTable:
    """Values by resource id, over all configurations in the order of the file."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        self.chunks: list[tuple[int, int, int]] = []
        try:
            kind, header, size = struct.unpack_from("<HHI", self.data, 0)
            if kind != TABLE:
                raise BadPackage("not a resource table")
            at, end = header, min(size, len(self.data))
            self.pool = Pool(self.data, at)
            at += self.pool.size
            while at + 8 <= end:
                kind, header, size = struct.unpack_from("<HHI", self.data, at)
                if size < 8:
                    break
                if kind == PACKAGE:
                    package, = struct.unpack_from("<I", self.data, at + 8)
                    inner = at + (header if header >= 268 else 288)
                    while inner + 8 <= min(at + size, end):
                        kind, _, length = struct.unpack_from("<HHI", self.data, inner)
                        if length < 8:
                            break
                        if kind == TYPE:
                            self.chunks.append((package & 0xFF, self.data[inner + 8], inner))
                        inner += length
                at += size
        except (struct.error, IndexError) as e:
            raise BadPackage(f"broken resource table: {e}") from e

    def _entry(self, chunk: int, index: int) -> Iterator[Value]:
        header, = struct.unpack_from("<H", self.data, chunk + 2)
        count, entries = struct.unpack_from("<II", self.data, chunk + 12)
        if index >= count:
            return
        offset, = struct.unpack_from("<I", self.data, chunk + header + 4 * index)
        if offset == NONE:
            return
        at = chunk + entries + offset
        size, flags, _ = struct.unpack_from("<HHI", self.data, at)
        if flags & 1:
            n, = struct.unpack_from("<I", self.data, at + 12)
            if at + size + 12 * n > len(self.data):
                raise BadPackage("a complex entry runs over the end of the table")
            places = range(at + size + 4, at + size + 4 + 12 * n, 12)
        else:
            places = [at + size]
        for place in places:
            if place + 8 > len(self.data):
                return
            _, _, kind, data = struct.unpack_from("<HBBI", self.data, place)
            if kind == T_REFERENCE:
                yield Value("reference", ref=signed(data))
            elif kind == T_STRING:
                text = self.pool[data] or ""
                yield Value("path" if "/" in text else "string", text=text)
            elif kind in COLOURS:
                yield Value("colour", argb=colour_of(kind, data))

    def values(self, res_id: int) -> list[Value]:
        """The values that stand directly under an id."""
        package, kind, index = res_id >> 24 & 0xFF, res_id >> 16 & 0xFF, res_id & 0xFFFF
        out: list[Value] = []
        for of, number, chunk in self.chunks:
            if of == package and number == kind:
                try:
                    out += self._entry(chunk, index)
                except (struct.error, IndexError):
                    continue
        return out

    def resolve(self, res_id: int, seen: set[int] | None = None) -> list[Value]:
        """Values with references followed; an id counts once, whatever ways lead to it."""
        seen = set() if seen is None else seen
        out: list[Value] = []
        stack = [("id", signed(res_id))]
        while stack:
            kind, item = stack.pop()
            if kind == "value":
                out.append(item)
                continue
            if item in seen:
                continue
            seen.add(item)
            steps = [("id", v.ref) if v.kind == "reference" else ("value", v) for v in self.values(item)]
            stack.extend(reversed(steps))
        return out

    def string(self, res_id: int) -> str | None:
        """The first text that is not blank."""
        return next((v.text for v in self.resolve(res_id) if v.text and v.text.strip()), None)

    @cached_property
    def all_ids(self) -> list[int]:
        found = {}
        for package, kind, chunk in self.chunks:
            header, = struct.unpack_from("<H", self.data, chunk + 2)
            count, = struct.unpack_from("<I", self.data, chunk + 12)
            for i in range(min(count, max(0, (len(self.data) - chunk - header) // 4))):
                if struct.unpack_from("<I", self.data, chunk + header + 4 * i)[0] != NONE:
                    found[signed(package << 24 | kind << 16 | i)] = None
        return list(found)

    def rows(self) -> Iterator[tuple[int, int, str, str | None, int | None, int | None]]:
        """(res_id, order, kind, text, argb, ref_id) of every value in the table."""
        for res_id in self.all_ids:
            for i, v in enumerate(self.values(res_id)):
                yield res_id, i, v.kind, v.text, v.argb, v.ref


# --- writers, for generated packages ---


def write_pool(strings: list[str], utf8: bool = True) -> bytes:
    offsets, body = [], bytearray()
    for s in strings:
        offsets.append(len(body))
        if utf8:
            raw = s.encode()
            for n in (len(s), len(raw)):
                body += bytes([n >> 8 | 0x80, n & 0xFF]) if n > 0x7F else bytes([n])
            body += raw + b"\0"
        else:
            raw = s.encode("utf-16-le")
            n = len(raw) // 2
            body += (struct.pack("<HH", n >> 16 | 0x8000, n & 0xFFFF) if n > 0x7FFF else struct.pack("<H", n)) + raw + b"\0\0"
    body += b"\0" * (-len(body) % 4)
    start = 28 + 4 * len(strings)
    head = struct.pack("<HHIIIIII", POOL, 28, start + len(body), len(strings), 0, UTF8 if utf8 else 0, start, 0)
    return head + struct.pack(f"<{len(strings)}I", *offsets) + bytes(body)


def write_xml(root: Node, utf8: bool = True) -> bytes:
    """A node tree as binary XML."""
    strings: dict[str, int] = {}
    index = lambda s: NONE if s is None else strings.setdefault(s, len(strings))
    body = bytearray()

    def put(node: Node) -> None:
        attributes = bytearray()
        for a in node.attributes:
            data = index(a.raw) if a.type == T_STRING and a.raw is not None else (a.data or 0) & NONE
            attributes += struct.pack("<IIIHBBI", index(a.ns), index(a.name), index(a.raw), 8, 0, a.type if a.type is not None else T_STRING, data)
        extension = struct.pack("<IIHHHHHH", index(node.ns), index(node.tag), 20, 20, len(node.attributes), 0, 0, 0) + bytes(attributes)
        body.extend(struct.pack("<HHIII", START_TAG, 16, 16 + len(extension), 1, NONE) + extension)
        for child in node.children:
            put(child)
        body.extend(struct.pack("<HHIIIII", END_TAG, 16, 24, 1, NONE, index(node.ns), index(node.tag)))

    put(root)
    pool = write_pool(list(strings), utf8)
    return struct.pack("<HHI", XML, 8, 8 + len(pool) + len(body)) + pool + bytes(body)


def write_table(values: dict[int, list[list[Value] | Value]], utf8: bool = True) -> bytes:
    """A resource table of id -> one item per configuration: a value, or a list of them for a complex entry."""
    strings: dict[str, int] = {}
    packages: dict[int, dict[int, dict[int, list]]] = {}
    for res_id, items in values.items():
        packages.setdefault(res_id >> 24 & 0xFF, {}).setdefault(res_id >> 16 & 0xFF, {})[res_id & 0xFFFF] = items

    def cell(v: Value) -> bytes:
        kind, data = {"reference": (T_REFERENCE, v.ref), "colour": (T_ARGB8, v.argb)}.get(v.kind, (T_STRING, None))
        if data is None:
            data = strings.setdefault(v.text or "", len(strings))
        return struct.pack("<HBBI", 8, 0, kind, data & NONE)

    out = bytearray()
    for package, types in packages.items():
        body = bytearray()
        for kind, entries in types.items():
            for config in range(max(map(len, entries.values()))):
                offsets, cells = [], bytearray()
                for i in range(max(entries) + 1):
                    items = entries.get(i, [])
                    if config >= len(items):
                        offsets.append(NONE)
                        continue
                    offsets.append(len(cells))
                    item = items[config]
                    if isinstance(item, list):
                        cells += struct.pack("<HHIII", 16, 1, 0, 0, len(item)) + b"".join(struct.pack("<I", 0) + cell(v) for v in item)
                    else:
                        cells += struct.pack("<HHI", 8, 0, 0) + cell(item)
                header = 20 + 64
                start = header + 4 * len(offsets)
                body += struct.pack("<HHIBBHII", TYPE, header, start + len(cells), kind, 0, 0, len(offsets), start) + struct.pack("<I", 64) + b"\0" * 60
                body += struct.pack(f"<{len(offsets)}I", *offsets) + bytes(cells)
        out += struct.pack("<HHII", PACKAGE, 288, 288 + len(body), package) + b"\0" * 276 + bytes(body)
    pool = write_pool(list(strings), utf8)
    return struct.pack("<HHII", TABLE, 12, 12 + len(pool) + len(out), len(packages)) + pool + bytes(out)
