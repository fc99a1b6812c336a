"""Package archives: the ZIP central directory, entries, and bundles of packages."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

#: An entry may not inflate beyond this.
MAX_ENTRY = 256 << 20
END_SIGNATURE, ENTRY_SIGNATURE, LOCAL_SIGNATURE = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8

# The entries that package analysis reads.
MANIFEST, TABLE = "AndroidManifest.xml", "resources.arsc"
FOLDERS = ("res/", "r/", "assets/", "lib/")


class BadPackage(ValueError):
    """A blob that is no readable package, table or document."""


@dataclass(frozen=True)
class Entry:
    index: int
    path: str
    method: int
    packed: int
    size: int
    offset: int


def interesting(path: str) -> bool:
    return path in (MANIFEST, TABLE) or path.startswith(FOLDERS)


class Archive:
    """Entries by path; of entries with one path the last counts. Checksums are not verified."""

    def __init__(self, data: bytes | memoryview, everything: bool = False):
        self.data = memoryview(data)
        self.listed = list(self._directory(everything))
        self.entries = {e.path: e for e in self.listed}

    def _directory(self, everything: bool):
        tail_at = max(0, len(self.data) - 65_557)
        tail = bytes(self.data[tail_at:])
        at = tail.rfind(END_SIGNATURE)
        if at < 0 or at + 22 > len(tail):
            raise BadPackage("no end of central directory")
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        place = offset
        for index in range(count):
            if place + 46 > len(self.data) or bytes(self.data[place : place + 4]) != ENTRY_SIGNATURE:
                raise BadPackage(f"bad central directory entry {index}")
            method, = struct.unpack_from("<H", self.data, place + 10)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", self.data, place + 20)
            local, = struct.unpack_from("<I", self.data, place + 42)
            path = bytes(self.data[place + 46 : place + 46 + n_name]).decode("utf-8", "replace")
            place += 46 + n_name + n_extra + n_comment
            if not path.endswith("/") and (everything or interesting(path)):
                yield Entry(index, path, method, packed, full, local)

    def __contains__(self, path: str) -> bool:
        return path in self.entries

    def payload(self, entry: Entry) -> memoryview | None:
        """The packed bytes, or None if they lie outside the archive."""
        at = entry.offset
        if at + 30 > len(self.data) or bytes(self.data[at : at + 4]) != LOCAL_SIGNATURE:
            return None
        n_name, n_extra = struct.unpack_from("<HH", self.data, at + 26)
        begin = at + 30 + n_name + n_extra
        return self.data[begin : begin + entry.packed] if begin + entry.packed <= len(self.data) else None

    def read(self, path: str) -> bytes | memoryview | None:
        """An entry's bytes (a view without copying if stored); None if it is missing, broken or packed otherwise. One that
        would inflate beyond MAX_ENTRY is an error."""
        entry = self.entries.get(path)
        packed = self.payload(entry) if entry else None
        if packed is None:
            return None
        if entry.method == STORED:
            return packed
        if entry.method != DEFLATED:
            return None
        try:
            inflater = zlib.decompressobj(-15)
            out = inflater.decompress(packed, min(MAX_ENTRY, entry.size or MAX_ENTRY))
        except zlib.error:
            return None
        if entry.size > MAX_ENTRY or len(out) == MAX_ENTRY and inflater.unconsumed_tail:
            raise BadPackage(f"{path} inflates beyond {MAX_ENTRY} bytes")
        return out if not entry.size or len(out) == entry.size else None


def base_score(path: str) -> int:
    """How likely a member of a bundle is its base package."""
    name = path.lower()
    if "universal" in name:
        return 100
    if "base" in name:
        return 80 if "split" in name else 90
    return 10


def base_package(data: bytes) -> bytes | None:
    """The base package of a bundle; None if the archive has no ``.apk`` member. Ties go to the first."""
    archive = Archive(data, everything=True)
    members = [e for e in archive.listed if e.path.lower().endswith(".apk")]
    for entry in sorted(members, key=lambda e: -base_score(e.path)):
        found = archive.read(entry.path)
        if found is not None:
            return bytes(found)
    return None


def open_package(data: bytes) -> Archive:
    """An archive with a manifest or resources as it is; a bundle by its base package."""
    archive = Archive(data)
    if MANIFEST not in archive.entries:
        inner = base_package(data)
        if inner is not None:
            return Archive(inner)
    return archive


def write_archive(members: list[tuple[str, bytes, int]]) -> bytes:
    """A ZIP of (path, bytes, method), written as they come."""
    body, directory = bytearray(), bytearray()
    for path, data, method in members:
        name = path.encode()
        packed = data
        if method == DEFLATED:
            deflater = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = deflater.compress(data) + deflater.flush()
        common = struct.pack("<HHHHIIIHH", 0, method, 0, 0, zlib.crc32(data), len(packed), len(data), len(name), 0)
        directory += ENTRY_SIGNATURE + struct.pack("<HH", 20, 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + name
        body += LOCAL_SIGNATURE + struct.pack("<H", 20) + common + name + packed
    end = END_SIGNATURE + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(directory), len(body), 0)
    return bytes(body + directory + end)
