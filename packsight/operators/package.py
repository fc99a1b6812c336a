"""One package, opened: manifest, resources, and the way from its icon reference to a drawable.

This is the procedural half of the engine: what has to follow references inside a blob runs here, one call per package
and no shuffle. What can be said over tables is in ``metadata`` and ``ranking``.
"""

from __future__ import annotations

import json
import logging
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from functools import cached_property

import numpy as np

from packsight.functions import images, raster, vector
from packsight.operators.rules import adaptive_score, density_distance, is_raster_candidate
from packsight.sources import chunks
from packsight.sources.archive import MANIFEST, TABLE, Archive, BadPackage, open_package
from packsight.sources.chunks import Attribute, Node, ResourceTable, named, parse_xml

DEPTH = 5
log = logging.getLogger("packsight.icons")


@dataclass(frozen=True)
class IconOptions:
    """sdk is accepted and has no effect: nothing in a package is chosen by it."""

    size: int = 432
    dpi: int = 480
    sdk: int = 35
    adaptive: bool = True
    mask: str = "circle"
    isolate: bool = False


@dataclass
class Recording:
    """An icon before it has a size. Layers are a colour, a bitmap of its own size, a drawing, or None."""

    icon_ref: str | None
    source_path: str | None
    tier: str = ""
    bitmap: np.ndarray | None = None
    background: int | np.ndarray | vector.Drawing | None = None
    foreground: int | np.ndarray | vector.Drawing | None = None

    def pack(self) -> bytes:
        """Versioned: magic, length of the JSON that tells the layers, that JSON, and the bitmaps' compressed pixels."""
        pixels: list[bytes] = []
        told = json.dumps(_told(self, pixels), separators=(",", ":")).encode()
        return RECORDING_MAGIC + struct.pack("<I", len(told)) + told + b"".join(struct.pack("<I", len(p)) + p for p in pixels)

    @staticmethod
    def unpack(data: bytes) -> Recording:
        if data[:4] != RECORDING_MAGIC:
            raise ValueError("not a recording of this version")
        size, = struct.unpack_from("<I", data, 4)
        pixels, at = [], 8 + size
        while at < len(data):
            n, = struct.unpack_from("<I", data, at)
            pixels.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        return _built(json.loads(data[8 : 8 + size]), pixels)


RECORDING_MAGIC = b"PKR1"
PAINTS = {"solid": vector.Solid, "linear": vector.Linear, "radial": vector.Radial}


def _told(layer, pixels: list[bytes]):
    """A layer as plain values; pixels of bitmaps are put aside."""
    if layer is None or isinstance(layer, int):
        return layer
    if isinstance(layer, list):
        return [_told(x, pixels) for x in layer]
    if isinstance(layer, np.ndarray):
        pixels.append(zlib.compress(layer.tobytes(), 1))
        return {"bitmap": len(pixels) - 1, "height": layer.shape[0], "width": layer.shape[1]}
    if isinstance(layer, vector.Drawing):
        paths = []
        for p in layer.paths:
            kind = next((k for k, c in PAINTS.items() if isinstance(p.fill, c)), None)
            paths.append({**{f.name: getattr(p, f.name) for f in fields(p) if f.name != "fill"}, "fill": kind and [kind, asdict(p.fill)]})
        return {"drawing": paths, "width": layer.width, "height": layer.height, "alpha": layer.alpha}
    return {"icon": [layer.icon_ref, layer.source_path, layer.tier], "layers": [_told(x, pixels) for x in (layer.bitmap, layer.background, layer.foreground)]}


def _built(told, pixels: list[bytes]):
    if told is None or isinstance(told, int):
        return told
    if isinstance(told, list):
        return [_built(x, pixels) for x in told]
    if "bitmap" in told:
        return np.frombuffer(zlib.decompress(pixels[told["bitmap"]]), np.uint8).reshape(told["height"], told["width"], 4)
    if "drawing" in told:
        tuples = lambda v: tuple(map(tuples, v)) if isinstance(v, list) else v
        paths = []
        for p in told["drawing"]:
            fill = p["fill"] and PAINTS[p["fill"][0]](**{k: tuples(v) for k, v in p["fill"][1].items()})
            paths.append(vector.Path(**{**p, "commands": [tuple(c) for c in p["commands"]], "fill": fill}))
        return vector.Drawing(paths, told["width"], told["height"], told["alpha"])
    return Recording(*told["icon"], *(_built(x, pixels) for x in told["layers"]))


def text_of(a: Attribute) -> str | None:
    """An attribute as the text that drawable rules read."""
    data = (a.data or 0) & 0xFFFFFFFF
    if a.type == chunks.T_REFERENCE:
        return f"@{data:08x}"
    if a.type == chunks.T_FLOAT:
        return f"0x{data:x}"
    if a.type in chunks.COLOURS:
        return f"#{chunks.colour_of(a.type, data) & 0xFFFFFFFF:08x}"
    if a.type in (chunks.T_DEC, chunks.T_HEX):
        return str(a.data)
    if a.type == chunks.T_BOOL:
        return "true" if a.data else "false"
    if a.type == chunks.T_STRING:
        return a.raw if a.raw is not None else str(a.data)
    return a.raw if a.raw and a.raw.strip() else None if a.type is None else str(a.data)


def attr(node: Node, name: str) -> str | None:
    return next((t for a in node.attributes if named(a, name) and (t := text_of(a)) is not None), None)


@dataclass(frozen=True)
class Target:
    """What a reference can mean: a colour, a file, or nothing more than an id or a name."""

    colour: int | None = None
    path: str | None = None


class Package:
    def __init__(self, data: bytes, options: IconOptions | None = None):
        self.archive: Archive = open_package(data)
        self.options = options or IconOptions()

    @cached_property
    def manifest(self) -> Node | None:
        data = self.archive.read(MANIFEST)
        return parse_xml(data) if data is not None else None

    @cached_property
    def table(self) -> ResourceTable | None:
        """Broken tables count as missing."""
        data = self.archive.read(TABLE)
        try:
            return ResourceTable(data) if data is not None else None
        except BadPackage:
            return None

    def node(self, path: str) -> Node | None:
        data = self.archive.read(path)
        try:
            return parse_xml(data) if data is not None else None
        except BadPackage:
            return None

    def by_density(self, paths) -> list[str]:
        """Nearest density first, then the larger file, then the order of the archive."""
        size = lambda p: self.archive.entries[p].size if p in self.archive else 0
        return sorted(paths, key=lambda p: (density_distance(p, self.options.dpi), -size(p)))

    # --- the manifest ---

    def icon_refs(self) -> Iterator[tuple[str, str]]:
        """(tier, reference): the application's icon, else that of the first alias that is enabled."""
        if self.manifest is None:
            return
        nodes = list(self.manifest.walk())
        for n in nodes:
            if n.tag == "application" and (ref := attr(n, "icon")) is not None:
                yield "manifest", ref
                return
        for n in nodes:
            ref = attr(n, "icon")
            if n.tag == "activity-alias" and (attr(n, "enabled") or "true") != "false" and ref and ref.strip():
                yield "alias", ref
                return

    # --- references ---

    def targets(self, ref: str, xml_first: bool, xml_only: bool = False) -> Iterator[Target]:
        """What a drawable reference can stand for, best first."""
        if ref.startswith("#"):
            argb = vector.colour(ref)
            if argb is not None:
                yield Target(colour=argb)
            return
        raw = ref.removeprefix("@")
        colours: list[int] = []
        if re.fullmatch(r"0[xX][0-9a-fA-F]{1,8}|[0-9a-fA-F]{8}", raw):
            values = self.table.resolve(int(raw, 16)) if self.table else []
            paths = [v.text for v in values if v.text and v.text in self.archive]
            colours = [v.argb for v in values if v.argb is not None]
        elif "/" in raw:
            kind, name = raw.split("/", 1)
            paths = self.named(kind.rsplit(":", 1)[-1], name)
        else:
            return
        documents = self.by_density(p for p in paths if p.endswith(".xml"))
        pictures = [] if xml_only else self.by_density(p for p in paths if not p.endswith(".xml"))
        for path in documents + pictures if xml_first else pictures + documents:
            yield Target(path=path)
        for argb in [] if xml_only else colours:
            yield Target(colour=argb)

    def named(self, kind: str, name: str) -> list[str]:
        """Files of a resource name; drawable and mipmap stand in for each other. Colours are not found by name."""
        if kind == "color":
            return []
        kinds = {"drawable": ["drawable", "mipmap"], "mipmap": ["mipmap", "drawable"]}.get(kind, [kind])
        tail = re.escape(name) + r"\.(?:png|webp|jpg|jpeg|xml)"
        full = re.compile(rf"res/(?:{'|'.join(map(re.escape, kinds))})[^/]*/{tail}")
        short = re.compile(rf"r/[^/]+/{tail}", re.IGNORECASE)
        return [p for p in self.archive.entries if full.fullmatch(p)] or [p for p in self.archive.entries if short.fullmatch(p)]

    # --- where an icon is, without decoding any ---

    def inspect(self) -> tuple[str | None, str | None]:
        """(icon reference, path): by reference, else a launcher image by name, else an adaptive icon."""
        ref = next((r for _, r in self.icon_refs()), None)
        path = self.path_of(ref, 0) if ref is not None else None
        return ref, path or next(iter(self.raster_candidates()), None) or self.adaptive_candidate()

    def path_of(self, ref: str, depth: int) -> str | None:
        if depth > DEPTH:
            return None
        by_id = "/" not in ref
        for target in self.targets(ref, xml_first=by_id and self.options.adaptive):
            if target.path is None:
                continue
            if not target.path.endswith(".xml"):
                return target.path
            if by_id or depth < DEPTH:
                node = self.node(target.path)
                inner = self.path_in(node, depth + 1) if node else None
                if inner or by_id:
                    return inner or target.path
        return None

    def path_in(self, node: Node, depth: int) -> str | None:
        if node.tag == "adaptive-icon":
            for layer in (c for c in node.children if c.tag in ("background", "foreground")):
                ref = attr(layer, "drawable")
                found = self.path_of(ref, depth + 1) if ref else next((p for c in layer.children if (p := self.path_in(c, depth + 1))), None)
                if found:
                    return found
            return None
        if node.tag in ("bitmap", "inset"):
            ref = attr(node, "src" if node.tag == "bitmap" else "drawable")
            return self.path_of(ref, depth + (node.tag == "inset")) if ref else None
        return next((p for c in node.children if (p := self.path_in(c, depth))), None)

    def raster_candidates(self) -> list[str]:
        return self.by_density(p for p in self.archive.entries if is_raster_candidate(p))

    def adaptive_candidate(self) -> str | None:
        paths = [p for p in self.archive.entries if p.startswith("res/") and p.endswith(".xml")]
        for path in sorted(paths, key=lambda p: -adaptive_score(p)):
            node = self.node(path)
            if node is not None and node.tag == "adaptive-icon":
                return path
        return None

    # --- recordings ---

    def record(self) -> Recording | None:
        """By reference, else the best adaptive icon, else the best launcher image by name."""
        for tier, ref in self.icon_refs():
            found = self.record_ref(ref, 0)
            log.debug("%s icon %s: %s", tier, ref, "found" if found else "not found")
            if found:
                found.icon_ref, found.tier = ref, tier
                return found
        path = self.adaptive_candidate()
        log.debug("adaptive icon by scan: %s", path)
        node = self.node(path) if path else None
        found = self.record_node(node, 0, path) if node else None
        if found:
            found.tier = "adaptive_scan"
            return found
        for path in self.raster_candidates():
            bitmap = self.picture(path)
            if bitmap is not None:
                return Recording(None, path, "raster_scan", bitmap)
        return None

    def picture(self, path: str) -> np.ndarray | None:
        data = self.archive.read(path)
        return images.decode(bytes(data)) if data is not None else None

    def record_ref(self, ref: str, depth: int, xml_first: bool | None = None) -> Recording | None:
        if depth > DEPTH:
            return None
        for target in self.targets(ref, self.options.adaptive if xml_first is None else xml_first):
            if target.colour is not None:
                return Recording(None, ref if ref.startswith("#") else None, bitmap=raster.filled(1, 1, target.colour))
            if target.path.endswith(".xml"):
                node = self.node(target.path)
                found = self.record_node(node, depth + 1, target.path) if node else None
            else:
                bitmap = self.picture(target.path)
                found = Recording(None, target.path, bitmap=bitmap) if bitmap is not None else None
            if found:
                return found
        return None

    def record_node(self, node: Node, depth: int, path: str | None) -> Recording | None:
        if depth > 2 * DEPTH:
            return None
        if node.tag == "adaptive-icon":
            back = front = None
            for layer in node.children:
                if layer.tag == "background":
                    back = self.layer(layer, depth + 1)
                elif layer.tag == "foreground":
                    drawing = self.drawing_in(layer, depth + 1)
                    front = drawing if drawing else self.layer(layer, depth + 1)
            return None if back is None and front is None else Recording(None, "adaptive-icon", background=back, foreground=front)
        if node.tag == "vector":
            drawing = self.drawing(node)
            return Recording(None, path, foreground=drawing) if drawing else None
        if node.tag in ("bitmap", "inset"):
            ref = attr(node, "src" if node.tag == "bitmap" else "drawable")
            if ref or node.tag == "bitmap":
                return self.record_ref(ref, depth + (node.tag == "inset"), xml_first=None) if ref else None
        if node.tag == "layer-list":
            layers = [x for c in node.children if c.tag == "item" and (x := self.layer(c, depth + 1)) is not None]
            return Recording(None, path, background=layers) if layers else None
        if node.tag == "shape":
            argb = next((c for n in node.children if (c := self.plain_colour(n)) is not None), None)
            return Recording(None, path, bitmap=raster.filled(1, 1, argb)) if argb is not None else None
        return next((r for c in node.children if (r := self.record_node(c, depth + 1, path))), None)

    def plain_colour(self, node: Node) -> int | None:
        """The colour of a color or solid element, or the first of a gradient."""
        if node.tag in ("color", "solid"):
            return self.colour(attr(node, "color"))
        paint = self.gradient(node) if node.tag == "gradient" else None
        return None if paint is None else paint.argb if isinstance(paint, vector.Solid) else paint.stops[0][1]

    def layer(self, node: Node, depth: int):
        """What a layer element shows: a colour, a bitmap, a drawing, or a recording of several layers."""
        ref = attr(node, "drawable")
        if ref is not None:  # inside a drawable, names mean pictures before documents
            return simple(self.record_ref(ref, depth, xml_first=self.options.adaptive and "/" not in ref))
        for child in node.children:
            argb = self.plain_colour(child)
            if argb is not None:
                return argb
            found = self.record_node(child, depth + 1, None) if child.tag not in ("color", "gradient") else None
            if found:
                return simple(found)
        return None

    # --- vectors ---

    def drawing_in(self, node: Node, depth: int) -> vector.Drawing | None:
        """The vector of a layer element, by reference or inside it."""
        if depth > DEPTH:
            return None
        ref = attr(node, "drawable")
        if ref is not None:
            if ref.startswith("#"):
                return None
            for target in self.targets(ref, xml_first=True, xml_only=True):
                root = self.node(target.path)
                if root is None or root.tag == "adaptive-icon":
                    continue
                found = next((d for n in [root, *root.children] if n.tag == "vector" and (d := self.drawing(n))), None)
                if found:
                    return found
            return None
        for child in node.children:
            if child.tag == "vector":
                return self.drawing(child)
            found = self.drawing_in(child, depth + 1)
            if found:
                return found
        return None

    def drawing(self, node: Node) -> vector.Drawing | None:
        """A vector with a positive viewport and a filled path. The alpha of a single root group is the layer's."""
        width, height = (vector.number(attr(node, n)) for n in ("viewportWidth", "viewportHeight"))
        if not width or not height or width <= 0 or height <= 0:
            return None
        only = node.children[0] if len(node.children) == 1 and node.children[0].tag == "group" else None
        alpha = min(1.0, max(0.0, self.float(only, "alpha", 1.0))) if only else 1.0
        paths: list[vector.Path] = []
        self.collect(node, vector.Affine(), paths, 0)
        return vector.Drawing(paths, width, height, alpha) if any(p.fill for p in paths) else None

    @staticmethod
    def float(node: Node, name: str, default: float) -> float:
        found = vector.number(attr(node, name))
        return default if found is None else found

    def collect(self, node: Node, matrix: vector.Affine, out: list[vector.Path], depth: int) -> None:
        for child in node.children:
            if child.tag == "group" and depth < 64:
                names = (("translateX", 0), ("translateY", 0), ("scaleX", 1), ("scaleY", 1), ("rotation", 0), ("pivotX", 0), ("pivotY", 0))
                self.collect(child, matrix @ vector.group(*(self.float(child, n, d) for n, d in names)), out, depth + 1)
            elif child.tag == "path" and (data := attr(child, "pathData")) is not None:
                try:
                    commands = vector.mapped(vector.parse_path(data), matrix)
                except vector.BadPath:
                    continue
                fill = self.paint(attr(child, "fillColor"))
                kind = (attr(child, "fillType") or "").strip().lower()
                out.append(vector.Path(
                    commands, fill.mapped(matrix) if fill else None, self.float(child, "fillAlpha", 1.0), kind in ("1", "evenodd", "even_odd", "even-odd"),
                    self.colour(attr(child, "strokeColor")), self.float(child, "strokeWidth", 0.0) * matrix.mean_scale(), self.float(child, "strokeAlpha", 1.0),
                ))

    def referred(self, ref: str) -> list[chunks.Value]:
        raw = ref.removeprefix("@").removeprefix("?")
        if self.table is None or not re.fullmatch(r"(?:0[xX])?[0-9a-fA-F]{1,8}", raw):
            return []
        return self.table.resolve(int(raw, 16))

    def colour(self, ref: str | None) -> int | None:
        if not ref:
            return None
        found = vector.colour(ref) if not ref.startswith(("@", "?")) else None
        return found if found is not None else next((v.argb for v in self.referred(ref) if v.argb is not None), None)

    def paint(self, ref: str | None):
        """A colour, else a gradient document, in the order of the resource's values."""
        if not ref or not ref.strip():
            return None
        if not ref.startswith(("@", "?")):
            argb = vector.colour(ref)
            return vector.Solid(argb) if argb is not None else None
        for v in self.referred(ref):
            if v.argb is not None:
                return vector.Solid(v.argb)
            root = self.node(v.text) if v.text and v.text.endswith(".xml") else None
            node = next((n for n in [root, *root.children] if n.tag == "gradient"), None) if root else None
            found = self.gradient(node) if node else None
            if found:
                return found
        return None

    def gradient(self, node: Node):
        """Items by offset; without items start and end colour. Radial if its type says so, all else linear."""
        place = lambda n, d: self.float(node, n, d)
        stops = [(self.float(i, "offset", 0.0), c) for i in node.children if i.tag == "item" and (c := self.colour(attr(i, "color"))) is not None]
        if not stops:
            ends = [c for n in ("startColor", "endColor") if (c := self.colour(attr(node, n))) is not None]
            if len(ends) < 2:
                return vector.Solid(ends[0]) if ends else None
            return vector.Linear((0.0, 0.0), (108.0, 108.0), ((0.0, ends[0]), (1.0, ends[1])))
        stops = tuple(sorted(stops, key=lambda s: s[0]))
        if attr(node, "type") in ("1", "radial"):
            return vector.Radial((place("centerX", 54.0), place("centerY", 54.0)), place("gradientRadius", 54.0), stops)
        return vector.Linear((place("startX", 0.0), place("startY", 0.0)), (place("endX", 108.0), place("endY", 108.0)), stops)


def simple(found: Recording | None):
    """A recording of one layer as that layer."""
    if found is None:
        return None
    if found.bitmap is not None:
        argb = raster.uniform(found.bitmap) if found.bitmap.shape[:2] == (1, 1) else None
        return found.bitmap if argb is None else argb
    return found.foreground if found.background is None and isinstance(found.foreground, vector.Drawing) else found


def paint_layer(canvas: np.ndarray, layer, isolate: bool) -> np.ndarray:
    height, width = canvas.shape[:2]
    if layer is None:
        return canvas
    if isinstance(layer, list):
        for one in layer:
            canvas = paint_layer(canvas, one, isolate)
        return canvas
    if isinstance(layer, vector.Drawing):
        if not isolate and layer.alpha >= 0.999:
            return vector.draw(canvas, layer)
        own = vector.draw(raster.filled(width, height), layer)
        return raster.composite(canvas, raster.scale_alpha(own, layer.alpha))
    if isinstance(layer, Recording):
        return raster.composite(canvas, unmasked(layer, width, isolate))
    bitmap = raster.filled(width, height, layer) if isinstance(layer, int) else raster.resize(layer, width, height)
    return raster.composite(canvas, bitmap)


def unmasked(recording: Recording, size: int, isolate: bool) -> np.ndarray:
    if recording.bitmap is not None:
        return raster.resize(recording.bitmap, size, size)
    return paint_layer(paint_layer(raster.filled(size, size), recording.background, isolate), recording.foreground, isolate)


def render(recording: Recording, size: int, mask: str = "circle", isolate: bool = False) -> np.ndarray:
    """A bitmap of the recording. Nothing is changed in it, so one recording serves any number of sizes and masks."""
    out = unmasked(recording, size, isolate)
    return raster.circle_mask(out) if mask == "circle" else out
