"""Vector drawables: path text, affine groups, paints, and a coverage rasteriser in numpy."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from packsight.functions.raster import filled, rgba

#: Limits for hostile paths.
MAX_COMMANDS, MAX_EDGES = 50_000, 400_000
#: Edges are cut at each other's ends for exact coverage, into this many parts at most; drawings that need more are sampled
#: on LINES lines a pixel, exact across.
MAX_PARTS = 4_000_000
LINES = 8
# How far a flattened curve may be off, in pixels, on canvases from this width on.
TOLERANCES = ((1536, 0.45), (768, 0.35), (0, 0.25))
#: Cuts closer than this are one.
CUT = 1e-5
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
#: How many numbers a command takes.
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


class BadPath(ValueError):
    pass


@dataclass(frozen=True)
class Affine:
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def __matmul__(self, o: Affine) -> Affine:
        """First ``o``, then this."""
        return Affine(
            self.a * o.a + self.c * o.b, self.b * o.a + self.d * o.b, self.a * o.c + self.c * o.d,
            self.b * o.c + self.d * o.d, self.a * o.e + self.c * o.f + self.e, self.b * o.e + self.d * o.f + self.f,
        )

    def point(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def mean_scale(self) -> float:
        return math.sqrt(abs(self.a * self.d - self.b * self.c))


def group(tx=0.0, ty=0.0, sx=1.0, sy=1.0, degrees=0.0, px=0.0, py=0.0) -> Affine:
    """Pivot to the origin, scale, rotate, back to the pivot and on by the translation."""
    turn = math.radians(degrees)
    cos, sin = math.cos(turn), math.sin(turn)
    return Affine(e=tx + px, f=ty + py) @ Affine(cos, sin, -sin, cos) @ Affine(a=sx, d=sy) @ Affine(e=-px, f=-py)


@dataclass(frozen=True)
class Solid:
    argb: int

    def mapped(self, m: Affine) -> Solid:
        return self


@dataclass(frozen=True)
class Linear:
    start: tuple[float, float]
    end: tuple[float, float]
    stops: tuple[tuple[float, int], ...]

    def mapped(self, m: Affine) -> Linear:
        return Linear(m.point(*self.start), m.point(*self.end), self.stops)


@dataclass(frozen=True)
class Radial:
    centre: tuple[float, float]
    radius: float
    stops: tuple[tuple[float, int], ...]

    def mapped(self, m: Affine) -> Radial:
        return Radial(m.point(*self.centre), self.radius * m.mean_scale(), self.stops)


@dataclass
class Path:
    """Closed polylines come from ``commands``: (op, points) with op M, L, C or Z."""

    commands: list[tuple]
    fill: Solid | Linear | Radial | None = None
    alpha: float = 1.0
    even_odd: bool = False
    stroke: int | None = None
    stroke_width: float = 0.0
    stroke_alpha: float = 1.0


@dataclass
class Drawing:
    paths: list[Path]
    width: float
    height: float
    alpha: float = 1.0
    extra: dict = field(default_factory=dict)


def _tokens(text: str):
    """(command letter, its numbers); arc flags may run together with what follows."""
    at, command = 0, None
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at >= len(text):
            return
        if text[at].upper() in ARGUMENTS:
            command, at = text[at], at + 1
            if command in "zZ":
                yield command, ()
                command = None
                continue
        elif command is None:
            raise BadPath("numbers without a command")
        numbers = []
        for i in range(ARGUMENTS[command.upper()]):
            while at < len(text) and (text[at].isspace() or text[at] == ","):
                at += 1
            if command in "aA" and i in (3, 4) and at < len(text) and text[at] in "01":
                numbers.append(float(text[at]))
                at += 1
                continue
            found = NUMBER.match(text, at)
            if not found:
                if i == 0 and command is not None:
                    raise BadPath("a command without its numbers")
                raise BadPath("too few numbers")
            numbers.append(float(found.group()))
            at = found.end()
        yield command, tuple(numbers)
        command = {"M": "L", "m": "l"}.get(command, command)


def parse_path(text: str) -> list[tuple]:
    """Path text to absolute M, L, C and Z commands."""
    out: list[tuple] = []
    x = y = start_x = start_y = 0.0
    control: tuple[str, float, float] | None = None
    for letter, n in _tokens(text):
        op, base = letter.upper(), (x, y) if letter.islower() else (0.0, 0.0)
        at = lambda i: (n[i] + base[0], n[i + 1] + base[1])  # noqa: E731, B023
        kept = None
        if op == "M":
            x, y = start_x, start_y = at(0)
            out.append(("M", x, y))
        elif op == "Z":
            out.append(("Z",))
            x, y = start_x, start_y
        elif op in "LHV":
            x, y = {"L": lambda: at(0), "H": lambda: (n[0] + base[0], y), "V": lambda: (x, n[0] + base[1])}[op]()
            out.append(("L", x, y))
        elif op in "CS":
            c1 = at(0) if op == "C" else (2 * x - control[1], 2 * y - control[2]) if control and control[0] == "C" else (x, y)
            c2, end = (at(2), at(4)) if op == "C" else (at(0), at(2))
            out.append(("C", *c1, *c2, *end))
            kept, (x, y) = ("C", *c2), end
        elif op in "QT":
            q = at(0) if op == "Q" else (2 * x - control[1], 2 * y - control[2]) if control and control[0] == "Q" else (x, y)
            end = at(2) if op == "Q" else at(0)
            out.append(("C", x + 2 / 3 * (q[0] - x), y + 2 / 3 * (q[1] - y), end[0] + 2 / 3 * (q[0] - end[0]), end[1] + 2 / 3 * (q[1] - end[1]), *end))
            kept, (x, y) = ("Q", *q), end
        elif op == "A":
            end = at(5)
            out += arc(x, y, *n[:5], *end)
            x, y = end
        control = kept
        if len(out) > MAX_COMMANDS:
            raise BadPath("too many commands")
    return out


def arc(x0, y0, rx, ry, degrees, large, sweep, x1, y1) -> list[tuple]:
    """An elliptical arc as cubics of at most a quarter turn (SVG 1.1, appendix F.6)."""
    rx, ry = abs(rx), abs(ry)
    if not rx or not ry or (x0, y0) == (x1, y1):
        return [("L", x1, y1)]
    phi = math.radians(degrees)
    cos, sin = math.cos(phi), math.sin(phi)
    dx, dy = (x0 - x1) / 2, (y0 - y1) / 2
    px, py = cos * dx + sin * dy, cos * dy - sin * dx
    grow = math.sqrt(max(1.0, (px / rx) ** 2 + (py / ry) ** 2))
    rx, ry = rx * grow, ry * grow
    rest = max(0.0, (rx * ry) ** 2 - (rx * py) ** 2 - (ry * px) ** 2) / ((rx * py) ** 2 + (ry * px) ** 2)
    k = math.sqrt(rest) * (-1 if bool(large) == bool(sweep) else 1)
    ox, oy = k * rx * py / ry, -k * ry * px / rx
    m = Affine(cos * rx, sin * rx, -sin * ry, cos * ry, cos * ox - sin * oy + (x0 + x1) / 2, sin * ox + cos * oy + (y0 + y1) / 2)
    begin = math.atan2((py - oy) / ry, (px - ox) / rx)
    turn = math.atan2((-py - oy) / ry, (-px - ox) / rx) - begin
    turn += 2 * math.pi if sweep and turn < 0 else -2 * math.pi if not sweep and turn > 0 else 0
    parts = max(1, math.ceil(abs(turn) / (math.pi / 2) - 1e-9))
    step = turn / parts
    reach = 4 / 3 * math.tan(step / 4)
    out = []
    for i in range(parts):
        t, u = begin + i * step, begin + (i + 1) * step
        c1 = m.point(math.cos(t) - reach * math.sin(t), math.sin(t) + reach * math.cos(t))
        c2 = m.point(math.cos(u) + reach * math.sin(u), math.sin(u) - reach * math.cos(u))
        out.append(("C", *c1, *c2, *m.point(math.cos(u), math.sin(u))))
    return out[:-1] + [(*out[-1][:5], x1, y1)]


def mapped(commands: list[tuple], m: Affine) -> list[tuple]:
    return [(c[0], *(v for i in range(1, len(c), 2) for v in m.point(c[i], c[i + 1]))) for c in commands]


@lru_cache(maxsize=256)
def _thirds(count: int) -> tuple[np.ndarray, ...]:
    """What each point of a cubic counts for at the ends of so many equal parts."""
    t = np.linspace(0, 1, count + 1)[1:, None]
    s = 1 - t
    return s**3, 3 * s * s * t, 3 * s * t * t, t**3


def edges(commands: list[tuple], tolerance: float = 0.25) -> np.ndarray:
    """Rows (x0, y0, x1, y1) of closed contours; a cubic becomes as many lines as its bend asks for."""
    parts: list[np.ndarray] = []
    contour: list[tuple[float, float]] = []

    def close() -> None:
        if len(contour) > 1:
            points = np.array(contour)
            parts.append(np.concatenate((points, np.concatenate((points[1:], points[:1]))), axis=1))
        contour.clear()

    last = start = (0.0, 0.0)
    for op, *n in commands:
        if op == "M":
            close()
            last = start = tuple(n)
            contour.append(last)
        elif op == "Z":
            close()
            last = start
            contour.append(last)
        elif op == "L":
            last = tuple(n)
            contour.append(last)
        else:
            p = np.array([*last, *n]).reshape(4, 2)
            bend = max(*np.abs(p[:2] - 2 * p[1:3] + p[2:]).max(axis=1).tolist())
            a, b, c, d = _thirds(int(min(256, max(1, math.ceil(math.sqrt(0.75 * bend / tolerance))))))
            contour += map(tuple, (a * p[0] + b * p[1] + c * p[2] + d * p[3]).tolist())
            last = tuple(n[4:])
    close()
    out = np.concatenate(parts) if parts else np.zeros((0, 4))
    if len(out) > MAX_EDGES:
        raise BadPath("too many edges")
    return out[out[:, 1] != out[:, 3]]


def coverage(lines: np.ndarray, width: int, height: int, even_odd: bool) -> np.ndarray:
    """The share of each pixel inside the contours, 0 to 1.

    Rows and the ends of all edges cut the canvas into strips, in which edges are straight from top to bottom. In a strip
    those that the fill rule makes a boundary are found in the middle, and each adds or takes the exact area to its right.
    """
    out = np.zeros((height, width + 2))
    lines = lines[(np.maximum(lines[:, 1], lines[:, 3]) > 0) & (np.minimum(lines[:, 1], lines[:, 3]) < height)] if len(lines) else lines
    if not len(lines) or not np.isfinite(lines).all():
        return out[:, :width]
    x0, y0, x1, y1 = lines.T
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    ends = np.concatenate((low, high))
    cuts = np.unique(np.concatenate((ends[(ends > 0) & (ends < height)], np.arange(max(0, int(low.min())), min(height, int(np.ceil(high.max()))) + 1, dtype=np.float64))))
    whole = cuts == np.floor(cuts)
    close = np.diff(cuts, prepend=-np.inf) <= CUT
    # of cuts that are one, the row's line stays
    cuts = cuts[whole | ~(close | np.append(whole[1:] & (np.diff(cuts) <= CUT), False))]
    top = np.minimum(np.searchsorted(cuts, low - CUT), len(cuts) - 1)
    bottom = np.minimum(np.searchsorted(cuts, high - CUT), len(cuts) - 1)
    count = np.maximum(0, bottom - top)
    if count.sum() > MAX_PARTS:
        return _sampled(lines, width, height, even_odd)
    of = np.repeat(np.arange(len(lines)), count)
    if not len(of):
        return out[:, :width]
    strip = np.arange(len(of)) + np.repeat(top - (np.cumsum(count) - count), count)
    slope = ((x1 - x0) / (y1 - y0))[of]
    above, below = (x0[of] + (np.minimum(np.maximum(cuts[strip + i], low[of]), high[of]) - y0[of]) * slope for i in (0, 1))
    order = np.lexsort((above + below, strip))
    strip, above, below, turn = strip[order], above[order], below[order], np.where(y1 > y0, 1, -1)[of][order]
    begins = np.concatenate(([True], strip[1:] != strip[:-1]))
    base = np.maximum.accumulate(np.where(begins, np.arange(len(strip)), 0))
    total = np.cumsum(turn)
    after = total - (total[base] - turn[base])
    inside = (np.arange(len(strip)) - base) % 2 == 0 if even_odd else after != 0
    was = np.where(begins, False, np.concatenate(([False], inside[:-1])))
    edge = np.flatnonzero(inside != was)
    sign = np.where(inside[edge], 1.0, -1.0) * (cuts[strip + 1] - cuts[strip])[edge]
    row = np.floor(cuts[strip[edge]]).astype(np.int64)
    left, right = np.minimum(above, below)[edge], np.maximum(above, below)[edge]
    first, last = (np.minimum(np.maximum(np.floor(v), -1), width).astype(np.int64) for v in (left, right))
    count = last - first + 2
    of = np.repeat(np.arange(len(edge)), count)
    pixel = np.arange(len(of)) + np.repeat(first - (np.cumsum(count) - count), count)
    left, right = left[of], right[of]

    def reached(z: np.ndarray) -> np.ndarray:
        """The area right of the edge and left of z, for a strip of height 1."""
        wide = right - left
        steep = np.maximum(0, z - (left + right) / 2)
        slanted = (np.maximum(z - left, 0) ** 2 - np.maximum(z - right, 0) ** 2) / np.maximum(2 * wide, 1e-12)
        return np.where(wide > 1e-9, slanted, steep)

    own = np.where(pixel < width, reached(pixel + 1.0) - reached(pixel.astype(np.float64)), 1.0)
    step = own - np.where(pixel > first[of], np.concatenate(([0.0], own[:-1])), 0.0)
    at = row[of] * (width + 2) + np.minimum(np.maximum(pixel, 0), width + 1)
    out = np.bincount(at, sign[of] * step, height * (width + 2)).reshape(height, width + 2)
    return np.minimum(np.maximum(np.cumsum(out, axis=1)[:, :width], 0), 1)


def _boxed(commands: Sequence[tuple], fit: Affine, width: int, height: int, even_odd: bool) -> tuple[tuple[slice, slice], np.ndarray] | None:
    """The box of the pixels that a path covers and their shares; None if there are none."""
    tolerance = next(t for least, t in TOLERANCES if width >= least)
    share = coverage(edges(mapped(commands, fit), tolerance), width, height, even_odd)
    ys, xs = np.flatnonzero(share.any(axis=1)), np.flatnonzero(share.any(axis=0))
    if not len(ys):
        return None
    box = slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1)
    return box, share[box].copy()


#: Icons of one collection repeat their shapes (squares, discs, templates): the last few small ones are kept, at most 16 MB.
KEPT_SHAPES, KEPT_PIXELS, KEPT_COMMANDS = 32, 1 << 16, 64
_kept = lru_cache(maxsize=KEPT_SHAPES)(_boxed)


def _sampled(lines: np.ndarray, width: int, height: int, even_odd: bool) -> np.ndarray:
    """The same from LINES lines a pixel."""
    out = np.zeros((height, width + 1))
    if not len(lines) or not np.isfinite(lines).all():
        return out[:, :width]
    x0, y0, x1, y1 = lines.T
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    wind = np.where(y1 > y0, 1, -1)
    first = np.clip(np.ceil(low * LINES - 0.5), 0, height * LINES).astype(np.int64)
    last = np.clip(np.ceil(high * LINES - 0.5), 0, height * LINES).astype(np.int64)
    count = np.maximum(0, last - first)
    of = np.repeat(np.arange(len(lines)), count)
    if not len(of):
        return out[:, :width]
    line = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(of))
    y = (line + 0.5) / LINES
    x = x0[of] + (y - y0[of]) * (x1[of] - x0[of]) / (y1[of] - y0[of])
    order = np.lexsort((x, line))
    line, x, turn = line[order], np.clip(x[order], 0, width), wind[of][order]
    total = np.cumsum(turn)
    begins = np.concatenate(([True], line[1:] != line[:-1]))
    base = np.maximum.accumulate(np.where(begins, np.arange(len(line)), 0))
    now = total - (total[base] - turn[base])
    inside = (np.arange(len(line)) - base) % 2 == 0 if even_odd else now != 0
    inside[-1] = False
    spans = np.flatnonzero(inside & np.append(line[1:] == line[:-1], False))
    for sign, edge in ((1, x[spans]), (-1, x[spans + 1])):
        # a step at ``edge``: the pixel that holds it gets its part, all pixels after it the whole
        pixel = np.minimum(edge.astype(np.int64), width)
        part = edge - pixel
        row = line[spans] // LINES
        np.add.at(out, (row, pixel), sign * (1 - part))
        np.add.at(out, (row, np.minimum(pixel + 1, width)), sign * np.where(pixel < width, part, 0))
    return np.clip(np.cumsum(out, axis=1)[:, :width] / LINES, 0, 1)


def lut(stops, size: int = 256) -> np.ndarray:
    """Colours along a gradient, mixed premultiplied."""
    at = np.array([s for s, _ in stops], dtype=np.float64)
    colours = np.array([rgba(c) for _, c in stops], dtype=np.float64)
    pre = np.concatenate((colours[:, :3] * colours[:, 3:] / 255, colours[:, 3:]), axis=1)
    t = np.linspace(0, 1, size)
    mixed = np.stack([np.interp(t, at, pre[:, k]) for k in range(4)], axis=1)
    mixed[:, :3] = np.where(mixed[:, 3:] > 0, mixed[:, :3] * 255 / np.maximum(mixed[:, 3:], 1e-9), 0)
    return mixed


def _paint(fill, width: int, height: int) -> np.ndarray:
    if isinstance(fill, Solid):
        return np.broadcast_to(rgba(fill.argb).astype(np.float64), (height, width, 4))
    x, y = np.arange(width)[None, :] + 0.5, np.arange(height)[:, None] + 0.5
    if isinstance(fill, Linear):
        dx, dy = fill.end[0] - fill.start[0], fill.end[1] - fill.start[1]
        t = ((x - fill.start[0]) * dx + (y - fill.start[1]) * dy) / max(dx * dx + dy * dy, 1e-12)
    else:
        t = np.hypot(x - fill.centre[0], y - fill.centre[1]) / max(fill.radius, 1e-6)
    return lut(fill.stops)[np.clip(t * 255 + 0.5, 0, 255).astype(np.int64)]


def blend(under: np.ndarray, colour: np.ndarray, alpha: np.ndarray, light: np.ndarray) -> np.ndarray:
    """Source-over of straight-alpha floats (channels 0 to 255, alpha 0 to 1); where ``light`` is set colours are mixed as
    squares, near to what light does, elsewhere as they are written."""
    rest = under[..., 3] / 255 * (1 - alpha)
    whole = alpha + rest
    share = (alpha / np.maximum(whole, 1e-9))[..., None]
    plain = colour * share + under[..., :3] * (1 - share)
    squared = np.sqrt(colour**2 * share + under[..., :3] ** 2 * (1 - share))
    out = np.empty_like(under)
    out[..., :3] = np.where(whole[..., None] > 0, np.where(light[..., None], squared, plain), 0)
    out[..., 3] = whole * 255
    return out


def draw(canvas: np.ndarray, drawing: Drawing) -> np.ndarray:
    """The drawing, scaled to the canvas, source-over on top of it; paths without fill are left out.

    At a rim, where a pixel is covered in part, an opaque colour is mixed by light, and so is any paint over a clear pixel;
    opaque gradients over opaque pixels and whole pixels are mixed as written.
    """
    height, width = canvas.shape[:2]
    fit = Affine(a=width / drawing.width, d=height / drawing.height)
    out = canvas.copy()
    for path in drawing.paths:
        if path.fill is None or path.alpha <= 0:
            continue
        small = width * height <= KEPT_PIXELS and len(path.commands) <= KEPT_COMMANDS
        found = _kept(tuple(path.commands), fit, width, height, path.even_odd) if small else _boxed(path.commands, fit, width, height, path.even_odd)
        if found is None:
            continue
        box, part = found
        under = out[box]
        solid = isinstance(path.fill, Solid)
        paint = rgba(path.fill.argb).astype(np.float64) if solid else _paint(path.fill.mapped(fit), width, height)[box]
        own = paint[..., 3] / 255 * min(1.0, path.alpha)
        rim = part < 0.999
        clear, covered = under[..., 3] < 8, (under[..., 3] >= 250) & (own >= 0.99)
        alpha = part * np.where(rim & covered, 1.0, own)
        light = rim & (clear | (solid and own >= 0.999))
        # pixels that take the whole colour need no mixing
        whole, some = alpha >= 1, np.nonzero((alpha > 1e-4) & (alpha < 1))
        colour = paint[:3] if solid else paint[..., :3][some]
        mixed = np.minimum(np.maximum(np.round(blend(under[some].astype(np.float64), colour, alpha[some], light[some])), 0), 255)
        flat = np.append(paint[:3], 255.0) if solid else np.concatenate((paint[..., :3][whole], np.full((int(whole.sum()), 1), 255.0)), axis=1)
        under[whole] = np.minimum(np.maximum(np.round(flat), 0), 255).astype(np.uint8)
        under[some] = mixed.astype(np.uint8)
    return out


def rasterise(drawing: Drawing, size: int) -> np.ndarray:
    return draw(filled(size, size), drawing)


# --- values written as text ---


def number(text: str | None) -> float | None:
    """A float from text, with or without a unit, or from ``0x`` and the bits of a float."""
    if text is None:
        return None
    t = text.strip()
    if t.lower().startswith("0x"):
        try:
            return struct.unpack(">f", struct.pack(">I", int(t, 16) & 0xFFFFFFFF))[0]
        except ValueError:
            return None
    try:
        return float(re.sub(r"(?:dp|dip|sp|px|in|mm|pt|%)$", "", t))
    except ValueError:
        return None


def colour(text: str | None) -> int | None:
    """Signed ARGB from ``#`` and 3, 4, 6 or 8 digits, or from bare or ``0x`` hex digits (up to 6: opaque)."""
    if not text:
        return None
    t = text.strip()
    digits = t[1:] if t.startswith("#") else t[2:] if t.lower().startswith("0x") else t
    if not re.fullmatch(r"[0-9a-fA-F]{1,8}", digits) or t.startswith("#") and len(digits) not in (3, 4, 6, 8):
        return None
    if t.startswith("#") and len(digits) < 5:
        digits = "".join(d * 2 for d in digits)
    value = int(digits, 16)
    if len(digits) <= 6:
        value |= 0xFF000000
    return value - (1 << 32) if value >> 31 else value
