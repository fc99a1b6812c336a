"""Image decoding and PNG encoding in numpy. Bitmaps are (height, width, 4) uint8 arrays of straight-alpha RGBA."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

MAX_PIXELS = 64 << 20
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Rows that are swept at a time.
BAND = 512
#: Channels of a PNG colour type, and the depths it allows.
PNG_TYPES = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}


class BadImage(ValueError):
    pass


def sniff(data: bytes) -> str | None:
    """png, jpeg or webp by the first bytes; names are not looked at."""
    head = bytes(data[:12])
    if head[:2] == b"\x89P":
        return "png"
    if head[:2] == b"\xff\xd8":
        return "jpeg"
    return "webp" if head[:2] == b"RI" else None


def decode(data: bytes) -> np.ndarray | None:
    """A bitmap, or None for what cannot be decoded: unknown, broken, progressive JPEG, and WebP without a codec."""
    kind = sniff(data)
    try:
        return decode_png(bytes(data)) if kind == "png" else decode_jpeg(bytes(data)) if kind == "jpeg" else None
    except (BadImage, struct.error, zlib.error, IndexError, ValueError, KeyError):
        return None


def _chunks(data: bytes):
    at = len(PNG_MAGIC)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return
        at += 12 + size


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < height * (stride + 1):
        raise BadImage("image data is cut off")
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    if not rows[:, 0].any():
        return rows[:, 1:]
    out = np.zeros((height + 1, stride + step), dtype=np.uint8)
    y = 0
    while y < height:
        kind, line = int(rows[y, 0]), rows[y, 1:]
        now, above = out[y + 1], out[y]
        if kind == 0:
            now[step:] = line
        elif kind == 1:
            for c in range(step):
                now[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            now[step:] = line + above[step:]
        elif kind in (3, 4):
            stop = y + 1 + int(np.flatnonzero(rows[y : y + BAND, 0] >= 3)[-1])
            out[y + 1 : stop + 1, step:] = _sweep(rows[y:stop, 0], rows[y:stop, 1:], above[step:], step)
            y = stop
            continue
        else:
            raise BadImage("unknown filter")
        y += 1
    return out[1:, step:]


def _sweep(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Rows whose filters look left and up, by diagonals: the pixels with one sum of row and column depend on the two
    diagonals before alone. kinds: the filter of each row."""
    if kinds.max() > 4:
        raise BadImage("unknown filter")
    height, stride = lines.shape
    width = -(-stride // step)
    padded = np.zeros((height, width * step), dtype=np.int16)
    padded[:, :stride] = lines
    pixels = padded.reshape(height, width, step)
    top = np.zeros(width * step, dtype=np.int16)
    top[:stride] = above
    top = top.reshape(width, step)
    slanted = np.zeros((height + width - 1, height, step), dtype=np.int16)
    for y in range(height):
        slanted[y : y + width, y] = pixels[y]
    uses = [(kinds == k).astype(np.int16)[:, None] for k in range(5)]
    plain = [bool(u.any()) for u in uses]
    # the diagonals before, with the row above them in front
    one, two = np.zeros((height + 1, step), dtype=np.int16), np.zeros((height + 1, step), dtype=np.int16)
    for d in range(height + width - 1):
        low, high = max(0, d - width + 1), min(height - 1, d) + 1
        if d < width:
            one[0] = top[d]
        left, up, corner = one[low + 1 : high + 1], one[low:high], two[low:high]
        guess = uses[1][low:high] * left if plain[1] else 0
        if plain[2]:
            guess = guess + uses[2][low:high] * up
        if plain[3]:
            guess = guess + uses[3][low:high] * ((left + up) >> 1)
        if plain[4]:
            off_left, off_up = np.abs(up - corner), np.abs(left - corner)
            off_corner = np.abs(left + up - 2 * corner)
            near = np.where((off_left <= off_up) & (off_left <= off_corner), left, np.where(off_up <= off_corner, up, corner))
            guess = guess + uses[4][low:high] * near
        now = (slanted[d, low:high] + guess) & 255
        slanted[d, low:high] = now
        two, one = one, two
        one[low + 1 : high + 1] = now
        if low:
            one[:low + 1] = 0
    for y in range(height):
        pixels[y] = slanted[y : y + width, y]
    return padded[:, :stride].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """All colour types and depths, not interlaced. 16-bit samples keep their high byte."""
    if data[:8] != PNG_MAGIC:
        raise BadImage("no PNG signature")
    header, palette, clear, packed = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or not packed:
        raise BadImage("no header or no image data")
    width, height, depth, colour, _, _, interlaced = header
    channels, depths = PNG_TYPES.get(colour, (0, ()))
    if not channels or depth not in depths or not width or not height or width * height > MAX_PIXELS or interlaced:
        raise BadImage("unsupported PNG")
    stride = (width * channels * depth + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(packed), height * (stride + 1))
    lines = _unfilter(raw, height, stride, max(1, channels * depth // 8))
    if colour == 6 and depth == 8:
        return lines.reshape(height, width, 4).copy()
    if depth == 16:
        samples = lines.reshape(height, -1, 2).astype(np.uint16)
        samples = samples[..., 0] << 8 | samples[..., 1]
    elif depth == 8:
        samples = lines.astype(np.uint16)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        samples = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint16)
    samples = samples[:, : width * channels].reshape(height, width, channels)
    eight = (samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if colour == 3:
        if palette is None or not len(palette):
            raise BadImage("no palette")
        index = np.minimum(samples[..., 0], len(palette) - 1)
        out[..., :3] = palette[index]
        alpha = np.full(len(palette), 255, dtype=np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear[: len(palette)], np.uint8)
        out[..., 3] = alpha[index]
        return out
    out[..., :3] = eight[..., :1] if channels < 3 else eight[..., :3]
    if channels in (2, 4):
        out[..., 3] = eight[..., -1]
    elif clear and len(clear) >= 2 * channels:
        key = np.array(struct.unpack(f">{channels}H", clear[: 2 * channels]))
        out[..., 3] = np.where((samples == key).all(axis=2), 0, 255)
    return out


def encode_png(bitmap: np.ndarray, level: int = 3, paeth: bool = False) -> bytes:
    """8-bit RGBA, one data chunk, rows unfiltered or each by the Paeth filter."""
    height, width, _ = bitmap.shape
    rows = np.zeros((height, 1 + 4 * width), dtype=np.uint8)
    rows[:, 1:] = bitmap.reshape(height, -1)
    if paeth:
        wide = np.pad(bitmap.astype(np.int16), ((1, 0), (1, 0), (0, 0)))
        left, up, corner = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
        guess = left + up - corner
        off_left, off_up, off_corner = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        near = np.where((off_left <= off_up) & (off_left <= off_corner), left, np.where(off_up <= off_corner, up, corner))
        rows[:, 0] = 4
        rows[:, 1:] = ((wide[1:, 1:] - near) & 255).astype(np.uint8).reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


# --- baseline JPEG (T.81) ---


def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block in zigzag order, by diagonals that turn at each end."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return np.array([8 * y + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))])


# What chroma adds to red, takes from green (blue's, red's) and adds to blue, in 1024ths, and their rounding.
TO_RED, TO_GREEN, TO_BLUE, HALF = 1436, (352, 731), 1814, 512

ZIGZAG = _zigzag()
_K = np.arange(8)
_DCT = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)


@lru_cache(maxsize=32)
def _huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16-bit lookahead: length of its code << 8 | symbol; 0 where no code begins so. Codes follow each other, so
    their lookaheads do. Most files have one of few tables; a table takes half a megabyte, and is only read."""
    out: list[int] = []
    k = 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            found = length << 8 | symbols[k]
            if len(out) < 1 << 16:
                out += [found] * (1 << 16 - length)
            k += 1
    return (out + [0] * ((1 << 16) - len(out)))[: 1 << 16]


def _coefficients(data: bytes, units: int, blocks: list[tuple[int, list[int], list[int]]], components: int) -> list[list[int]]:
    """One restart interval, stuffing removed -> for each component (place, value, place, value ...) of its coefficients,
    blocks numbered as they come. blocks: (component, table of the first coefficient, table of the others) of a unit."""
    out: list[list[int]] = [[] for _ in range(components)]
    number, before = [0] * components, [0] * components
    at = hold = n = 0
    limit, order = len(data) + 64, ZIGZAG.tolist()
    data += bytes(80)
    for _ in range(units):
        for i, first, others in blocks:
            base, put = 64 * number[i], out[i]
            number[i] += 1
            k, table = 0, first
            while k < 64:
                if n < 32:  # enough for a code and what follows it
                    if at > limit:
                        raise BadImage("scan is cut off")
                    hold = (hold & (1 << n) - 1) << 48 | int.from_bytes(data[at : at + 6], "big")
                    at, n = at + 6, n + 48
                found = table[hold >> n - 16 & 0xFFFF]
                if not found:
                    raise BadImage("bad Huffman code")
                n -= found >> 8
                run, size = (found & 0xFF) >> 4, found & 15
                value = 0
                if size:
                    n -= size
                    value = hold >> n & (1 << size) - 1
                    if not value >> size - 1:
                        value -= (1 << size) - 1
                if not k:
                    before[i] += value
                    put += (base, before[i])
                    k, table = 1, others
                    continue
                if not size:
                    if run < 15:
                        break
                    k += 16
                    continue
                k += run
                if k > 63:
                    raise BadImage("too many coefficients")
                put += (base + order[k], value)
                k += 1
    return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """Baseline and extended sequential, 8 bits, 1, 3 or 4 components, restart markers; anything else is refused."""
    quant, tables, frame, restart, adobe = {}, {}, None, 0, None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size, = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                values = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                quant[number] = np.zeros(64)
                quant[number][ZIGZAG] = values
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart, = struct.unpack(">H", body[:2])
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3, 4) or not width or not height or width * height > MAX_PIXELS:
                raise BadImage("unsupported JPEG")
            frame = width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF:
            raise BadImage("not a sequential JPEG")
        elif marker == 0xDA:
            if frame is None:
                raise BadImage("scan without frame")
            return _scan(data, at, body, frame, quant, tables, restart, adobe)
    raise BadImage("no scan")


def _scan(data, at, body, frame, quant, tables, restart, adobe) -> np.ndarray:
    width, height, components = frame
    if body[0] != len(components):
        raise BadImage("scans of single components are not supported")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if len(components) == 1:
        components = [(components[0][0], 1, 1, components[0][3])]
    h_max, v_max = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
    planes = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in components]
    kinds = [(tables[chosen[c[0]] >> 4], tables[0x10 | chosen[c[0]] & 15]) for c in components]
    blocks = [(i, *kinds[i]) for i, (_, h, v, _) in enumerate(components) for _ in range(h * v)]
    segments, begin, place = [], at, at
    while place < len(data) - 1:
        place = data.find(b"\xff", place)
        if place < 0 or place + 1 >= len(data):
            place = len(data)
            break
        nxt = data[place + 1]
        if 0xD0 <= nxt <= 0xD7:
            segments.append(data[begin:place])
            begin = place + 2
        elif nxt not in (0, 0xFF):
            break
        place += 2 if nxt != 0xFF else 1
    segments.append(data[begin:place])
    total, unit = across * down, 0
    for segment in segments:
        here = min(restart or total, total - unit)
        for plane, (_, h, v, _), found in zip(planes, components, _coefficients(segment.replace(b"\xff\x00", b"\xff"), here, blocks, len(components)), strict=True):
            place, value = np.array(found[::2], dtype=np.int64), found[1::2]
            number = place // 64
            mcu = unit + number // (h * v)
            inner = number % (h * v)
            plane[mcu // across * v + inner // h, mcu % across * h + inner % h, place % 64] = value
        unit += here
    full = []
    for plane, (_, h, v, q) in zip(planes, components, strict=True):
        blocks = (plane * quant[q]).reshape(*plane.shape[:2], 8, 8)
        pixels = np.clip(np.round(_DCT @ blocks @ _DCT.T + 128), 0, 255)
        flat = pixels.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, -1)
        full.append(np.repeat(np.repeat(flat, v_max // v, axis=0), h_max // h, axis=1)[:height, :width])
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if len(full) == 1:
        out[..., :3] = full[0][..., None]
        return out
    rgb = np.stack(full[:3], axis=2)
    if adobe != 0 if len(full) == 3 else adobe == 2:
        y, cb, cr = (rgb[..., 0].astype(np.int64), rgb[..., 1].astype(np.int64) - 128, rgb[..., 2].astype(np.int64) - 128)
        red, green, blue = TO_RED * cr, TO_GREEN[0] * cb + TO_GREEN[1] * cr, TO_BLUE * cb
        rgb = np.clip(np.stack((y + (red + HALF >> 10), y - (green + HALF >> 10), y + (blue + HALF >> 10)), axis=2), 0, 255)
    if len(full) == 4:  # inks are stored inverted
        rgb = np.clip(rgb, 0, 255) * full[3][..., None] / 255
    out[..., :3] = np.clip(np.round(rgb), 0, 255)
    return out


#: What an encoded coefficient's code stands for: zeros before it and how many bits it has.
SYMBOLS = bytes(r << 4 | n for r in range(16) for n in range(11) if n or r in (0, 15))


def encode_jpeg(bitmap: np.ndarray, quality_step: int = 2) -> bytes:
    """A baseline JPEG of flat Huffman tables, three components without subsampling: for generated packages."""
    height, width = bitmap.shape[:2]
    rgb = bitmap[..., :3].astype(np.float64)
    y = 0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]
    planes = [y, (rgb[..., 2] - y) / 1.772 + 128, (rgb[..., 0] - y) / 1.402 + 128]
    pad = (-height % 8, -width % 8)
    segment = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([quality_step] * 64))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3)))
    out += segment(0xC4, b"\0" + bytes([0] * 3 + [12] + [0] * 12) + bytes(range(12)))
    symbols = SYMBOLS
    out += segment(0xC4, b"\x10" + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols)
    out += segment(0xDA, b"\x03" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\0\x3f\0")
    bits: list[str] = []

    def value(v: int, n: int) -> str:
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    blocks = []
    for p in planes:
        p = np.pad(p, ((0, pad[0]), (0, pad[1])), mode="edge") - 128
        tiles = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        blocks.append(np.round((_DCT.T @ tiles @ _DCT) / quality_step).astype(int).reshape(*tiles.shape[:2], 64)[..., ZIGZAG])
    last = [0, 0, 0]
    for by in range(blocks[0].shape[0]):
        for bx in range(blocks[0].shape[1]):
            for i, b in enumerate(blocks):
                block = b[by, bx].tolist()
                used = np.flatnonzero(b[by, bx, 1:]).tolist()
                diff, last[i] = block[0] - last[i], block[0]
                n = abs(diff).bit_length()
                bits.append(format(n, "04b") + value(diff, n))
                before = 0
                for k in used:
                    run, before = k - before, k + 1
                    while run > 15:
                        bits.append(format(symbols.index(0xF0), "08b"))
                        run -= 16
                    n = abs(block[k + 1]).bit_length()
                    bits.append(format(symbols.index(run << 4 | n), "08b") + value(block[k + 1], n))
                if before < 63:
                    bits.append(format(symbols.index(0), "08b"))
    joined = "".join(bits)
    joined += "1" * (-len(joined) % 8)
    return out + int(joined, 2).to_bytes(len(joined) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
