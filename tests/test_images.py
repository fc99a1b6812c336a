import struct
import zlib

import numpy as np
import pytest

from packsight.functions import images, raster


def png(width, height, colour, depth, raw, palette=b"", clear=b"", interlace=0):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    out = images.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace))
    out += chunk(b"PLTE", palette) if palette else b""
    out += chunk(b"tRNS", clear) if clear else b""
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_palette_with_transparency():
    out = images.decode_png(png(2, 1, 3, 8, b"\0\0\1", b"\1\2\3\4\5\6", b"\0"))
    assert out[0].tolist() == [[1, 2, 3, 0], [4, 5, 6, 255]]


@pytest.mark.parametrize(("depth", "raw", "want"), [(4, b"\0\xfe\xdc", [15, 14, 13, 12]), (2, b"\0\x1b", [0, 1, 2, 3])])
def test_packed_palettes(depth, raw, want):
    palette = bytes(v for i in range(1 << depth) for v in (i, i + 100, 7))
    out = images.decode_png(png(4, 1, 3, depth, raw, palette))
    assert out[0, :, 0].tolist() == want


def test_grey_ramp_and_deep_colours():
    assert images.decode_png(png(4, 1, 0, 2, b"\0\x1b"))[0, :, 0].tolist() == [0, 85, 170, 255]
    assert images.decode_png(png(1, 1, 6, 16, b"\0" + bytes(range(1, 9))))[0, 0].tolist() == [1, 3, 5, 7]
    assert images.decode_png(png(1, 1, 2, 8, b"\0\1\2\3"))[0, 0].tolist() == [1, 2, 3, 255]
    assert images.decode_png(png(2, 1, 4, 8, b"\0\x09\x40\x08\xff"))[0].tolist() == [[9, 9, 9, 64], [8, 8, 8, 255]]


def test_filters_agree():
    rng = np.random.default_rng(3)
    want = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    flat = want.reshape(5, -1).astype(int)
    padded = np.zeros((6, 32), dtype=int)
    padded[1:, 4:] = flat
    raw = b""
    for y, kind in enumerate((0, 1, 2, 3, 4), 1):
        a, b, c = padded[y, :-4], padded[y - 1, 4:], padded[y - 1, :-4]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = (0 * a, a, b, (a + b) >> 1, near)[kind]
        raw += bytes([kind]) + bytes(((padded[y, 4:] - guess) & 255).tolist())
    assert (images.decode_png(png(7, 5, 6, 8, raw)) == want).all()


def test_round_trip_is_exact_and_repeats():
    b = np.random.default_rng(0).integers(0, 256, (9, 17, 4), dtype=np.uint8)
    assert (images.decode(images.encode_png(b)) == b).all() and images.encode_png(b) == images.encode_png(b)


@pytest.mark.parametrize("data", [b"", b"\x89P", png(1, 1, 6, 8, b"\0\0", interlace=1), png(0, 1, 6, 8, b""), png(1, 1, 5, 8, b"\0\0"), png(9, 9, 6, 8, b"\0"), b"RIFF....WEBP", b"\xff\xd8\xff\xc2\0\x0b\x08\0"])
def test_what_cannot_be_decoded_is_none(data):
    assert images.decode(data) is None


def test_jpeg_colours_grey_and_odd_sizes():
    two = np.zeros((24, 40, 4), np.uint8)
    two[:12], two[12:] = (255, 0, 0, 255), (0, 0, 255, 255)
    out = images.decode(images.encode_jpeg(two)).astype(int)
    assert abs(out[5, 20] - (255, 0, 0, 255)).max() <= 12 and abs(out[19, 20] - (0, 0, 255, 255)).max() <= 12
    odd = images.decode(images.encode_jpeg(np.full((13, 21, 4), 200, np.uint8)))
    assert odd.shape == (13, 21, 4) and abs(int(odd[12, 20, 0]) - 200) <= 12


def test_resize_does_not_bleed_clear_white():
    red, clear = raster.rgba(-65536), raster.rgba(0x00FFFFFF)
    out = raster.resize(np.array([[red, red], [clear, clear]]), 1, 1)[0, 0]
    assert abs(int(out[3]) - 128) <= 1 and out[0] == 255 and out[1] <= 4 and out[2] <= 4
    assert (raster.resize(np.full((4, 4, 4), 0, np.uint8) + clear, 1, 1) == 0).all()
    assert (raster.resize(raster.filled(8, 8, -12345), 2, 2) == raster.rgba(-12345)).all()


def test_composite_and_alpha():
    half = raster.scale_alpha(raster.filled(2, 2, -1), 0.5)
    out = raster.composite(raster.filled(2, 2, -16777216), half)
    assert abs(int(out[0, 0, 0]) - 128) <= 1 and out[0, 0, 3] == 255
    assert (raster.composite(half, raster.filled(1, 1, -1), 5, 5) == half).all()
    assert raster.uniform(half) is not None and raster.uniform(raster.composite(half, raster.filled(1, 1, -1))) is None


@pytest.mark.parametrize("size", [1, 2, 7, 8, 33])
def test_circle_mask_is_pure_and_symmetric(size):
    before = raster.filled(size, size, -1)
    out = raster.circle_mask(before)
    assert (before == 255).all() and (out == out[::-1]).all() and (out == out.transpose(1, 0, 2)).all()


def filtered(want, kinds):
    """Raw image data of a bitmap with the rows' filters taken in turn."""
    height, width, step = want.shape
    padded = np.zeros((height + 1, (width + 1) * step), dtype=int)
    padded[1:, step:] = want.reshape(height, -1)
    raw = b""
    for y in range(1, height + 1):
        a, b, c = padded[y, :-step], padded[y - 1, step:], padded[y - 1, :-step]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        kind = kinds[y % len(kinds)]
        raw += bytes([kind]) + bytes(((padded[y, step:] - (0 * a, a, b, (a + b) >> 1, near)[kind]) & 255).tolist())
    return raw


@pytest.mark.parametrize("kinds", [[4], [3], [4, 0, 2, 3, 1], [0, 4, 4, 0, 0]])
@pytest.mark.parametrize("band", [512, 7])
def test_sweeps_by_diagonals(monkeypatch, kinds, band):
    monkeypatch.setattr(images, "BAND", band)
    want = np.random.default_rng(1).integers(0, 256, (41, 23, 4), dtype=np.uint8)
    assert (images.decode_png(png(23, 41, 6, 8, filtered(want, kinds))) == want).all()
    grey = want[..., :1]
    assert (images.decode_png(png(23, 41, 0, 8, filtered(grey, kinds)))[..., 0] == grey[..., 0]).all()


def test_paeth_round_trip():
    want = np.random.default_rng(2).integers(0, 256, (30, 19, 4), dtype=np.uint8)
    assert (images.decode(images.encode_png(want, paeth=True)) == want).all()


def test_unknown_filters_are_refused_wherever_they_are():
    want = np.zeros((3, 3, 4), dtype=np.uint8)
    for kinds in ([5], [4, 5, 4]):
        raw = bytearray(filtered(want, [4]))
        for y, k in enumerate(kinds):
            raw[y * 13] = k
        assert images.decode(png(3, 3, 6, 8, bytes(raw))) is None


def test_jpeg_colours_come_by_whole_numbers():
    grey = np.full((8, 8, 4), 255, dtype=np.uint8)
    grey[..., :3] = (200, 40, 90)
    assert np.abs(images.decode(images.encode_jpeg(grey, 1)).astype(int) - grey).max() <= 2


def test_a_huffman_table_is_built_once_for_all_files_that_have_it():
    jpegs = [images.encode_jpeg(np.full((9, 5, 4), v, dtype=np.uint8)) for v in (10, 200, 90)]
    before = images._huffman.cache_info()
    assert all(images.decode(j).shape == (9, 5, 4) for j in jpegs)
    after = images._huffman.cache_info()
    assert after.hits + after.misses - before.hits - before.misses == 6 and after.misses - before.misses <= 2
    assert len(images._huffman(b"\0\2" + bytes(14), b"ab")) == 1 << 16 and images._huffman(b"\3" + bytes(15), b"abc")[-1] == 1 << 8 | ord("b")


def test_flat_bitmaps_stay_flat_and_mixing_is_per_pixel():
    for argb in (-1, 0x00123456, 0x01FF8000, 0x7F010203):
        flat = raster.filled(3, 5, argb)
        want = (flat[0, 0] * (argb >> 24 != 0)).tolist()
        assert raster.resize(flat, 40, 17).reshape(-1, 4).tolist() == [want] * 680
    rng = np.random.default_rng(8)
    under, over = rng.integers(0, 256, (2, 9, 7, 4)).astype(np.uint8)
    under[::2, :, 3], over[:, ::3, 3], over[:, 1::3, 3] = 0, 0, 255
    got = raster.composite(under, over)
    for u, o, g in zip(*(x.reshape(-1, 4).tolist() for x in (under, over, got)), strict=True):
        rest = (u[3] * (255 - o[3]) + 127) // 255
        a = o[3] + rest
        assert g == ([(o[i] * o[3] + u[i] * rest + a // 2) // a for i in range(3)] + [a] if a else [0] * 4)
