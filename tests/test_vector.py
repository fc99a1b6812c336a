import math

import numpy as np
import pytest

from packsight.functions import vector
from packsight.functions.raster import filled

SQUARE = "M0,0h24v24h-24z"


def area(commands, size=108, even_odd=False):
    return vector.coverage(vector.edges(commands), size, size, even_odd).sum()


def test_group_moves_and_scales():
    path = vector.Path(vector.mapped(vector.parse_path(SQUARE), vector.group(27, 27, 2, 2)), vector.Solid(-1))
    alpha = vector.rasterise(vector.Drawing([path], 108, 108), 108)[..., 3]
    ys, xs = alpha.nonzero()
    assert abs(xs.mean() - 51) <= 4 and abs(ys.mean() - 51) <= 4
    plain = vector.rasterise(vector.Drawing([vector.Path(vector.parse_path(SQUARE), vector.Solid(-1))], 108, 108), 108)
    assert plain[..., 3].nonzero()[1].max() < 24


@pytest.mark.parametrize("text", [SQUARE, "m0 0 24 0 0 24-24 0z", "M0,0 L24,0 24,24 0,24", "M0,0H24V24H0Z", "M.0.0h24v2.4e1h-24z"])
def test_equal_squares(text):
    assert area(vector.parse_path(text)) == pytest.approx(576, abs=0.5)


def test_arcs_and_run_together_flags():
    want = math.pi * 2500
    for text in ("M54,4a50,50 0 1 1 0,100a50,50 0 1 1 0,-100z", "M54,4a50,50 0 110 100a50,50 0 110-100z"):
        assert area(vector.parse_path(text)) == pytest.approx(want, rel=0.01)


def test_even_odd_and_winding():
    ring = vector.parse_path("M0,0h40v40h-40zM10,10h20v20h-20z")
    assert area(ring, even_odd=True) == pytest.approx(1200, abs=1) and area(ring) == pytest.approx(1600, abs=1)


@pytest.mark.parametrize("text", ["M0,0 h5 z 3 4", "5 5", "M1", "M0,0 C1 2 3", "M0,0 X"])
def test_malformed_paths_are_errors_not_loops(text):
    with pytest.raises(vector.BadPath):
        vector.parse_path(text)


def test_edges_cut_by_the_canvas():
    assert area(vector.parse_path("M-50,-50h100v100h-100z")) == pytest.approx(2500, abs=1)
    assert area(vector.parse_path("M-50,-50h20v20h-20z")) == 0


def test_half_pixels_are_half_covered():
    c = vector.coverage(vector.edges(vector.parse_path("M0.5,0h1v1h-1z")), 3, 1, False)
    assert c[0].tolist() == pytest.approx([0.5, 0.5, 0])


def test_gradients():
    stops = ((0.0, -16777216), (1.0, -1))
    box = vector.parse_path("M0,0h10v10h-10z")
    line = vector.draw(filled(10, 10), vector.Drawing([vector.Path(box, vector.Linear((0, 0), (10, 0), stops))], 10, 10))
    assert line[0, 0, 0] < 20 and line[0, 9, 0] > 235 and (line[0] == line[9]).all()
    disc = vector.draw(filled(10, 10), vector.Drawing([vector.Path(box, vector.Radial((5, 5), 5, stops))], 10, 10))
    assert disc[5, 5, 0] < 60 and disc[0, 0, 0] == 255


@pytest.mark.parametrize(("text", "want"), [("#fff", -1), ("#80ff0000", -2130771968), ("#f00", -65536), ("123456", -15584170), ("0x80000000", -2147483648), ("#12345", None), ("red", None), ("", None)])
def test_colours(text, want):
    assert vector.colour(text) == want


@pytest.mark.parametrize(("text", "want"), [("24dp", 24.0), ("0x41c00000", 24.0), (" 1.5 ", 1.5), ("50%", 50.0), ("x", None), (None, None)])
def test_numbers(text, want):
    assert vector.number(text) == want


def test_coverage_is_exact_for_slanted_edges():
    got = vector.coverage(vector.edges(vector.parse_path("M1.2,1.1L30.7,5.3L10.4,35.9z")), 40, 40, False)
    assert got.sum() == pytest.approx(abs(29.5 * 34.8 - 9.2 * 4.2) / 2, abs=1e-9) and got.min() >= 0 and got.max() <= 1


def test_too_many_parts_are_sampled(monkeypatch):
    lines = vector.edges(vector.parse_path("M1,1L30,5L10,35z"))
    exact = vector.coverage(lines, 40, 40, False)
    monkeypatch.setattr(vector, "MAX_PARTS", 3)
    assert abs(vector.coverage(lines, 40, 40, False) - exact).max() < 0.15


def rim(under, argb, paint=None):
    """The pixel that a shape covers by half."""
    box = vector.parse_path("M0.5,0h1v1h-1z")
    return vector.draw(filled(2, 1, under), vector.Drawing([vector.Path(box, paint or vector.Solid(argb))], 2.0, 1.0))[0, 0].tolist()


def test_rims_are_mixed_by_light_or_as_written():
    white, black = -1, -16777216
    assert rim(black, white) == pytest.approx([180, 180, 180, 255], abs=1)  # sqrt(1/2) of 255
    both = ((0.0, white), (1.0, white))
    assert rim(black, 0, vector.Linear((0, 0), (2, 0), both)) == pytest.approx([128, 128, 128, 255], abs=1)
    assert rim(0, white) == pytest.approx([255, 255, 255, 128], abs=1)


def test_large_canvases_flatten_with_larger_tolerance(monkeypatch):
    seen = []
    real = vector.edges
    monkeypatch.setattr(vector, "edges", lambda c, t=0.25: seen.append(t) or real(c, t))
    drawing = vector.Drawing([vector.Path(vector.parse_path(SQUARE), vector.Solid(-1))], 108, 108)
    for size in (767, 768, 1536):
        vector.rasterise(drawing, size)
    assert seen == [0.25, 0.35, 0.45]


def test_shapes_are_kept_and_drawn_alike():
    rng = np.random.default_rng(4)
    drawing = lambda argb: vector.Drawing([vector.Path(vector.parse_path("M3.5,2h9.25v11l-4,3z"), vector.Solid(argb))], 24.0, 24.0)
    canvas = rng.integers(0, 256, (48, 48, 4)).astype(np.uint8)
    before, found = canvas.copy(), vector._kept.cache_info()
    first, other, again = (vector.draw(canvas, drawing(c)) for c in (-1, 0x7F00FF00, -1))
    after = vector._kept.cache_info()
    assert after.misses - found.misses <= 1 and after.hits - found.hits >= 2
    assert (canvas == before).all() and (first == again).all() and (first != other).any()
    assert (first[10, 12] == 255).all() and (first[47, 47] == canvas[47, 47]).all()


def test_canvases_and_paths_that_are_too_large_to_keep():
    found = vector._kept.cache_info().currsize
    path = "M0,0h24v24h-24z" + "M1,1h1v1h-1z" * 100
    assert (vector.rasterise(vector.Drawing([vector.Path(vector.parse_path(path), vector.Solid(-1))], 24.0, 24.0), 24) == 255).all()
    assert (vector.rasterise(vector.Drawing([vector.Path(vector.parse_path("M0,0h24v24h-24z"), vector.Solid(-1))], 24.0, 24.0), 300) == 255).all()
    assert vector._kept.cache_info().currsize == found
