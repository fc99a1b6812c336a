"""Bitmap operations: pure functions on (height, width, 4) uint8 straight-alpha RGBA arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Width of the circle mask's soft edge, in pixels.
FEATHER = 1.5


def rgba(argb: int) -> np.ndarray:
    return np.array([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24 & 255], dtype=np.uint8)


def filled(width: int, height: int, argb: int = 0) -> np.ndarray:
    return np.broadcast_to(rgba(argb), (height, width, 4)).copy()


def uniform(bitmap: np.ndarray) -> int | None:
    """The one colour of a bitmap, as ARGB."""
    first = bitmap.reshape(-1, 4)[0]
    if not (bitmap == first).all():
        return None
    r, g, b, a = (int(x) for x in first)
    argb = a << 24 | r << 16 | g << 8 | b
    return argb - (1 << 32) if argb >> 31 else argb


def composite(under: np.ndarray, over: np.ndarray, x: int = 0, y: int = 0) -> np.ndarray:
    """Source-over of straight-alpha bitmaps; ``over`` is placed at (x, y) and clipped."""
    out = under.copy()
    top, left = max(0, y), max(0, x)
    bottom, right = min(under.shape[0], y + over.shape[0]), min(under.shape[1], x + over.shape[1])
    if top >= bottom or left >= right:
        return out
    s = over[top - y : bottom - y, left - x : right - x]
    d = out[top:bottom, left:right]
    if (s[..., 3] == 255).all():
        d[...] = s
        return out
    # opaque pixels take the upper colour, clear ones leave the lower; those between are mixed, and no others
    d[d[..., 3] == 0] = 0
    whole = s[..., 3] == 255
    d[whole] = s[whole]
    some = (s[..., 3] > 0) & ~whole
    s, low = s[some].astype(np.int32), d[some].astype(np.int32)
    sa, da = s[:, 3:], low[:, 3:]
    rest = (da * (255 - sa) + 127) // 255
    alpha = sa + rest
    colour = (s[:, :3] * sa + low[:, :3] * rest + alpha // 2) // alpha
    d[some] = np.minimum(np.concatenate((colour, alpha), axis=1), 255)
    return out


def scale_alpha(bitmap: np.ndarray, alpha: float) -> np.ndarray:
    out = bitmap.copy()
    out[..., 3] = np.clip(bitmap[..., 3] * float(np.clip(alpha, 0, 1)) + 0.5, 0, 255).astype(np.uint8)
    return out


def _taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target pixel the two source pixels around its centre and the 16-bit share of the second."""
    step = (source << 16) // target
    at = np.maximum(0, step * np.arange(target, dtype=np.int64) + step // 2 - (1 << 15))
    first = np.minimum(at >> 16, source - 1)
    return first, np.minimum(first + 1, source - 1), at & 0xFFFF


def resize(bitmap: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear on premultiplied colours, so that clear pixels lend no colour to their neighbours."""
    if bitmap.shape[:2] == (height, width):
        return bitmap
    if (bitmap == bitmap[:1, :1]).all():  # one colour stays that colour
        return np.broadcast_to(bitmap[0, 0] * (bitmap[0, 0, 3] > 0), (height, width, 4)).copy()
    x0, x1, fx = _taps(bitmap.shape[1], width)
    y0, y1, fy = _taps(bitmap.shape[0], height)
    # 255 x 255 x 65,536 is still below 2**32
    fx, fy = fx[None, :, None].astype(np.uint32), fy[:, None, None].astype(np.uint32)
    one, shift = np.uint32(1 << 16), np.uint32(16)
    opaque = bool((bitmap[..., 3] == 255).all())
    if opaque:
        pre = bitmap[..., :3].astype(np.uint32) * np.uint32(255)
    else:
        alpha = bitmap[..., 3:].astype(np.uint32)
        pre = np.concatenate((bitmap[..., :3] * alpha, alpha * np.uint32(255)), axis=2)
    rows = pre[y0] * (one - fy) + pre[y1] * fy >> shift
    mixed, right = np.take(rows, x0, axis=1), np.take(rows, x1, axis=1)
    mixed *= one - fx
    right *= fx
    mixed += right
    mixed >>= shift
    out = np.empty((height, width, 4), dtype=np.uint8)
    if opaque:
        mixed *= np.uint32(255)
        mixed += np.uint32(255 * 255 // 2)
        mixed //= np.uint32(255 * 255)
        out[..., :3] = mixed
        out[..., 3] = 255
        return out
    a = mixed[..., 3:]
    out[..., :3] = np.minimum((mixed[..., :3] * np.uint32(255) + a // 2) // np.maximum(a, 1), 255)
    out[..., :3][a[..., 0] == 0] = 0
    out[..., 3:] = (a + np.uint32(127)) // np.uint32(255)
    return out


def smoothstep(x: np.ndarray) -> np.ndarray:
    s = np.clip(x, 0, 1)
    return s * s * (3 - 2 * s)


@lru_cache(maxsize=8)
def circle(width: int, height: int) -> np.ndarray:
    """The share of each pixel that the inscribed circle keeps; its radius reaches half a pixel beyond the rim."""
    size = min(width, height)
    cx, cy = (width - 1) / 2, (height - 1) / 2
    distance = np.hypot(np.arange(width)[None, :] - cx, np.arange(height)[:, None] - cy)
    return smoothstep((size / 2 + 0.5 - distance) / FEATHER).astype(np.float32)


@lru_cache(maxsize=8)
def _rim(width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the circle: the pixels that it does not keep, those that it keeps in part, and their shares."""
    share = circle(width, height).ravel()
    some = np.flatnonzero((share > 0) & (share < 1))
    return np.flatnonzero(share <= 0), some, share[some, None]


def circle_mask(bitmap: np.ndarray) -> np.ndarray:
    clear, some, share = _rim(bitmap.shape[1], bitmap.shape[0])
    out = bitmap.copy()
    flat = out.reshape(-1, 4)
    flat[clear] = 0
    flat[some] = np.clip(flat[some] * share + 0.5, 0, 255).astype(np.uint8)
    return out
