"""Colour and geometry rules as column expressions: they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsight.functions.vector import Affine


def channels(argb: Column) -> list[Column]:
    """Alpha, red, green and blue of a colour held in a long."""
    return [F.shiftrightunsigned(argb.cast("long"), s).bitwiseAND(F.lit(255).cast("long")) for s in (24, 16, 8, 0)]


def packed(a: Column, r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 24).bitwiseOR(F.shiftleft(r.cast("long"), 16)).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def div(a: Column, b: Column | int) -> Column:
    """Whole division towards zero."""
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def source_over(sa: Column, sc: Column, da: Column, dc: Column) -> tuple[Column, Column]:
    """Alpha and one channel of straight-alpha source-over, rounded as bitmaps are."""
    rest = div(da * (F.lit(255) - sa) + 127, 255)
    a = sa + rest
    return a, F.when(a > 0, div(sc * sa + dc * rest + div(a, 2), F.greatest(a, F.lit(1)))).otherwise(F.lit(0).cast("long"))


def fade(x: Column) -> Column:
    """Smoothstep of x clipped to 0..1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return s * s * (3 - 2 * s)


def transformed(x: Column, y: Column, m: Affine) -> tuple[Column, Column]:
    return x * m.a + y * m.c + m.e, x * m.b + y * m.d + m.f


def hex_colour(text: Column) -> Column:
    """Unsigned ARGB in a long from ``#`` and 3, 4, 6 or 8 hex digits; null for anything else."""
    digits = F.substring(text, 2, 8)
    doubled = F.regexp_replace(digits, "(.)", "$1$1")
    full = (
        F.when(F.length(text) == 4, F.concat(F.lit("ff"), doubled)).when(F.length(text) == 5, doubled)
        .when(F.length(text) == 7, F.concat(F.lit("ff"), digits)).when(F.length(text) == 9, digits)
    )
    return F.when(text.rlike("^#[0-9a-fA-F]+$"), F.conv(full, 16, 10).cast("long"))


def resource_id(res_id: Column) -> tuple[Column, Column, Column]:
    """Package, type and entry of a resource id."""
    wide = res_id.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(wide, 24).cast("int"), F.shiftright(wide, 16).bitwiseAND(F.lit(255).cast("long")).cast("int"), wide.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


def image_kind(content: Column) -> Column:
    """png, jpeg or webp by the first bytes."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "8950", "png").when(head == "FFD8", "jpeg").when(head == "5249", "webp")
