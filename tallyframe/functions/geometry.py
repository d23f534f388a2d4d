"""Units, boxes and colours as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_PT = 12700.0


def emu_to_pt(emu: Column) -> Column:
    return emu / EMU_PER_PT


def pt_to_emu(pt: Column) -> Column:
    return F.round(pt * EMU_PER_PT).cast("long")


def pt_to_cm(pt: Column) -> Column:
    return pt * 2.54 / 72


def angle_to_degrees(angle: Column) -> Column:
    return F.pmod(angle / 60000.0, F.lit(360.0))


def rotated_box(left: Column, top: Column, width: Column, height: Column, degrees: Column) -> Column:
    """struct(left, top, width, height) of the upright box around a rotated one."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    w, h = width * c + height * s, width * s + height * c
    return F.struct((left + (width - w) / 2).alias("left"), (top + (height - h) / 2).alias("top"), w.alias("width"), h.alias("height"))


def overlap_area(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Common area of two boxes given as (left, top, width, height)."""
    span = lambda p, s, q, t: F.greatest(F.lit(0.0), F.least(p + s, q + t) - F.greatest(p, q))
    return span(a[0], a[2], b[0], b[2]) * span(a[1], a[3], b[1], b[3])


def channels(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5)]


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _unlinear(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def to_lab(hex_: Column) -> Column:
    """struct(l, a, b) of an RRGGBB colour under D65."""
    r, g, b = (_linear(c) for c in channels(hex_))
    x = (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047
    y = r * 0.2126729 + g * 0.7151522 + b * 0.0721750
    z = (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)
    return F.struct((f(y) * 116 - 16).alias("l"), ((f(x) - f(y)) * 500).alias("a"), ((f(y) - f(z)) * 200).alias("b"))


def delta_e(one: Column, other: Column) -> Column:
    """Euclidean distance of two to_lab structs."""
    return F.sqrt(F.pow(one["l"] - other["l"], F.lit(2.0)) + F.pow(one["a"] - other["a"], F.lit(2.0)) + F.pow(one["b"] - other["b"], F.lit(2.0)))


def tint(channel: Column, share: Column) -> Column:
    """Towards white in linear light."""
    return _unlinear(_linear(channel) * share + (1 - share))


def shade(channel: Column, share: Column) -> Column:
    """Towards black in linear light."""
    return _unlinear(_linear(channel) * share)


def approx_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Within the tolerance; a null equals nothing."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
