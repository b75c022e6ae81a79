"""Numbers: units, angles, boxes and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_mm(value: Column, scale: Column) -> Column:
    """Pixels to millimetres at a scale, to 4 places; null without a scale."""
    return F.round(value * scale, 4)


def to_mm2(value: Column, scale: Column) -> Column:
    return F.round(value * scale * scale, 4)


def tray_scale(size_mm: Column, long_px: Column, short_px: Column, mode: str = "mean") -> Column:
    """Millimetres per pixel from a reference tray's known size."""
    side = {"mean": (long_px + short_px) / 2, "long": long_px, "short": short_px}[mode]
    return F.try_divide(size_mm, F.nullif(side, F.lit(0.0)))


def positive(value: Column) -> Column:
    """The number if it is finite and above 0, else null."""
    v = value.try_cast("double")
    return F.when((v > 0) & ~F.isnan(v) & (v != math.inf), v)


def turn(degrees: Column, full: float = 360.0) -> Column:
    """An angle brought into [0, full)."""
    return F.pmod(degrees, F.lit(full))


def undirected_gap(a: Column, b: Column) -> Column:
    """Degrees between two axes without direction, at most 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180 - d)


def directed_gap(a: Column, b: Column) -> Column:
    """Degrees between two directions, at most 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def unit(x: Column, y: Column) -> Column:
    """(x, y) over its length; null for the zero vector."""
    n = F.hypot(x, y)
    return F.when(n > 0, F.struct((x / n).alias("x"), (y / n).alias("y")))


def axis_gap(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two axis directions from their vectors; null for one without a length."""
    a, b = F.hypot(ax, ay), F.hypot(bx, by)
    dot = F.when((a >= 1e-6) & (b >= 1e-6), F.try_divide(F.abs(ax * bx + ay * by), a * b))
    return F.degrees(F.acos(F.when(dot > 1, 1.0).otherwise(dot)))


def point_to_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def box_area(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def overlap_area(a: tuple, b: tuple) -> Column:
    """Area shared by two boxes (x1, y1, x2, y2)."""
    return box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def size_gap(value: Column, reference: Column) -> Column:
    """|ln(value / reference)|; 0 unless both are above 0."""
    return F.when((value > 0) & (reference > 0), F.abs(F.log(value / reference))).otherwise(0.0)


def padded_box(box: tuple, pad: Column, width: Column, height: Column) -> tuple:
    """A box grown by pad on every side, rounded and clamped to an image, at least a pixel wide and high."""
    low = lambda v, top: F.greatest(F.lit(0), F.least(top - 1, F.bround(v - pad))).cast("double")
    x1, y1 = low(box[0], width), low(box[1], height)
    high = lambda v, top, other: F.greatest(F.greatest(F.lit(0), F.least(top, F.bround(v + pad))), F.least(top, other + 1)).cast("double")
    return x1, y1, high(box[2], width, x1), high(box[3], height, y1)


def ratio_box(width: Column, height: Column, ratios: tuple[float, float, float, float]) -> tuple:
    """A box at shares of an image's sides."""
    return width * ratios[0], height * ratios[1], width * ratios[2], height * ratios[3]


def clamp_box(box: tuple, width: Column, height: Column) -> tuple:
    """A box rounded half to even and clamped to an image, at least a pixel wide and high."""
    return padded_box(box, F.lit(0), width, height)


def to_display(value: Column, pad: Column, scale: Column) -> Column:
    """An image coordinate on a square display: padding before, then the scale."""
    return (value + pad) * scale


def from_display(value: Column, pad: Column, scale: Column, size: Column) -> Column:
    """A display coordinate back on the image, clamped to it."""
    return F.greatest(F.lit(0.0), F.least(size - 1, value / scale - pad))


def square_display(width: Column, height: Column, size: float) -> Column:
    """Padding left and above and the scale of an image on a square display of a size."""
    side = F.greatest(width, height, F.lit(1))
    return F.struct(F.floor((side - width) / 2).alias("left"), F.floor((side - height) / 2).alias("above"), (F.lit(float(size)) / side).alias("scale"))


def full_point(value: Column, origin: Column, size: Column, padding: int = 20) -> Column:
    """A coordinate of a cut-out on the whole image: the cut-out begins padding before its box, and the image clamps."""
    return F.greatest(F.lit(0), F.least(size - 1, F.bround(value + F.greatest(F.lit(0), origin - padding)))).cast("long")


def direction(degrees: Column) -> Column:
    """The unit vector of an axis angle."""
    t = F.radians(turn(degrees, 180.0))
    return F.struct(F.cos(t).alias("x"), F.sin(t).alias("y"))


def axis_angle(x: Column, y: Column) -> Column:
    """The axis angle of a vector in [0, 180); 0 for the zero vector."""
    return F.when(F.hypot(x, y) < 1e-6, 0.0).otherwise(turn(F.degrees(F.atan2(y, x)), 180.0))


def angle_encoding(degrees: Column) -> Column:
    """cos and sin of an angle and of its double, and the angle in radians, as label files hold them."""
    t = F.radians(turn(degrees))
    return F.struct(F.degrees(t).alias("theta_deg"), t.alias("theta_rad"), F.cos(t).alias("cos_theta"), F.sin(t).alias("sin_theta"), F.cos(2 * t).alias("cos2theta"), F.sin(2 * t).alias("sin2theta"))


def scale_limit(wanted: Column, width: Column, height: Column, most: Column) -> Column:
    """The magnification that is asked for, 1 at least, as far as the longer side stays within a limit."""
    return F.least(F.greatest(F.lit(1.0), wanted), F.greatest(F.lit(1.0), most / F.greatest(F.lit(1), width, height)))


def overlay_scale(width: Column, height: Column) -> Column:
    """Point radius, line width and letter size of an overlay by the image's shorter side."""
    side = F.greatest(F.lit(1), F.least(width, height))
    within = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), v))
    return F.struct(within(F.bround(side / 1000.0), 2.0, 3.0).cast("int").alias("radius"), within(F.bround(side / 1400.0), 1.0, 2.0).cast("int").alias("line"), within(side / 3600.0, 0.34, 0.46).alias("letters"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
