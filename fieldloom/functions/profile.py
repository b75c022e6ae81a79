"""Width profiles, held as arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mostly_empty(w: Column, most: float = 0.1) -> Column:
    """Whether more than a share of the widths is 0 or less; not so without widths."""
    return F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x <= 0)), F.size(w)) > most, F.lit(False))


def at_fraction(w: Column, fraction: float) -> Column:
    """The width at a fraction of the axis; the place is truncated."""
    return F.get(w, F.floor(fraction * (F.size(w) - 1)).cast("int"))


def peak_percent(w: Column) -> Column:
    """Where the first greatest width stands, in percent of the axis; a single width stands at its start."""
    return 100 * (F.array_position(w, F.array_max(w)) - 1) / F.greatest(F.size(w) - 1, F.lit(1))


def to_axis(w: Column, length: Column, target: float = 100.0) -> Column:
    """Widths as if the axis were target long; as they are on an axis of no length."""
    return F.when(length < 1e-6, w).otherwise(F.transform(w, lambda x: x * target / F.greatest(length, F.lit(1e-6))))


def gaussian(w: Column, sigma: float = 1.5) -> Column:
    """Smoothed widths; edges are replicated and both ends keep their values."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [x / sum(raw) for x in raw]
    n = F.size(w)

    def value(x, i):
        total = F.lit(0.0)
        for k, g in zip(range(-radius, radius + 1), weights, strict=True):
            total = total + g * F.get(w, F.greatest(F.lit(0), F.least(n - 1, i + k)))
        return F.when((i == 0) | (i == n - 1), x).otherwise(total)

    return F.transform(w, value)


def exponential(w: Column, weight: float = 0.72) -> Column:
    """Each value mixed with the smoothed one before it."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))

    def step(s, x):
        y = F.coalesce(weight * s["last"] + (1 - weight) * x, x)
        return F.struct(F.concat(s["out"], F.array(y)).alias("out"), y.alias("last"))

    return F.aggregate(w, start, step, lambda s: s["out"])


def total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x)


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def iou(a: Column, b: Column) -> Column:
    """Sum of lesser widths over sum of greater ones; 0 if all are empty."""
    return F.coalesce(F.try_divide(total(F.zip_with(a, b, lambda x, y: F.least(x, y))), total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))), F.lit(0.0))


def standardise(w: Column, mean: Column, spread: Column) -> Column:
    """Each position less its mean over its spread; a spread next to 0 counts as 1."""
    return F.transform(F.arrays_zip(w.alias("w"), mean.alias("m"), spread.alias("s")), lambda z: (z["w"] - z["m"]) / F.when(z["s"] < 1e-8, 1.0).otherwise(z["s"]))


def outline(w: Column, closed: bool = False) -> Column:
    """Closed symmetric outline: right half widths from one end to the other, left ones back; tips are 0 if closed."""
    n = F.size(w)
    half = F.transform(w, lambda x, i: F.when(F.lit(closed) & ((i == 0) | (i == n - 1)), 0.0).otherwise(x / 2))
    step = lambda i: i / (n - 1)
    right = F.transform(half, lambda x, i: F.struct(x.alias("x"), step(i).alias("y")))
    left = F.reverse(F.transform(half, lambda x, i: F.struct((-x).alias("x"), step(i).alias("y"))))
    return F.concat(right, left)


def trimmed_mean(v: Column, trim: float) -> Column:
    """Mean of the finite values without the floor(n * trim) greatest; trim is held within 0 and 0.45."""
    share = min(max(trim, 0.0), 0.45)
    ok = F.array_sort(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    keep = F.slice(ok, F.lit(1), F.size(ok) - F.floor(F.size(ok) * share).cast("int"))
    return F.try_divide(total(keep), F.size(keep).cast("double"))
