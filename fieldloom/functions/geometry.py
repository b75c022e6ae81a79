"""Polygon geometry over array<struct<x, y>>, as sums over edges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def opened(c: Column) -> Column:
    """The contour without a last point that repeats the first, as near as makes no difference."""
    a, b = F.get(c, F.lit(0)), F.get(c, F.size(c) - 1)
    again = (F.size(c) > 1) & (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) < 1e-6)
    return F.when(again, F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)


def edges(c: Column) -> Column:
    """Each point with the one that follows it around the contour: array<struct<p, q>>."""
    n = F.size(c)
    return F.transform(c, lambda p, i: F.struct(p.alias("p"), F.get(c, (i + 1) % n).alias("q")))


def over_edges(c: Column, term) -> Column:
    """Sum of term(p, q) over the edges."""
    return F.aggregate(edges(c), F.lit(0.0), lambda s, e: s + term(e["p"], e["q"]))


def cross(p, q) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def signed_area(c: Column) -> Column:
    return over_edges(c, cross) / 2


def area(c: Column) -> Column:
    """Enclosed area, whichever way round the contour runs."""
    return F.abs(signed_area(c))


def perimeter(c: Column) -> Column:
    return over_edges(c, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def circularity(area: Column, around: Column) -> Column:
    """4 pi area over the squared perimeter; 0 for no perimeter."""
    return F.when(around > 0, 4 * math.pi * area / (around * around)).otherwise(0.0)


def centroid(c: Column) -> Column:
    """Centroid by edge sums; the mean of the points if they enclose nothing; the origin without points."""
    a6 = 6 * signed_area(c)
    x = over_edges(c, lambda p, q: (p["x"] + q["x"]) * cross(p, q))
    y = over_edges(c, lambda p, q: (p["y"] + q["y"]) * cross(p, q))
    mean = lambda k: F.aggregate(c, F.lit(0.0), lambda s, p: s + p[k]) / F.size(c)
    return F.struct(*[F.when(F.size(c) == 0, 0.0).when(F.abs(a6) > 1e-12, v / a6).otherwise(mean(k)).alias(k) for k, v in (("x", x), ("y", y))])


def second_moments(c: Column, at: Column) -> Column:
    """Central second moments (xx, yy, xy) of the enclosed area, over that area."""
    moved = F.transform(c, lambda p: F.struct((p["x"] - at["x"]).alias("x"), (p["y"] - at["y"]).alias("y")))
    a = signed_area(c)
    xx = over_edges(moved, lambda p, q: (p["x"] * p["x"] + p["x"] * q["x"] + q["x"] * q["x"]) * cross(p, q)) / 12
    yy = over_edges(moved, lambda p, q: (p["y"] * p["y"] + p["y"] * q["y"] + q["y"] * q["y"]) * cross(p, q)) / 12
    xy = over_edges(moved, lambda p, q: (p["x"] * q["y"] + 2 * p["x"] * p["y"] + 2 * q["x"] * q["y"] + q["x"] * p["y"]) * cross(p, q)) / 24
    return F.struct(*[F.try_divide(v, a).alias(n) for n, v in (("xx", xx), ("yy", yy), ("xy", xy))])


def principal(m: Column) -> Column:
    """Angle of the greater axis in degrees [0, 180), and the lesser over the greater spread."""
    half, diff = (m["xx"] + m["yy"]) / 2, (m["xx"] - m["yy"]) / 2
    root = F.sqrt(diff * diff + m["xy"] * m["xy"])
    angle = F.pmod(F.degrees(0.5 * F.atan2(2 * m["xy"], m["xx"] - m["yy"])), F.lit(180.0))
    ratio = F.coalesce(F.sqrt(F.try_divide(F.greatest(half - root, F.lit(0.0)), half + root)), F.lit(1.0))
    return F.struct(angle.alias("angle"), ratio.alias("ratio"))


def eccentricity(ratio: Column) -> Column:
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    return F.sqrt(1 - r * r)


def _sides(c: Column, ox, oy, ux, uy) -> Column:
    """Each edge in the frame of an axis: how far its ends lie along it (s, t) and across it (a, b)."""
    along = lambda p: (p["x"] - ox) * ux + (p["y"] - oy) * uy
    across = lambda p: (p["y"] - oy) * ux - (p["x"] - ox) * uy
    return F.transform(edges(c), lambda e: F.struct(along(e["p"]).alias("s"), along(e["q"]).alias("t"), across(e["p"]).alias("a"), across(e["q"]).alias("b")))


def merged(hits: Column, gap: float = 1.0) -> Column:
    """Sorted numbers in which one that follows within a gap is averaged into the one before it."""
    last = lambda m: F.get(m, F.size(m) - 1)
    step = lambda m, h: F.when((F.size(m) > 0) & (h - last(m) <= gap), F.concat(F.slice(m, F.lit(1), F.size(m) - 1), F.array((last(m) + h) / 2))).otherwise(F.concat(m, F.array(h)))
    return F.aggregate(F.sort_array(hits), F.array().cast("array<double>"), step)


def crossings(sides: Column, at) -> Column:
    """Where a line across an axis, at a place along it, meets the contour; places within a pixel count once."""
    over = F.filter(sides, lambda e: (e["s"] >= at) != (e["t"] >= at))
    return merged(F.transform(over, lambda e: e["a"] + (e["b"] - e["a"]) * (e["s"] - at) / (e["s"] - e["t"])))


def _extent(hits: Column) -> Column:
    return F.when(F.size(hits) >= 2, F.get(hits, F.size(hits) - 1) - F.get(hits, F.lit(0))).otherwise(0.0)


def widths_at(c: Column, bottom: Column, top: Column, fractions: Column) -> Column:
    """Distance of the outermost crossings of lines across the axis at fractions of it; 0 for fewer than two, and on an axis under a pixel.

    The contour is brought into the axis's frame once for all fractions.
    """
    dx, dy = top["x"] - bottom["x"], top["y"] - bottom["y"]
    axis = F.struct(F.hypot(dx, dy).alias("l"), F.when(F.hypot(dx, dy) > 0, dx / F.hypot(dx, dy)).otherwise(0.0).alias("ux"), F.when(F.hypot(dx, dy) > 0, dy / F.hypot(dx, dy)).otherwise(-1.0).alias("uy"), bottom["x"].alias("x"), bottom["y"].alias("y"))
    return let(axis, lambda x: let(_sides(c, x["x"], x["y"], x["ux"], x["uy"]), lambda sides: F.transform(fractions, lambda f: F.when(x["l"] >= 1, let(crossings(sides, f * x["l"]), _extent)).otherwise(0.0))))


def width_at(c: Column, bottom: Column, top: Column, fraction: float) -> Column:
    return F.get(widths_at(c, bottom, top, F.array(F.lit(float(fraction)))), F.lit(0))


def width_profile(c: Column, bottom: Column, top: Column, samples: int = 100) -> Column:
    return widths_at(c, bottom, top, F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: i / (samples - 1)))


def support_widths(c: Column, bottom: Column, top: Column, fractions: tuple[float, float, float] = (0.12, 0.50, 0.75)) -> Column:
    """Widths near the bottom end, in the middle and in the upper part."""
    return let(widths_at(c, bottom, top, F.array(*map(F.lit, fractions))), lambda w: F.struct(*[F.get(w, F.lit(i)).alias(n) for i, n in enumerate(("near", "mid", "upper"))]))


def bundle(c: Column, bottom: Column, top: Column, samples: int = 100) -> Column:
    """All measurements of an outline with an axis, in pixels.

    The widths at a quarter, half and three quarters count from the top end; the
    greatest width is that of a scan. An axis under a pixel has no widths, and
    then, or without a middle width, there is no length to width ratio.
    """
    length = F.hypot(top["x"] - bottom["x"], top["y"] - bottom["y"])
    ring = opened(c)

    def all_of(ring):
        def with_widths(w):
            round_ = let(F.struct(area(ring).alias("a"), perimeter(ring).alias("p")), lambda m: F.struct(m["a"].alias("a"), m["p"].alias("p"), circularity(m["a"], m["p"]).alias("c")))
            by_area = let(centroid(ring), lambda at: let(second_moments(ring, at), principal))
            spread = F.when(area(ring) > 1e-12, by_area).otherwise(point_spread(ring))
            return let(F.struct(round_.alias("r"), spread.alias("s")), lambda x: F.struct(
                length.alias("axis_length"), w["w"][0].alias("width_25pct"), w["w"][1].alias("width_50pct"), w["w"][2].alias("width_75pct"), F.array_max(w["scan"]).alias("max_width"), w["p"].alias("max_width_at"),
                x["r"]["a"].alias("area"), x["r"]["p"].alias("perimeter"), x["r"]["c"].alias("circularity"), x["s"]["ratio"].alias("minor_major_ratio"), eccentricity(x["s"]["ratio"]).alias("eccentricity"),
                F.when((length >= 1) & (w["w"][1] > 1e-6), length / w["w"][1]).alias("length_width_ratio"),
            ))

        scan = width_profile(ring, bottom, top, samples)
        quarters = widths_at(ring, top, bottom, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return let(scan, lambda s: let(F.struct(s.alias("scan"), quarters.alias("w"), ((F.array_position(s, F.array_max(s)) - 1) / (samples - 1)).alias("p")), with_widths))

    return let(ring, all_of)


def axis_ends(c: Column, at: Column, angle: Column) -> Column:
    """Where the line through a point at an angle leaves the contour: the outermost crossings behind (a) and before (b) the point.

    If all crossings lie to one side, the outermost two; null for fewer than two, or for ends within a pixel.
    """
    u = F.struct(F.cos(F.radians(angle)).alias("x"), F.sin(F.radians(angle)).alias("y"))

    def ends(o):
        # In the frame of the line's normal, what lies across is the way along the line.
        hits = crossings(_sides(c, o["x"], o["y"], o["uy"], -o["ux"]), F.lit(0.0))

        def pick(h):
            lo, hi = F.get(h, F.lit(0)), F.get(h, F.size(h) - 1)
            point = lambda d: F.struct((o["x"] + d * o["ux"]).alias("x"), (o["y"] + d * o["uy"]).alias("y"))
            return F.when((F.size(h) >= 2) & (hi - lo >= 1), F.struct(point(lo).alias("a"), point(hi).alias("b"), (hi - lo).alias("length")))

        return let(hits, pick)

    return let(F.struct(at["x"].alias("x"), at["y"].alias("y"), u["x"].alias("ux"), u["y"].alias("uy")), ends)


def model_axis(c: Column, at: Column, theta: Column) -> Column:
    """Bottom and top of an object from a directed angle: the crossing farthest with the direction is the bottom, the one farthest against it the top; without two, the points with greatest and least projection."""
    return F.coalesce(let(axis_ends(c, at, theta), lambda e: F.when(e.isNotNull(), F.struct(e["b"].alias("bottom"), e["a"].alias("top")))), farthest_along(c, at, theta))


def axis_scan(c: Column, at: Column, step: int = 1) -> Column:
    """Chords through a point at every step degrees from 0 to 179 that have two ends: array<struct<length, angle>>."""
    each = F.transform(F.sequence(F.lit(0), F.lit(179), F.lit(step)), lambda d: let(axis_ends(c, at, d.cast("double")), lambda e: F.when(e.isNotNull(), F.struct(e["length"].alias("length"), d.cast("double").alias("angle")))))
    return F.filter(each, lambda x: x.isNotNull())


def nearest_index(c: Column, p: Column) -> Column:
    """Place of the contour's point nearest to a point, the first on ties."""
    d = F.transform(c, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return let(d, lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)


def point_spread(c: Column) -> Column:
    """Principal axis of the contour's points by their sample covariance: angle in [0, 180) and lesser over greater spread; a ratio of 1 for under three points."""
    at = mean_point(c)

    def spread(m):
        total = lambda a, b: F.aggregate(c, F.lit(0.0), lambda s, p: s + (p[a] - m[a]) * (p[b] - m[b])) / (F.size(c) - 1)
        return let(F.struct(total("x", "x").alias("xx"), total("y", "y").alias("yy"), total("x", "y").alias("xy")), principal)

    return F.when(F.size(c) >= 3, let(at, spread)).otherwise(F.struct(F.lit(90.0).alias("angle"), F.lit(1.0).alias("ratio")))


#: Scales of the windows of sharpness, and how much each further scale widens the neighbourhood and loses weight (fixed values).
SCALES, WIDER, LIGHTER = (1.0, 2.0, 3.5), 0.6, 0.5


def windows(size: int, base: int = 5) -> list[int]:
    """Window of each scale for a contour of a size, without repeats."""
    most = max(1, size // 6)
    return list(dict.fromkeys(max(1, min(round(max(1.0, base * f)), most)) for f in SCALES))


def tip_sharpness(c: Column, at: Column, size: int, base: int = 5, radius: int = 2) -> Column:
    """How pointed a contour of a size is round its point at a place: over each scale the greatest sharpness among the neighbours and the mean of the greatest ones, averaged with less weight to wider scales."""

    def score(w, r):
        """At one scale; Spark counts a lambda's parameters, so w and r are bound here."""
        top = min(2 * r + 1, max(2, r + 1))
        near = let(sharpness(c, w), lambda s: F.sort_array(F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda o: F.get(s, F.pmod(at + o, F.lit(size)))), asc=False))
        return let(near, lambda n: 0.65 * F.get(n, F.lit(0)) + 0.35 * F.aggregate(F.slice(n, 1, top), F.lit(0.0), lambda s, x: s + x) / top)

    levels = list(enumerate(windows(size, base)))
    weights = [1 / (1 + LIGHTER * level) for level, _ in levels]
    total = F.lit(0.0)
    for (level, w), weight in zip(levels, weights, strict=True):
        total = total + score(w, max(radius, round(radius * (1 + WIDER * level)))) * weight
    return total / sum(weights)


def taper_score(w: Column) -> Column:
    """Whether support widths grow from the bottom end on: how much narrower the end is (0.45 against the middle, 0.55 against the upper part), and 1, 0.5 or 0 for rising in both, one or no steps."""
    over = lambda k: F.when(w[k] > 1e-6, 1 - F.least(F.lit(2.0), w["near"] / w[k])).otherwise(0.0)
    rising = F.when((w["near"] <= w["mid"]) & (w["mid"] <= w["upper"]), 1.0).when((w["near"] <= w["mid"]) | (w["near"] <= w["upper"]), 0.5).otherwise(0.0)
    return F.struct((0.45 * over("mid") + 0.55 * over("upper")).alias("taper"), rising.alias("rising"))


def bottom_score(sharp: Column, widths: Column) -> Column:
    """Score of an axis end as the bottom: its sharpness, and with less weight its taper."""
    return let(taper_score(widths), lambda t: sharp + 0.35 * t["taper"] + 0.15 * t["rising"])


def farthest_along(c: Column, at: Column, angle: Column) -> Column:
    """The contour's points with greatest and least projection on a direction through at, first ones on ties."""
    ux, uy = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    d = F.transform(c, lambda p: (p["x"] - at["x"]) * ux + (p["y"] - at["y"]) * uy)
    pick = lambda v: F.element_at(c, F.array_position(d, v).cast("int"))
    return F.struct(pick(F.array_max(d)).alias("bottom"), pick(F.array_min(d)).alias("top"))


def sampled(c: Column, n: int) -> Column:
    """n points, 24 at least, at even steps of the contour's index, between its points where a step falls there."""
    n = max(24, n)

    def point(i):
        at = i * F.size(c) / n
        k = F.floor(at).cast("int")
        t, p, q = at - k, F.get(c, k), F.get(c, (k + 1) % F.size(c))
        return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def resampled(c: Column, n: int = 360) -> Column:
    """n points, 24 at least, at even distances along the closed contour."""
    n = max(24, n)
    step = lambda s, e: F.struct(F.concat(s["ends"], F.array(s["at"] + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))).alias("ends"), (s["at"] + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])).alias("at"))
    start = F.struct(F.array().cast("array<double>").alias("ends"), F.lit(0.0).alias("at"))

    def points(ends):
        def point(i):
            d = i * F.element_at(ends, -1) / n
            return let(F.size(F.filter(ends, lambda e: e <= d)), lambda k: between(d, k))

        def between(d, k):
            before = F.coalesce(F.get(ends, k - 1), F.lit(0.0))
            t = (d - before) / F.greatest(F.get(ends, k) - before, F.lit(1e-6))
            p, q = F.get(c, k), F.get(c, (k + 1) % F.size(c))
            return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)

    return let(F.aggregate(edges(c), start, step, lambda s: s["ends"]), points)


def smoothed(c: Column, window: int, size: int, iterations: int = 1) -> Column:
    """Circular moving average of a contour of a given size, so many times over; the window is odd, 3 at least and a third of the size at most, and one of 1 changes nothing."""
    if size < 3 or window <= 1:
        return c
    if iterations > 1:
        return let(smoothed(c, window, size), lambda s: smoothed(s, window, size, iterations - 1))
    w = max(3, min(window + (window % 2 == 0), max(3, size // 3)))
    r = w // 2

    def mean(i, k):
        return sum((F.get(c, (i + d + size) % size)[k] for d in range(-r, w - r)), F.lit(0.0)) / w

    return F.transform(c, lambda p, i: F.struct(mean(i, "x").alias("x"), mean(i, "y").alias("y")))


def sharpness(c: Column, window: int = 5) -> Column:
    """How pointed the contour is at each point: 0 for a straight run, 1 for a needle, from the angle between the points a window away."""
    n = F.size(c)
    w = F.greatest(F.lit(1), F.least(F.lit(window), F.greatest(F.lit(1), F.floor(n / 8).cast("int"))))

    def at(p, i):
        a, b = F.get(c, (i - w + n) % n), F.get(c, (i + w) % n)
        ax, ay, bx, by = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
        size = F.hypot(ax, ay) * F.hypot(bx, by)
        turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size)))
        return F.when((F.hypot(ax, ay) < 1e-6) | (F.hypot(bx, by) < 1e-6), 0.0).otherwise(1 - turn / math.pi)

    return F.transform(c, at)


def oriented(c: Column, a: Column, b: Column, size: int) -> Column:
    """Two ends of an axis as bottom and top of a contour of a size: the bottom has the higher score, the first end on ties."""

    def choose(e):
        score = lambda p, q: bottom_score(tip_sharpness(c, nearest_index(c, p), size), support_widths(c, p, q))
        ends = lambda p, q, x, y: F.struct(p.alias("bottom"), q.alias("top"), x.alias("score"), y.alias("top_score"))
        return let(F.struct(score(e["a"], e["b"]).alias("a"), score(e["b"], e["a"]).alias("b")), lambda s: F.when(s["a"] >= s["b"], ends(e["a"], e["b"], s["a"], s["b"])).otherwise(ends(e["b"], e["a"], s["b"], s["a"])))

    return let(F.struct(a.alias("a"), b.alias("b")), choose)


def direction_axis(c: Column, at: Column, angle: Column, size: int) -> Column:
    """Bottom and top on the line through a point at an angle, whichever way round; null if it has no two ends."""
    return let(axis_ends(c, at, angle), lambda e: F.when(e.isNotNull(), oriented(c, e["a"], e["b"], size)))


def fallback_axis(c: Column, at: Column, size: int) -> Column:
    """An axis along the greater spread of the contour's points: through a point if the line has two ends, else between the points with least and greatest projection."""

    def along(angle):
        extremes = let(farthest_along(c, at, angle), lambda f: oriented(c, f["top"], f["bottom"], size))
        return F.coalesce(direction_axis(c, at, angle, size), extremes)

    return let(point_spread(c)["angle"], along)


def analysis_contour(c: Column, n: int = 360) -> Column:
    """n points at even steps of the contour's index, then n points at even distances along those."""
    return let(sampled(c, n), lambda s: resampled(s, n))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although body may use it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_point(c: Column) -> Column:
    total = lambda k: F.aggregate(c, F.lit(0.0), lambda s, p: s + p[k])
    return F.struct((total("x") / F.size(c)).alias("x"), (total("y") / F.size(c)).alias("y"))


def polar(c: Column, at: Column) -> Column:
    """Points by angle around a point: array<struct<angle, radius>>."""
    return F.sort_array(F.transform(c, lambda p: F.struct(F.atan2(p["y"] - at["y"], p["x"] - at["x"]).alias("angle"), F.hypot(p["x"] - at["x"], p["y"] - at["y"]).alias("radius"))))


def circle_deviation(c: Column) -> Column:
    """Deviation of each point's radius from a circle of mean radius one half, by angle around the mean point."""
    mean = lambda points: F.aggregate(points, F.lit(0.0), lambda s, p: s + p["radius"]) / F.size(points)
    spread = lambda points: let(mean(points), lambda m: F.transform(points, lambda p: p["radius"] / m * 0.5 - 0.5))
    return let(let(mean_point(c), lambda at: polar(c, at)), spread)
