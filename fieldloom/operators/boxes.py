"""Detection boxes: filters, overlaps, order, suppression. Everything is per image, so images spread over tasks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import cells
from ..functions import numeric as num


def settled(df: DataFrame) -> DataFrame:
    """The same rows. What has been computed so far isn't merged into later expressions, whose size would multiply with each step that uses it several times."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")


def clip_to_tray(df: DataFrame, tray: tuple[str, str, str, str], least: float = 0.55) -> DataFrame:
    """Whether each box lies outside its tray, and the box clipped to it.

    Outside: its centre isn't in the tray, or under a share of it is.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    t = tuple(F.col(c) for c in tray)
    share = F.coalesce(F.try_divide(num.overlap_area((x1, y1, x2, y2), t), num.box_area(x1, y1, x2, y2)), F.lit(0.0))
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    inside = cx.between(t[0], t[2]) & cy.between(t[1], t[3])
    out = df.withColumns({"tray_share": share, "outside_tray": ~inside | (share < least)})
    return out.withColumns({"cx1": F.greatest(x1, t[0]), "cy1": F.greatest(y1, t[1]), "cx2": F.least(x2, t[2]), "cy2": F.least(y2, t[3])})


#: Sizes that count as odd, over the median of the image (area, then sides); shares and ratios of nested and fused boxes; weights of a box's oddness (fixed values).
AREA_RATIOS, SIDE_RATIOS = (0.35, 3.0), (0.45, 2.2)
NESTED_SHARE, NESTED_RATIO, FUSED_RATIO = 0.86, 1.15, 1.25
SIDE_WEIGHT, SURE_WEIGHT, CLEAR_GAP = 0.45, 0.25, 0.05
#: Least share of a box in its tray; padding of a tray and width of an image's edge as shares of the shorter side, and the edge's least width (fixed values).
TRAY_SHARE, TRAY_PADDING, EDGE_SHARE, EDGE_LEAST = 0.55, 0.005, 0.02, 10


def with_sizes(df: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return df.withColumns({"area": w * h, "long_side": F.greatest(w, h), "short_side": F.least(w, h)})


def flag_sizes(df: DataFrame, aspect: float = 4.0, enough: int = 8) -> DataFrame:
    """Aspect and size flags, with the reasons in order; sizes are held against the medians of the image's boxes that are still active.

    Boxes whose column inside is false, if there is one, are judged no more. With fewer than enough active boxes no size is odd. A box may be both too
    small and too large, by different sides.
    """
    active = F.col("inside") if "inside" in df.columns else F.lit(True)
    df = settled(with_sizes(df).withColumn("bad_aspect", active & (F.col("long_side") > aspect * F.greatest(F.col("short_side"), F.lit(1)))))
    sizes = ["area", "long_side", "short_side"]
    plausible = active & ~F.col("bad_aspect")
    own = Window.partitionBy("image_no")
    df = df.where("image_no is not null").withColumns({**{f"middle_{c}": F.median(F.when(plausible, F.col(c))).over(own) for c in sizes}, "active": F.count_if(plausible).over(own)})
    judged = plausible & (F.col("active") >= enough)
    beyond = lambda k, less: [F.col(c) < r[k] * F.col(f"middle_{c}") if less else F.col(c) > r[k] * F.col(f"middle_{c}") for c, r in zip(sizes, (AREA_RATIOS, SIDE_RATIOS, SIDE_RATIOS), strict=True)]
    some = lambda cs: F.coalesce(judged & (cs[0] | cs[1] | cs[2]), F.lit(False))
    df = df.withColumns({"too_small": some(beyond(0, True)), "too_large": some(beyond(1, False))})
    df = df.withColumn("odd_size", F.col("too_small") | F.col("too_large"))
    reasons = F.array_compact(F.array(F.when(F.col("bad_aspect"), "bad_aspect_ratio"), F.when(F.col("too_small"), "too_small"), F.when(F.col("too_large"), "too_large")))
    return settled(df.withColumns({"reasons": F.array_distinct(reasons), "kept": ~F.col("bad_aspect") & ~F.col("odd_size")}))


def final_ids(df: DataFrame, order: list[Column]) -> DataFrame:
    """Numbers from 1 over each image's kept boxes in order; null for the others."""
    w = Window.partitionBy("image_no").orderBy(*order)
    return df.withColumn("final_id", F.when(F.col("kept"), F.sum(F.col("kept").cast("long")).over(w)))


_BOX = ("box_id", "x1", "y1", "x2", "y2", "conf")


def by_image(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(image_no, boxes): each image's boxes in one row, by number; a detector gives a thousand of an image at most."""
    return df.groupBy("image_no").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("boxes"))


def _flat(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, pa.Array], dict[str, np.ndarray]]:
    """Of rows (image_no, boxes): each box's row, its columns, and their values as doubles, a missing one not a number."""
    boxes = batch.column(1)
    flat = boxes.flatten()
    columns = {n: flat.field(i) for i, n in enumerate(names)}
    values = {n: c.cast(pa.float64()).to_numpy(zero_copy_only=False) for n, c in columns.items() if n not in ("box_id", "digit", "own")}
    return np.repeat(np.arange(len(batch)), np.diff(boxes.offsets.to_numpy())), columns, values


#: Boxes that are looked at together; an image is never cut.
TOGETHER = 20_000


def _parts(batches):
    """Slices of batches of rows (image_no, boxes, ...) with about TOGETHER boxes, or one image: what boxes need beside them grows with their number."""
    for batch in batches:
        ends, start = np.cumsum(np.diff(batch.column(1).offsets.to_numpy())), 0
        while start < len(batch):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _corners(v: dict[str, np.ndarray]) -> tuple:
    return v["x1"], v["y1"], v["x2"], v["y2"]


def _nested(image, corners, share, ratio):
    """Boxes i and j of which the smaller lies in the larger by a share, and that differ by a ratio; overlap and ratio."""
    i, j = cells.Grid(image, *corners).meeting()
    size = cells.area(*corners)
    least = np.maximum(np.minimum(size[i], size[j]), 1.0)
    overlap, times = cells.shared(corners, i, j) / least, np.maximum(size[i], size[j]) / least
    keep = (overlap >= share) & (times >= ratio)
    return i[keep], j[keep], overlap[keep], times[keep], size


def overlap_pairs(df: DataFrame, share: float = NESTED_SHARE, ratio: float = NESTED_RATIO) -> DataFrame:
    """Pairs of an image's boxes of which the smaller lies in the larger by a share, and that differ by a ratio.

    One exchange by image; within it, boxes meet in the cells of a grid, so boxes that are apart are no pairs to look at.
    """

    def run(batches):
        for batch in _parts(batches):
            image, columns, v = _flat(batch, _BOX)
            i, j, overlap, times, size = _nested(image, _corners(v), share, ratio)
            sides = [c.take(pa.array(k)) for k in (i, j) for c in columns.values()]
            larger = columns["box_id"].take(pa.array(np.where(size[i] >= size[j], i, j)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(image[i])), *sides, pa.array(overlap), pa.array(times), larger], names=names)

    kind = {c: df.schema[c].dataType.simpleString() for c in ("image_no", *_BOX)}
    each = [(f"{s}_{c}", kind[c]) for s in ("a", "b") for c in _BOX]
    fields = [("image_no", kind["image_no"]), *each, ("overlap", "double"), ("ratio", "double"), ("larger", kind["box_id"])]
    names = [n for n, _ in fields]
    return by_image(df, _BOX).mapInArrow(run, ", ".join(" ".join(f) for f in fields))


def holding_centres(df: DataFrame, least: int = 2) -> DataFrame:
    """Boxes that hold, also on their border, the centres of so many others of their image; one exchange by image."""

    def run(batches):
        for batch in _parts(batches):
            image, columns, v = _flat(batch, _BOX[:5])
            holder, _ = cells.Grid(image, *_corners(v)).holding()
            many = np.bincount(holder, minlength=len(image))
            own = np.flatnonzero(many >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(image[own])), columns["box_id"].take(pa.array(own)), pa.array(many[own])], names=["image_no", "box_id", "centres"])

    kind = {c: df.schema[c].dataType.simpleString() for c in ("image_no", "box_id")}
    return by_image(df, _BOX[:5]).mapInArrow(run, f"image_no {kind['image_no']}, box_id {kind['box_id']}, centres long")


def nearest_within(queries: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """(image_no, line_id, box_id): the nearest point (image_no, box_id, cx, cy) within reach of each query (image_no, line_id, px, py), the smallest number on ties; null without any.

    Points stand in cells as wide as the reach, and a query looks into its own and the eight round it.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asked = queries.withColumn("dx", around).withColumn("dy", around).withColumns({"ix": cell("px") + F.col("dx"), "iy": cell("py") + F.col("dy")})
    put = points.select("image_no", "box_id", "cx", "cy", cell("cx").alias("ix"), cell("cy").alias("iy"))
    far = (F.col("cx") - F.col("px")) * (F.col("cx") - F.col("px")) + (F.col("cy") - F.col("py")) * (F.col("cy") - F.col("py"))
    near = asked.join(put, ["image_no", "ix", "iy"]).withColumn("d2", far).where(F.col("d2") <= reach * reach)
    best = near.groupBy("image_no", "line_id").agg(F.min(F.struct("d2", "box_id")).alias("m")).select("image_no", "line_id", F.col("m.box_id").alias("box_id"))
    return queries.select("image_no", "line_id").join(best, ["image_no", "line_id"], "left")


def _log_gap(value, reference):
    real = (value > 0) & (reference > 0)
    return np.where(real, np.abs(np.log(np.where(real, value, 1.0) / np.where(real, reference, 1.0))), 0.0)


def worse_of(i, j, sizes: dict[str, np.ndarray], middle: dict[str, np.ndarray], sure: np.ndarray) -> np.ndarray:
    """Which of two overlapping boxes goes: a sliver, a fused box, the odder one by size and confidence, the less sure one, the larger one."""
    area = sizes["area"]
    gaps = {c: _log_gap(sizes[c], middle[c]) for c in sizes}
    odd = gaps["area"] + SIDE_WEIGHT * (gaps["long_side"] + gaps["short_side"]) - SURE_WEIGHT * sure
    small, large = np.where(area[i] <= area[j], i, j), np.where(area[i] <= area[j], j, i)
    of = middle["area"][i]
    rules = [
        (np.minimum(area[i], area[j]) < AREA_RATIOS[0] * of, small),
        (np.maximum(area[i], area[j]) > AREA_RATIOS[1] * of, large),
        (np.abs(odd[i] - odd[j]) > CLEAR_GAP, np.where(odd[i] > odd[j], i, j)),
        (np.abs(sure[i] - sure[j]) > CLEAR_GAP, np.where(sure[i] < sure[j], i, j)),
    ]
    return np.select([r[0] for r in rules], [r[1] for r in rules], large)


def _suppressed(image, number, v: dict[str, np.ndarray], of: dict[str, np.ndarray], share: float = NESTED_SHARE, ratio: float = NESTED_RATIO, fused: float = FUSED_RATIO, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes greedy suppression deletes, and which of them for a pair; of has the median sizes of each box's image."""
    corners = _corners(v)
    w, h = corners[2] - corners[0], corners[3] - corners[1]
    sizes = {"area": w * h, "long_side": np.maximum(w, h), "short_side": np.minimum(w, h)}
    i, j, overlap, times, _ = _nested(image, corners, share, ratio)
    worse = worse_of(i, j, sizes, of, np.nan_to_num(v["conf"]))
    gone = np.zeros(len(image), bool)
    for k in np.lexsort((number[j], number[i], -times, -overlap, image[i])):
        if not gone[i[k]] and not gone[j[k]]:
            gone[worse[k]] = True
    nested = gone.copy()
    holder, held = cells.Grid(image, *corners).holding()
    keep = (sizes["area"] >= fused * of["area"])[holder]
    holder, held = holder[keep], held[keep]
    order = np.lexsort((number[holder], -sizes["area"][holder], image[holder]))
    holder, held = holder[order], held[order]
    starts = np.flatnonzero(np.r_[True, holder[1:] != holder[:-1]]) if len(holder) else []
    for k, points in zip(starts, np.split(held, starts[1:]) if len(holder) else [], strict=True):
        if not gone[holder[k]] and np.count_nonzero(~gone[points]) >= least:
            gone[holder[k]] = True
    return gone, nested


def _reasons(nested: np.ndarray) -> pa.Array:
    return pa.array([("overlap_multi_center", "overlap_contained")[x] for x in nested.astype(int)], pa.string())


def suppress_nested(df: DataFrame, share: float = NESTED_SHARE, ratio: float = NESTED_RATIO, fused: float = FUSED_RATIO, least: int = 2, middle: DataFrame | None = None) -> DataFrame:
    """(image_no, box_id, reason) of boxes that greedy suppression deletes; middle has the median sizes of images (image_no, middle), those of df by default.

    Pairs are taken by overlap, then ratio, both falling; the worse box of a
    pair goes unless either has gone already. Then, from the largest down, boxes
    well above the median that still hold the centres of several others go. The
    order within an image decides, so an image is judged in one row. A null
    confidence counts as 0.
    """
    sides = ("area", "long_side", "short_side")
    if middle is None:
        middle = with_sizes(df).groupBy("image_no").agg(F.struct(*[F.median(c).alias(c) for c in sides]).alias("middle"))
    rows = by_image(df, _BOX).join(middle, "image_no")

    def run(batches):
        for batch in _parts(batches):
            image, columns, v = _flat(batch, _BOX)
            of = {c: batch.column(2).field(k).cast(pa.float64()).to_numpy(zero_copy_only=False)[image] for k, c in enumerate(sides)}
            gone, nested = _suppressed(image, columns["box_id"].to_numpy(zero_copy_only=False), v, of, share, ratio, fused, least)
            own = np.flatnonzero(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(image[own])), columns["box_id"].take(pa.array(own)), _reasons(nested[own])], names=["image_no", "box_id", "reason"])

    kind = {c: df.schema[c].dataType.simpleString() for c in ("image_no", "box_id")}
    return rows.select("image_no", "boxes", "middle").mapInArrow(run, f"image_no {kind['image_no']}, box_id {kind['box_id']}, reason string")


def tray_or_edge(df: DataFrame) -> DataFrame:
    """Boxes held against their image's tray, or its edge where there is none.

    Columns image_no, box_id, x1 to y2, conf, width, height and tray (a struct
    x1 to y2, or null). With a tray, padded a little, a box is out if its centre
    isn't in it or too little of it is, and what stays is clipped to it; without
    one, a box next to the edge is out. inside says what stays.
    """
    box, tray = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col("tray")[c] for c in ("x1", "y1", "x2", "y2"))
    side = F.least(F.greatest(tray[2] - tray[0], F.lit(1.0)), F.greatest(tray[3] - tray[1], F.lit(1.0)))
    region = num.padded_box(tray, F.bround(side * TRAY_PADDING), F.col("width"), F.col("height"))
    df = df.withColumn("region", F.when(F.col("tray").isNotNull(), F.struct(*[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), region, strict=True)])))
    df = settled(df)
    at = tuple(F.col("region")[c] for c in ("x1", "y1", "x2", "y2"))
    share = F.coalesce(F.try_divide(num.overlap_area(box, at), num.box_area(*box)), F.lit(0.0))
    centre = ((box[0] + box[2]) / 2).between(at[0], at[2]) & ((box[1] + box[3]) / 2).between(at[1], at[3])
    margin = F.greatest(F.lit(EDGE_LEAST), F.bround(F.least("width", "height") * EDGE_SHARE))
    near = (box[0] <= margin) | (box[1] <= margin) | (box[2] >= F.col("width") - margin) | (box[3] >= F.col("height") - margin)
    some = F.col("region").isNotNull()
    df = df.withColumns({
        "edge_distance": F.least(box[0], box[1], F.col("width") - box[2], F.col("height") - box[3]).cast("long"),
        "tray_share": F.when(some, F.round(share, 4)),
        "outside_tray": F.coalesce(some & (~centre | (share < TRAY_SHARE)), F.lit(False)),
        "near_edge": ~some & near,
    })
    df = settled(df.withColumn("inside", ~F.col("outside_tray") & ~F.col("near_edge")))
    clip = lambda own, other, pick: F.when(F.col("inside") & some, pick(own, other)).otherwise(own)
    clipped = [clip(box[0], at[0], F.greatest), clip(box[1], at[1], F.greatest), clip(box[2], at[2], F.least), clip(box[3], at[3], F.least)]
    changed = F.col("inside") & some & ((clipped[0] != box[0]) | (clipped[1] != box[1]) | (clipped[2] != box[2]) | (clipped[3] != box[3]))
    df = df.withColumn("tray_share", F.when(changed, 1.0).otherwise(F.col("tray_share"))).withColumn("at", F.struct(*[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), clipped, strict=True)]))
    return settled(df.withColumns({c: F.col("at")[c] for c in ("x1", "y1", "x2", "y2")}).drop("region", "at"))


#: How far a row's mean reaches in reading order: a share of the image's median height, and at least so many pixels (fixed values).
READ_SHARE, READ_LEAST = 0.6, 10.0


def filter_detections(df: DataFrame) -> DataFrame:
    """The whole chain over detections: tray or edge, aspect, sizes, overlaps, then numbers of what is kept in reading order.

    Sizes, also those that decide between overlapping boxes, are held against the
    medians before odd sizes go. Each box stays in the result with its reasons.
    """
    flagged = flag_sizes(tray_or_edge(df))
    middles = [f"middle_{c}" for c in ("area", "long_side", "short_side")]
    judged = ("kept", *middles)
    flagged = flagged.withColumn("kept", F.col("kept") & F.col("inside"))
    each = F.collect_list(F.struct(*_BOX, *judged, F.struct(*flagged.columns).alias("own")))
    names = (*_BOX, *judged, "own")

    def run(batches):
        for batch in _parts(batches):
            image, columns, v = _flat(batch, names)
            number = columns["box_id"].to_numpy(zero_copy_only=False)
            on = np.flatnonzero(v["kept"] == 1)
            on = on[np.lexsort((number[on], image[on]))]
            part = {c: x[on] for c, x in v.items()}
            gone, nested = _suppressed(image[on], number[on], part, {c.removeprefix("middle_"): part[c] for c in middles})
            reason, place = np.full(len(image), None, object), np.zeros(len(image), np.int64)
            reason[on[gone]] = _reasons(nested[gone]).to_pylist()
            left = on[~gone]
            place[left] = _places(image[left], tuple(x[left] for x in _corners(v)), number[left], READ_SHARE, READ_LEAST)
            yield pa.RecordBatch.from_arrays([columns["own"], pa.array(reason, pa.string()), pa.array(place, mask=place == 0)], names=["own", "overlap_reason", "final_id"])

    own = flagged.groupBy("image_no").agg(each.alias("boxes"))
    kind = StructType([StructField("own", flagged.schema), StructField("overlap_reason", StringType()), StructField("final_id", LongType())])
    out = own.mapInArrow(run, kind).select("own.*", "overlap_reason", F.col("overlap_reason").isNotNull().alias("suppressed"), "final_id")
    reasons = F.concat(F.array_compact(F.array(F.when(F.col("outside_tray"), "outside_tray"), F.when(F.col("near_edge"), "near_image_edge"))), F.col("reasons"), F.array_compact(F.array("overlap_reason")))
    return out.withColumns({"reasons": reasons, "kept": F.col("kept") & ~F.col("suppressed")})


def _places(image, corners: tuple, number: np.ndarray, share: float, least: float) -> np.ndarray:
    """Each box's place in its image as one reads; boxes come by image.

    A row that a box is too far below is never joined again, since its mean
    stays and boxes only come lower; so a box meets the last row alone, and rows
    are ordered as they begin. What is missing comes first.
    """
    cx, cy, h = (corners[0] + corners[2]) / 2, (corners[1] + corners[3]) / 2, corners[3] - corners[1]
    order = np.lexsort((number, cx, ~np.isnan(cx), cy, ~np.isnan(cy), image))
    reach = _medians(image, h) * share
    reach = np.where(np.isnan(reach), least, np.maximum(reach, least))
    row, now, total, n, at = np.zeros(len(image), np.int64), -1, 0.0, 0, -1
    for k, i, y, far in zip(order.tolist(), image[order].tolist(), cy[order].tolist(), reach[image[order]].tolist(), strict=True):
        if i == now and abs(total / n - y) <= far:
            total, n = total + y, n + 1
        else:
            now, total, n, at = i, y, 1, at + 1
        row[k] = at
    order = np.lexsort((number, cx, ~np.isnan(cx), row, image))
    place = np.empty(len(image), np.int64)
    place[order] = np.arange(len(image)) - np.searchsorted(image, image) + 1
    return place


def _medians(image: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each image's median, without what is missing; not a number where nothing is left."""
    n = int(image.max(initial=-1)) + 1
    there = np.flatnonzero(~np.isnan(value))
    there = there[np.lexsort((value[there], image[there]))]
    ends = np.searchsorted(image[there], np.arange(n + 1))
    some = np.flatnonzero(np.diff(ends))
    low, high = (ends[some] + ends[some + 1] - 1) // 2, (ends[some] + ends[some + 1]) // 2
    out = np.full(n, np.nan)
    out[some] = 0.5 * value[there[low]] + 0.5 * value[there[high]]
    return out


def reading_order(df: DataFrame, share: float = READ_SHARE, least: float = READ_LEAST) -> DataFrame:
    """Row and place of each box as one reads.

    Boxes come by (y, x) of their centre; one joins the first row whose running
    mean of y is within reach of it, else it starts a row. Rows are ordered by
    their mean, boxes in them by x.
    """

    def run(batches):
        for batch in _parts(batches):
            image, columns, v = _flat(batch, _BOX[:5])
            place = _places(image, _corners(v), columns["box_id"].to_numpy(zero_copy_only=False), share, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(image)), columns["box_id"], pa.array(place)], names=["image_no", "box_id", "place"])

    kind = {c: df.schema[c].dataType.simpleString() for c in ("image_no", "box_id")}
    return by_image(df, _BOX[:5]).mapInArrow(run, f"image_no {kind['image_no']}, box_id {kind['box_id']}, place long")


def _covered(corners: tuple, conf: np.ndarray, share: float) -> np.ndarray:
    """Which boxes of one image go, in their order; a box meets those after it that are still there, so no list of pairs is held."""
    size, gone = np.maximum(cells.area(*corners), 1.0), np.zeros(len(conf), bool)
    rest = np.arange(len(conf))
    while len(rest) > 1:
        i, rest = rest[0], rest[1:]
        met = rest[cells.shared(corners, i, rest) / np.minimum(size[i], size[rest]) > share]
        if not len(met):
            continue
        # The first one that is surer ends the box's turn.
        surer = np.flatnonzero(~(conf[i] >= conf[met]))
        gone[i] = len(surer) > 0
        gone[met[: surer[0]] if len(surer) else met] = True
        rest = rest[~gone[rest]]
    return gone


def unique_digits(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Digits of each image left to right, without those that another covers; what is no digit can cover one, but isn't read.

    Pairs are taken in the order of the detections (box_id); of two that share
    more than a part of the smaller one's area the less sure one goes, the later
    one on ties, unless either has gone already.
    """
    names = (*_BOX, "digit")

    def run(batches):
        for batch in _parts(batches):
            image, columns, v = _flat(batch, names)
            corners = _corners(v)
            ends = np.searchsorted(image, np.arange(len(batch) + 1))
            gone = np.concatenate([np.zeros(0, bool), *(_covered(tuple(c[a:b] for c in corners), v["conf"][a:b], share) for a, b in zip(ends[:-1], ends[1:], strict=True))])
            texts = [[] for _ in range(len(batch))]
            digits = columns["digit"].to_pylist()
            for k in np.lexsort((np.arange(len(image)), corners[0], image)):
                if not gone[k] and re.fullmatch("[0-9]+", digits[k] or ""):
                    texts[image[k]].append(digits[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(t) for t in texts], pa.string())], names=["image_no", "digits"])

    return by_image(df, names).mapInArrow(run, f"image_no {df.schema['image_no'].dataType.simpleString()}, digits string")


def merge_axes(df: DataFrame, gap: float = 10.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Axis candidates (key, candidate, source, angle, length) without those next to a longer one's angle, by candidate; each with how many different sources it stands for.

    Of equal lengths the smaller candidate comes first. A source that is null or
    empty isn't counted, but each kept candidate counts for one at least. Columns
    to carry come along from the kept candidate's row.
    """
    own = df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("rank"), "candidate", "angle", "source", *carry))).alias("all"))
    kind = "array<struct<candidate:bigint,angle:double,length:double,sources:array<string>>>"
    named = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(x))

    def step(kept, c):
        near = F.array_position(F.transform(kept, lambda k: num.undirected_gap(k["angle"], c["angle"]) < gap), F.lit(True)).cast("int")
        grown = F.transform(kept, lambda k, i: F.struct(k["candidate"].alias("candidate"), k["angle"].alias("angle"), k["length"].alias("length"), F.when(i == near - 1, F.array_union(k["sources"], named(c["source"]))).otherwise(k["sources"]).alias("sources")))
        begun = F.struct(c["candidate"].alias("candidate"), c["angle"].alias("angle"), (-c["rank"]).alias("length"), named(c["source"]).alias("sources"))
        return F.when(near > 0, grown.cast(kind)).otherwise(F.concat(kept, F.array(begun).cast(kind)))

    kept = own.select("key", "all", F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("k"))
    row = F.get(F.filter("all", lambda x: x["candidate"] == F.col("k.candidate")), F.lit(0))
    return kept.select("key", "k.candidate", "k.angle", "k.length", F.greatest(F.size("k.sources"), F.lit(1)).cast("long").alias("merged"), *[row[c].alias(c) for c in carry])


#: Weights of an axis candidate's penalties (fixed values); the length a candidate must have at least, in pixels and as a share of the reference.
PENALTIES = {"area": 0.25, "width": 0.30, "color": 0.25, "length": 0.10, "endpoint": 0.10}
LENGTH_LEAST, LENGTH_SHARE, LENGTH_PERCENTILE = 3.0, 0.72, 0.9
#: When a choice of axis isn't sure: margin to the second, a component's penalty, and a component whose own winner is so much better and so far off (fixed values).
SURE_MARGIN, HIGH_PENALTY, CONFLICT_GAP, CONFLICT_ANGLE = 0.035, 0.70, 0.12, 25.0


def score_axes(df: DataFrame) -> DataFrame:
    """Axis candidates (key, candidate, angle, length and penalties area, width, color, endpoint) with their length penalty, total score and rank.

    The reference length is the 90th percentile of the key's positive lengths;
    candidates under a pixel are left out. The best has the smallest score, the
    longer one on ties, then the smaller candidate; it alone has a margin to the
    second.
    """
    middle = df.where("length > 0").groupBy("key").agg(F.percentile("length", F.lit(LENGTH_PERCENTILE)).alias("reference"))
    df = df.where("length >= 1").join(middle, "key", "left").withColumn("reference", F.coalesce("reference", F.lit(1.0)))
    low = F.greatest(F.lit(LENGTH_LEAST), F.col("reference") * LENGTH_SHARE)
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("reference") - F.col("length")) / F.greatest(F.col("reference") - low, F.lit(1e-6))))
    df = df.withColumn("length_penalty", F.when(F.col("length") >= F.col("reference"), 0.0).when(F.col("length") >= low, within).otherwise(1.0))
    parts = {"area": "area", "width": "width", "color": "color", "length": "length_penalty", "endpoint": "endpoint"}
    total = sum((PENALTIES[k] * F.col(c) for k, c in parts.items()), F.lit(0.0)) / sum(PENALTIES.values())
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    w = Window.partitionBy("key").orderBy("score", F.desc("length"), "candidate")
    df = df.withColumns({"rank": F.row_number().over(w).cast("long"), "margin": F.lead("score").over(w) - F.col("score")})
    return df.withColumn("margin", F.when(F.col("rank") == 1, F.col("margin")))


def choose_axis(scored: DataFrame) -> DataFrame:
    """Each key's best candidate and why it isn't sure, if so: a small margin, a high penalty, or a component whose own best one is clearly better and points elsewhere."""
    parts = ["area", "width", "color"]
    first = lambda c: F.min(F.struct(F.col(c).alias("v"), F.col("rank").alias("r"), F.col("angle").alias("angle"))).alias(f"best_{c}")
    best = scored.groupBy("key").agg(F.min_by(F.struct("candidate", "angle", "score", "margin", *parts, "endpoint"), "rank").alias("b"), *map(first, parts))
    reasons = [F.when(F.col("b.margin") <= SURE_MARGIN, F.lit(f"top2_margin<={SURE_MARGIN:.3f}"))]
    reasons += [F.when(F.col(f"b.{c}") >= HIGH_PENALTY, F.lit(f"{n}>={HIGH_PENALTY:.2f}")) for c, n in (("area", "area_balance_penalty"), ("width", "width_symmetry_penalty"), ("color", "color_symmetry_penalty"), ("endpoint", "endpoint_penalty"))]
    clash = lambda c: (F.col(f"b.{c}") - F.col(f"best_{c}.v") >= CONFLICT_GAP) & (num.undirected_gap(F.col("b.angle"), F.col(f"best_{c}.angle")) >= CONFLICT_ANGLE)
    reasons += [F.when(clash(c), F.lit(f"{n}_winner_conflicts")) for c, n in (("area", "area_balance_penalty"), ("width", "width_symmetry_penalty"), ("color", "color_symmetry_penalty"))]
    text = F.array_join(F.array_compact(F.array(*reasons)), "|")
    return best.select("key", "b.candidate", "b.angle", "b.score", text.alias("reasons"), (text != "").alias("unsure"))


#: Gates and weights of tray candidates (fixed values): shares of the image, greatest aspect, least fill.
TRAY_AREA, TRAY_ASPECT, TRAY_FILL = (0.03, 0.45), 1.45, 0.45


def choose_tray(df: DataFrame) -> DataFrame:
    """Each image's best tray candidate (image_no, candidate, contour_area, cx, cy, rect_w, rect_h, width, height), with its sides.

    Gates: share of the image, sides of a pixel at least, aspect, and how much
    of its rectangle it fills. The score rewards size, a place in the middle
    (a little below the centre), fill and squareness; the first wins ties.
    """
    share = F.col("contour_area") / (F.col("width") * F.col("height"))
    long, short = F.greatest("rect_w", "rect_h"), F.least("rect_w", "rect_h")
    aspect, fill = long / F.greatest(short, F.lit(1e-6)), F.col("contour_area") / F.greatest(F.col("rect_w") * F.col("rect_h"), F.lit(1.0))
    off = lambda v, at, reach: F.greatest(F.lit(-1.0), 1 - F.abs(v - at) / F.greatest(reach, F.lit(1.0)))
    score = 120 * share + 2.4 * off(F.col("cx"), F.col("width") / 2, F.col("width") / 2) + 1.8 * off(F.col("cy"), F.col("height") * 0.52, F.col("height") * 0.35) + 1.6 * fill + 1.3 * (1 - F.least(F.lit(1.0), F.abs(aspect - 1) / (TRAY_ASPECT - 1)))
    good = (F.col("contour_area") > 0) & share.between(*TRAY_AREA) & (F.col("rect_w") >= 1) & (F.col("rect_h") >= 1) & (aspect <= TRAY_ASPECT) & (fill >= TRAY_FILL)
    rows = df.where(good).withColumns({"score": score, "long_side": long, "short_side": short})
    best = rows.groupBy("image_no").agg(F.min(F.struct((-F.col("score")).alias("rank"), "candidate", "score", "long_side", "short_side")).alias("b"))
    return best.select("image_no", "b.candidate", "b.score", "b.long_side", "b.short_side")
