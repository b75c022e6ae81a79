"""Joins of objects with image and group metadata, and group-level traits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "UNKNOWN"


def one_per_key(df: DataFrame, key: str | list[str], order: Column | list[Column]) -> DataFrame:
    """The first row of each key in an order; ties are settled by the order given, so give a total one."""
    keys = [key] if isinstance(key, str) else key
    order = order if isinstance(order, list) else [order]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    return one_per_key(df, key, F.col(seq).desc())


def with_metadata(kernels: DataFrame, images: DataFrame) -> DataFrame:
    """Objects with their image's group and weight; of repeated metadata the last row wins, missing ones are UNKNOWN."""
    meta = last_per_key(images, "image_name", "seq").select("image_name", "plant_name", "weight_text")
    out = kernels.join(meta, "image_name", "left")
    return out.withColumns({"plant_name": F.coalesce("plant_name", F.lit(UNKNOWN)), "weight_text": F.coalesce("weight_text", F.lit(UNKNOWN))})


def group_weights(images: DataFrame) -> DataFrame:
    """Weight of each group; its first row that isn't blank wins."""
    own = images.where(F.trim(F.coalesce("weight_text", F.lit(""))) != "")
    return one_per_key(own, "plant_name", [F.col("image_no"), F.col("seq")]).select("plant_name", "weight_text")


def group_traits(kernels: DataFrame, values: list[str]) -> DataFrame:
    """Count, medians and image list of each group."""
    images = F.concat_ws(";", F.array_sort(F.collect_set("image_name")))
    return kernels.groupBy("plant_name").agg(F.count("*").alias("n_kernels"), *[F.median(v).alias(f"median_{v}") for v in values], images.alias("source_images"))


def weight_each(weight_text: Column, n: Column) -> Column:
    """Weight over count to 4 places; null when the text is no number or nothing was counted."""
    return F.round(F.try_divide(weight_text.try_cast("double"), F.when(n > 0, n)), 4)


def filled_scale(kernels: DataFrame) -> DataFrame:
    """Objects with the median scale of their group where their own is missing; objects without a group keep what they have."""
    middle = kernels.where(F.col("plant_name").isNotNull()).groupBy("plant_name").agg(F.median("scale").alias("__middle"))
    return kernels.join(middle, "plant_name", "left").withColumn("scale_filled", F.coalesce("scale", "__middle")).drop("__middle")


def median_if_complete(value: str) -> Column:
    """The group's median, only if no member lacks the value."""
    return F.when(F.count(value) == F.count("*"), F.median(value))


def blank_round(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Status and reason of round objects, and null in the columns that mean nothing for them."""
    is_round = F.col("circularity") > least
    out = df.withColumns({"status": F.when(is_round, "round").when(F.col("confidence") < 0.5, "uncertain").otherwise("ok"), "reason": F.when(is_round, "circularity").when(F.col("confidence") < 0.5, "confidence")})
    return out.withColumns({c: F.when(~is_round, F.col(c)) for c in columns})


#: The columns of a measurement table in their order.
MEASUREMENT_COLUMNS = """kernel_name mm_per_px tray_side_px tray_size_mm length_width_ratio eccentricity length_px length_mm max_width_px max_width_mm width_25pct_px width_25pct_mm
    width_50pct_px width_50pct_mm width_75pct_px width_75pct_mm area_px2 area_mm2 perimeter_px perimeter_mm circularity""".split()


def measurement_record(df: DataFrame, round_over: float = 0.9) -> DataFrame:
    """Measurements (names of geometry.bundle, mm_per_px) as rounded columns in pixels and millimetres.

    A round object's sizes are null; without a scale all millimetres are. Objects
    whose axis is under a pixel are left out.
    """
    scale, sized = F.col("mm_per_px"), ~(F.col("circularity") > round_over)
    out = {"mm_per_px": F.round(scale, 6), "length_width_ratio": F.round("length_width_ratio", 4), "eccentricity": F.round("eccentricity", 4), "is_round": ~sized}
    for name, c in (("length", "axis_length"), ("max_width", "max_width"), ("width_25pct", "width_25pct"), ("width_50pct", "width_50pct"), ("width_75pct", "width_75pct"), ("perimeter", "perimeter")):
        out |= {f"{name}_px": F.when(sized, F.round(c, 2)), f"{name}_mm": F.when(sized, F.round(F.col(c) * scale, 4))}
    out |= {"area_px2": F.when(sized, F.round("area", 2)), "area_mm2": F.when(sized, F.round(F.col("area") * scale * scale, 4)), "circularity": F.round("circularity", 4)}
    return df.where("axis_length >= 1").withColumns(out)


def pick(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def without(df: DataFrame, names: list[str] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names and not (prefixes and c.startswith(tuple(prefixes)))])


def containing(df: DataFrame, text: str) -> DataFrame:
    """Rows whose first column has the text in any case; blank text passes all."""
    needle = text.strip().lower()
    return df.where(F.contains(F.lower(F.col(df.columns[0]).cast("string")), F.lit(needle))) if needle else df


def without_deleted(labels: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Labels whose key is still present; if nothing is present at all, every label stays."""
    some = present.select(F.count("*").alias("__some"))
    rows = labels.crossJoin(F.broadcast(some))  # one row
    kept = rows.where("__some > 0").join(present.select(key).distinct(), key, "left_semi")
    return kept.unionByName(rows.where("__some = 0")).drop("__some")


def match_profile(images: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each image with the profile of its group, else the first by order whose name is part of the image's stem or the other way round.

    What one text has of another begins with its first three letters, or is
    shorter than that, so the two meet on those and on all parts of one to three
    letters; each pair that meets is then looked at whole. Nothing is broadcast.
    """
    known = images.join(profiles.select(F.col("name").alias("profile"), "ord"), F.col("plant_name") == F.col("profile"), "left")
    exact = known.where(F.col("profile").isNotNull()).select("image_name", "profile")
    rest, own = known.where(F.col("profile").isNull()).select("image_name", "stem"), profiles.select("name", "ord")
    parts = lambda c, k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    whole = lambda df, c: df.withColumn("__part", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[parts(F.col(c), k) for k in (1, 2, 3)]))))
    begun = lambda df, c: df.withColumn("__part", F.substring(c, 1, 3))
    near = whole(rest, "stem").join(begun(own, "name"), "__part").where(F.contains("stem", "name")).select("image_name", "name", "ord")
    near = near.unionByName(begun(rest, "stem").join(whole(own, "name"), "__part").where(F.contains("name", "stem")).select("image_name", "name", "ord"))
    fuzzy = near.groupBy("image_name").agg(F.min_by("name", "ord").alias("profile"))
    return images.select("image_name").distinct().join(exact.unionByName(fuzzy), "image_name", "left")


def upsert_in_order(current: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows in the order of a list of keys, rows whose key isn't listed behind them by key.

    The order is that of one label file, a row per image of a folder, so one task numbers it.
    """
    listed = order.join(current, key, "left_semi").select(key, "ord")
    return current.join(listed, key, "left").withColumn("place", F.row_number().over(Window.orderBy(F.col("ord").asc_nulls_last(), key))).drop("ord")


def delete_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the keys that were deleted; the caller writes it to a staged path."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def rename_group(df: DataFrame, old: str, new: str, column: str = "plant_name") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def first_source(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of primary, priority 1.0, and of fallback, priority 0.25, for keys that primary has no row of."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("priority", F.lit(1.0)).unionByName(rest.withColumn("priority", F.lit(0.25)))


#: What a label looks like (a fixed pattern): three parts of capitals and digits at least, with hyphens between. Parts end where they must, so nothing is given back, and a label of thousands of parts needs no stack.
LABEL = "[A-Z0-9]++(?:-[A-Z0-9]++){2,}+"


def read_labels(texts: DataFrame) -> DataFrame:
    """Each image's label (image_no, label, score) from its text lines (image_no, line, text, conf, y, x; text normalised).

    The line of best score wins. Without a valid line the lines are joined in
    reading order (mean y, then least x) and searched for a label; its score is
    the confidence of the first line that is part of it or the other way round,
    null if none is. Images without either are left out.
    """
    from ..functions import text as tx

    scored = texts.withColumn("score", tx.label_score(F.col("text"), F.col("conf")))
    line = F.struct("y", "x", "line", "text", "conf")
    own = scored.groupBy("image_no").agg(F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("rank"), "line", F.col("text").alias("label"), "score"))).alias("best"), F.array_sort(F.collect_list(line)).alias("lines"))
    own = own.withColumn("target", F.nullif(F.regexp_extract(F.array_join(F.transform("lines", lambda p: p["text"]), ""), f"({LABEL})", 1), F.lit("")))
    # A filter would hold every line against a target that grows with their number; the first that fits ends the search.
    kind = own.schema["lines"].dataType.elementType
    fits = lambda p: F.contains(F.col("target"), p["text"]) | F.contains(p["text"], F.col("target"))
    part = F.aggregate("lines", F.lit(None).cast(kind), lambda s, p: F.when(s.isNotNull(), s).when(fits(p), p))
    own = own.withColumn("from", F.when(F.col("best").isNull(), part))
    return own.select("image_no", F.coalesce("best.label", "target").alias("label"), F.when(F.col("best").isNotNull(), F.col("best.score")).otherwise(F.round(F.col("from.conf") * 100, 3)).alias("score")).where("label is not null")


def next_unlabelled(items: DataFrame, labelled: DataFrame, key: str, list_: str, place: str) -> DataFrame:
    """For each item of each list the next one without a label, round the end to the start; null if every item has one."""
    open_ = items.join(labelled.select(key).distinct().withColumn("__done", F.lit(True)), key, "left").withColumn("__free", F.when(F.col("__done").isNull(), F.struct(place, key)))
    after = Window.partitionBy(list_).orderBy(place).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(list_)
    return open_.withColumn("next", F.coalesce(F.min("__free").over(after), F.min("__free").over(whole))[key]).select(list_, place, key, "next")


def display_text(value: Column, digits: int) -> Column:
    """A number with so many places, halves to even, a missing one as an empty text."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.bround(value, digits))).otherwise("")


def valid_point(x: Column, y: Column, fallback: tuple[Column, Column] | None = None) -> Column:
    """The point if both numbers are finite, else the fallback if that one is, else the origin."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    point = lambda a, b: F.when(fine(a) & fine(b), F.struct(a.alias("x"), b.alias("y")))
    other = [point(*fallback)] if fallback else []
    return F.coalesce(point(x, y), *other, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def checked_scale(measured: Column, fixed: Column, most: float = 0.03) -> Column:
    """(scale, source, warning): the measured scale, with a warning if it is off the fixed one by more than a share; the fixed one where nothing was measured; null without either."""
    off = F.abs(measured - fixed) / F.greatest(fixed, F.lit(1e-6))
    found = F.struct(measured.alias("scale"), F.lit("detected").alias("source"), F.when(off > most, "deviation").alias("warning"))
    return F.when(measured.isNotNull(), found).when(fixed.isNotNull(), F.struct(fixed.alias("scale"), F.lit("fixed").alias("source"), F.lit("not detected").alias("warning")))


#: Where weight displays are searched: regions with their priority, and their sides as shares (fixed values).
CENTER_BOX, TRAY_BOTTOM, TRAY_BAND = (0.22, 0.62, 0.78, 1.0), (0.08, 0.06, 0.42), (0.18, 0.02, 0.30)
REGIONS = [("bottom_split_scan", 0.45), ("bottom_center_scan", 1.0), ("tray_bottom_scan", 1.2), ("tray_weight_screen_band", 1.35)]
SCREEN_PRIORITY, SCREEN_PADDING = 1.5, 0.05


def search_regions(images: DataFrame, split: float = 0.5) -> DataFrame:
    """Regions in which each image's weight is searched: image_no, source, priority, box.

    images: image_no, width, height, and structs screen and tray (x1 to y2, or
    null). A detected screen, grown a little, is the only region; otherwise the
    lower part, its middle, and with a tray the parts under it; of equal boxes
    the first stays.
    """
    from ..functions import numeric as num

    w, h = F.col("width"), F.col("height")
    at = F.greatest(F.lit(1), F.least(h - 1, F.bround(h * split)))
    as_box = lambda b: F.array(*[v.cast("long") for v in b])
    t, s = ({k: F.col(c)[k] for k in ("x1", "y1", "x2", "y2")} for c in ("tray", "screen"))
    tw, th = F.greatest(F.lit(1.0), t["x2"] - t["x1"]), F.greatest(F.lit(1.0), t["y2"] - t["y1"])
    under = lambda side, up, down, sign: num.clamp_box((t["x1"] + sign * side * tw, F.greatest(at, t["y2"] - up * th), t["x2"] - sign * side * tw, F.least(h, t["y2"] + down * th)), w, h)
    parts = [(F.lit(0), at, w, h), num.clamp_box((w * CENTER_BOX[0], F.greatest(at, h * CENTER_BOX[1]), w * CENTER_BOX[2], h * CENTER_BOX[3]), w, h), under(*TRAY_BOTTOM, -1), under(*TRAY_BAND, 1)]
    each = [F.struct(F.lit(n).alias("source"), F.lit(p).alias("priority"), as_box(b).alias("box")) for (n, p), b in zip(REGIONS, parts, strict=True)]
    searched = F.when(F.col("tray").isNotNull(), F.array(*each)).otherwise(F.array(*each[:2]))
    new = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: y["box"] == x["box"]))
    px, py = F.bround(SCREEN_PADDING * (s["x2"] - s["x1"])), F.bround(SCREEN_PADDING * (s["y2"] - s["y1"]))
    screen = F.array(F.struct(F.lit("yolo_weight_screen").alias("source"), F.lit(SCREEN_PRIORITY).alias("priority"), as_box(num.clamp_box((s["x1"] - px, s["y1"] - py, s["x2"] + px, s["y2"] + py), w, h)).alias("box")))
    return images.select("image_no", F.explode(F.when(F.col("screen").isNotNull(), screen).otherwise(new(searched))).alias("r")).select("image_no", "r.*")
