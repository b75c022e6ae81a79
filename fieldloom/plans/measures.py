"""Named queries over outlines, axes, detections, labels and latents, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import numeric as num
from ..functions import runs as rle
from ..functions import text as tx
from ..operators import axes, boxes, components_analysis, stats, traits
from . import fixtures as fx
from .queries import GREEDY, MERGED, READ, _latent, _norm, places, query, r, rounded, upright

_MOMENTS = """a as (select vec_id, sum(px * qy - qx * py) / 2 as a, sum((px + qx) * (px * qy - qx * py)) as sx, sum((py + qy) * (px * qy - qx * py)) as sy, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) as p from edge group by 1), c as (select vec_id, a, p, sx / (6 * a) as cx, sy / (6 * a) as cy from a),
    e as (select c.vec_id, a, px - cx as px, py - cy as py, qx - cx as qx, qy - cy as qy from edge join c using (vec_id)),
    m as (select vec_id, sum((px * px + px * qx + qx * qx) * (px * qy - qx * py)) / 12 / any_value(a) as xx, sum((py * py + py * qy + qy * qy) * (px * qy - qx * py)) / 12 / any_value(a) as yy, sum((px * qy + 2 * px * py + 2 * qx * qy + qx * py) * (px * qy - qx * py)) / 24 / any_value(a) as xy from e group by 1),
    g as (select c.vec_id, abs(a) as area, p as perimeter, cx, cy, greatest((xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 0) / ((xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)) as ratio2 from m join c using (vec_id))"""
_BUNDLE = f"""{_MOMENTS}, {upright("scan", "select k, k / 99.0::double as fr from range(100) t(k)")}, {upright("part", "select k, 1 - k / 4.0::double as fr from range(1, 4) t(k)")},
    wide as (select vec_id, max(width) as max_width from scan group by 1), w as (select vec_id, max(width) filter (k = 1) as w25, max(width) filter (k = 2) as w50, max(width) filter (k = 3) as w75 from part group by 1),
    b as (select vec_id, 240.0::double as len, w25, w50, w75, max_width, area, perimeter, 4 * pi() * area / (perimeter * perimeter) as circularity, sqrt(1 - ratio2) as eccentricity, case when w50 > 1e-6 then 240 / w50 end as lw from g join wide using (vec_id) join w using (vec_id))"""


def _bundle(spark, d):
    at = lambda y: F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"))
    c = fx.contour(spark, d).withColumns({"bottom": at(-120.0), "top": at(120.0)})
    return axes.bundles(c, "c", "bottom", "top").select("vec_id", "m")


@query(f""", {_BUNDLE} select vec_id, {r("len")} as axis_length, {r("w25", 4)} as width_25pct, {r("w50", 4)} as width_50pct, {r("w75", 4)} as width_75pct, {r("max_width", 4)} as max_width, {r("area", 4)} as area, {r("perimeter", 4)} as perimeter, {r("circularity")} as circularity, {r("eccentricity", 4)} as eccentricity, {r("lw", 4)} as length_width_ratio from b""", "contour")
def measurement_bundle(spark, d):
    """Everything that is measured on an outline with an axis."""
    b = _bundle(spark, d)
    digits = {"axis_length": 6, "width_25pct": 4, "width_50pct": 4, "width_75pct": 4, "max_width": 4, "area": 4, "perimeter": 4, "circularity": 6, "eccentricity": 4, "length_width_ratio": 4}
    return b.select("vec_id", *[(F.round(F.col("m")[c], n) + F.lit(0.0)).alias(c) for c, n in digits.items()])


_SCALE = "case when vec_id % 7 <> 0 then 0.05::double + (vec_id % 10) / 1000.0::double end"
_KERNELS = f"""{_BUNDLE}, k as (select *, 'IMG_' || vec_id || '_kernel_001.jpg' as kernel_name, {_SCALE} as mm, circularity > 0.3 as rnd from b)"""


def _px(value: str, digits: int = 2) -> str:
    return r(f"case when not rnd then {value} end", digits)


@query(
    f""", {_KERNELS} select kernel_name, {r("round(mm, 6)")} as mm_per_px, {r("100 / mm", 3)} as tray_side_px, case when mm is not null then 100.0::double end as tray_size_mm, {r("lw", 4)} as length_width_ratio, {r("eccentricity", 4)} as eccentricity,
    {", ".join(f"{_px(v)} as {n}_px, {_px(f'{v} * mm', 4)} as {n}_mm" for n, v in (("length", "len"), ("max_width", "max_width"), ("width_25pct", "w25"), ("width_50pct", "w50"), ("width_75pct", "w75")))},
    {_px("area")} as area_px2, {_px("area * mm * mm", 4)} as area_mm2, {_px("perimeter")} as perimeter_px, {_px("perimeter * mm", 4)} as perimeter_mm, {r("circularity", 4)} as circularity from k""",
    "contour",
)
def kernel_measurements(spark, d):
    """The 21 columns of a measurement table; round objects keep ratio, eccentricity and circularity and lose their sizes."""
    k = F.col("vec_id")
    scale = F.when(k % 7 != 0, F.lit(0.05) + (k % 10) / 1000.0)
    b = _bundle(spark, d).select(F.concat(F.lit("IMG_"), k.cast("string"), F.lit("_kernel_001.jpg")).alias("kernel_name"), scale.alias("mm_per_px"), F.when(scale.isNotNull(), F.round(100 / scale, 3)).alias("tray_side_px"), F.when(scale.isNotNull(), 100.0).alias("tray_size_mm"), "m.*")
    out = traits.pick(traits.measurement_record(b, round_over=0.3), traits.MEASUREMENT_COLUMNS)
    return out.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f""", {upright("part", "select k, case k when 0 then 0.12::double when 1 then 0.5::double else 0.75::double end as fr from range(3) t(k)")}, w as (select vec_id, max(width) filter (k = 0) as near, max(width) filter (k = 1) as mid, max(width) filter (k = 2) as upper from part group by 1)
    select vec_id, {r("near", 4)} as near, {r("mid", 4)} as mid, {r("upper", 4)} as upper, {r("0.45 * case when mid > 1e-6 then 1 - least(2, near / mid) else 0 end + 0.55 * case when upper > 1e-6 then 1 - least(2, near / upper) else 0 end", 5)} as taper,
    case when near <= mid and mid <= upper then 1.0::double when near <= mid or near <= upper then 0.5::double else 0.0::double end as rising from w""", "contour")  # fmt: skip
def support_widths(spark, d):
    """R5, and the taper part of P17 and P22."""
    at = lambda y: F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"))
    c = fx.contour(spark, d).select("vec_id", geo.support_widths(F.col("c"), at(-120.0), at(120.0)).alias("w"))
    c = c.withColumn("t", geo.taper_score(F.col("w")))
    return c.select("vec_id", *[(F.round(F.col("w")[n], 4) + F.lit(0.0)).alias(n) for n in ("near", "mid", "upper")], (F.round("t.taper", 5) + F.lit(0.0)).alias("taper"), "t.rising")


@query(
    f""", s as (select vec_id, var_samp(x) as xx, var_samp(y) as yy, covar_samp(x, y) as xy from point group by 1), h as (select *, (xx + yy) / 2 as h, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) as q from s)
    select vec_id, {r("fmod(degrees(0.5 * atan2(2 * xy, xx - yy)) + 180, 180::double)", 3)} as angle, {r("sqrt(greatest(h - q, 0) / (h + q))", 5)} as ratio from h""",
    "contour",
)
def point_spread(spark, d):
    """Principal axis of the outline's points."""
    c = fx.contour(spark, d).select("vec_id", geo.point_spread(F.col("c")).alias("p"))
    return c.select("vec_id", F.round("p.angle", 3).alias("angle"), F.round("p.ratio", 5).alias("ratio"))


_CENTRE = "ctr as (select vec_id, sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) as cx, sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) as cy from edge group by 1)"


def chords(name: str, angles: str) -> str:
    """(vec_id, a, m, cx, cy): merged places along the line through the centroid at angles (rows vec_id, a in degrees), in SQL."""
    return f"""{name}_l as (select g.vec_id, g.a, cx, cy, cos(radians(g.a)) as ux, sin(radians(g.a)) as uy from ({angles}) g join ctr using (vec_id)),
    {name}_h as (select l.vec_id, l.a, (px - cx) * uy - (py - cy) * ux as s, (qx - cx) * uy - (qy - cy) * ux as t, (px - cx) * ux + (py - cy) * uy as u, (qx - cx) * ux + (qy - cy) * uy as v from edge e join {name}_l l using (vec_id)),
    {name}_x as (select vec_id, a, {MERGED} as m from (select vec_id, a, u + (v - u) * s / (s - t) as hit from {name}_h where (s >= 0) <> (t >= 0)) group by 1, 2), {name} as (select l.*, m from {name}_l l left join {name}_x x on x.vec_id = l.vec_id and x.a = l.a)"""


def _centred(spark, d):
    return fx.contour(spark, d).withColumn("at", geo.centroid(F.col("c")))


@query(
    f""", {_CENTRE}, {chords("ch", "select vec_id, a::double as a from (select distinct vec_id from edge), range(180) t(a)")}, n as (select vec_id, a, m[len(m)] - m[1] as len from ch where len(m) >= 2 and m[len(m)] - m[1] >= 1)
    select vec_id, {r("round(max(len), 4)", 4)} as longest, {r("round(min(len), 4)", 4)} as shortest, count(*) as chords from n group by 1""",
    "contour",
)
def axis_scan(spark, d):
    """P20: chords through the centroid at every degree."""
    c = fx.contour(spark, d).select("vec_id", axes.centroid_chords("c").alias("s"))
    lengths = F.transform("s", lambda x: x["length"])
    return c.select("vec_id", F.round(F.array_max(lengths), 4).alias("longest"), F.round(F.array_min(lengths), 4).alias("shortest"), F.size("s").cast("long").alias("chords"))


@query(
    f""", {_CENTRE}, {chords("ch", "select vec_id, (vec_id * 37) % 360 + 0.5::double as a from (select distinct vec_id from edge)")}
    select vec_id, {r("cx + m[len(m)] * ux", 3)} as bottom_x, {r("cy + m[len(m)] * uy", 3)} as bottom_y, {r("cx + m[1] * ux", 3)} as top_x, {r("cy + m[1] * uy", 3)} as top_y from ch where len(m) >= 2""",
    "contour",
)
def model_axis(spark, d):
    """The ends of a directed axis through the centroid."""
    c = _centred(spark, d).select("vec_id", geo.model_axis(F.col("c"), F.col("at"), (F.col("vec_id") * 37) % 360 + F.lit(0.5)).alias("x"))
    return c.select("vec_id", *[(F.round(F.col("x")[e][k], 3) + F.lit(0.0)).alias(f"{e}_{k}") for e in ("bottom", "top") for k in ("x", "y")])


def _dealt(spark, c):
    """Outlines come in few files; they are dealt out, as the search costs more than the exchange. Without a number of parts Spark would put small ones together again."""
    return c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")


@query()
def method_axes(spark, d):
    """Base angles, their axes with the bottom chosen, merged; tests hold it against loops."""
    out = axes.method_axes(_dealt(spark, fx.contour(spark, d)), "vec_id", "c", 64)
    return rounded(out.select("vec_id", "candidate", "source", "angle", "length", "merged", F.col("bottom.x").alias("bottom_x"), F.col("bottom.y").alias("bottom_y"), F.col("top.x").alias("top_x"), F.col("top.y").alias("top_y"), "score"), 4)


@query()
def axis_records(spark, d):
    """Axis, sizes and shape of each outline in one pass, a third of them with a model's angle; tests hold the search against loops."""
    k = F.col("vec_id")
    c = fx.contour(spark, d).withColumn("theta", F.when(k % 3 == 0, (k * 37) % 360 + F.lit(0.5)))
    out = axes.measure_outlines(_dealt(spark, c), "vec_id", "c", "theta", refine=True)
    wanted = ["vec_id", "axis_method", "candidates", "reasons", "end_search", "axis_length", "max_width", "width_50pct", "circularity", "endpoint_penalty", "refined", "rough_signs", "shape_label", "measurement_status", "shape_reason"]
    return rounded(out.select(*wanted, F.col("bottom.x").alias("bottom_x"), F.col("bottom.y").alias("bottom_y"), F.col("top.x").alias("top_x"), F.col("top.y").alias("top_y")), 4)


_RUNS = "runs as (select l_orderkey as key, l_linenumber * 7 + l_suppkey % 30 as y, l_partkey % 400 as x0, l_quantity::bigint as length from lineitem), lines as (select o_orderkey as key, o_custkey % 3 as candidate, 150 + o_custkey % 101 + 0.5::double as ax, 20 + o_custkey % 23 + 0.25::double as ay, cos(radians(o_custkey * 7 % 360)) as ux, sin(radians(o_custkey * 7 % 360)) as uy from orders)"


def _runs(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 7 + F.col("l_suppkey") % 30).alias("y"), (F.col("l_partkey") % 400).alias("x0"), F.col("l_quantity").cast("long").alias("length"))


@query(
    f"""with {_RUNS}, px as (select key, y, unnest(range(x0, x0 + length)) as x from runs), d as (select key, candidate, -(x - ax) * uy + (y - ay) * ux as d from px join lines using (key))
    select l.key, l.candidate, coalesce(count(*) filter (d < -0.25), 0) as left_px, coalesce(count(*) filter (d > 0.25), 0) as right_px, {r("coalesce(abs(count(*) filter (d < -0.25) - count(*) filter (d > 0.25)) / nullif(count(*) filter (d < -0.25) + count(*) filter (d > 0.25), 0)::double, 1)")} as penalty
    from lines l left join d on d.key = l.key and d.candidate = l.candidate group by 1, 2"""
)
def mask_balance(spark, d):
    """A mask's area on either side of an axis, by runs; the SQL counts pixels."""
    k = F.col("o_custkey")
    angle = F.radians((k * 7) % 360)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    at = point(150 + k % 101 + F.lit(0.5), 20 + k % 23 + F.lit(0.25))
    lines = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (k % 3).alias("candidate"), at.alias("at"), point(F.lit(0.0), F.lit(0.0)).alias("bottom"), point(F.cos(angle), F.sin(angle)).alias("top"))
    out = axes.side_areas(_runs(spark, d), lines, "key")
    return rounded(out.select("key", "candidate", F.col("left").alias("left_px"), F.col("right").alias("right_px"), F.col("area").alias("penalty")))


@query(
    f"""with {_RUNS}, px as (select key, y::double as y, unnest(range(x0, x0 + length))::double as x from runs), m as (select key, avg(x) as cx, avg(y) as cy, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy from px group by 1), h as (select *, (xx + yy) / 2 as h, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) as q from m)
    select key, {r("cx", 4)} as cx, {r("cy", 4)} as cy, {r("case when h + q > 0 then sqrt(greatest(h - q, 0) / (h + q)) else 1 end", 3)} as ratio, {r("2 * q", 3)} as anisotropy from h"""
)
def mask_axes(spark, d):
    """Centroid and spread of masks, by runs; the SQL counts pixels."""
    m = axes.mask_moments(_runs(spark, d), "key")
    # The greater variance less the lesser one, turned back from the axis's ratio and the sums.
    sums = _runs(spark, d).groupBy("key").agg(*[F.sum(c).alias(n) for n, c in rle.moments(F.col("y"), F.col("x0"), F.col("length")).items()])
    spread = sums.select("key", F.explode(F.array(rle.central(*[F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")]))).alias("c")).select("key", (2 * F.sqrt(((F.col("c.xx") - F.col("c.yy")) / 2) ** 2 + F.col("c.xy") ** 2)).alias("anisotropy"))
    return m.join(spread, "key").select("key", F.round("at.x", 4).alias("cx"), F.round("at.y", 4).alias("cy"), F.round("ratio", 3).alias("ratio"), F.round("anisotropy", 3).alias("anisotropy"))


_TWICE = """w1 as (select a.vec_id, a.i, avg(b.x) as x, avg(b.y) as y from point a join range(-5, 6) t(k) on true join point b on b.vec_id = a.vec_id and b.i = (a.i + k + 64) % 64 group by 1, 2),
    w2 as (select a.vec_id, a.i, avg(b.x) as x, avg(b.y) as y from w1 a join range(-5, 6) t(k) on true join w1 b on b.vec_id = a.vec_id and b.i = (a.i + k + 64) % 64 group by 1, 2)"""


@query(f""", {_TWICE} select vec_id, i::integer as pos, {r("x", 4)} as x, {r("y", 4)} as y from w2""", "contour")
def hint_contour(spark, d):
    """The contour smoothed twice, by which bottoms are refined."""
    c = fx.contour(spark, d).select("vec_id", F.posexplode(geo.smoothed(F.col("c"), 11, 64, 2)).alias("pos", "p"))
    return rounded(c.select("vec_id", "pos", "p.x", "p.y"), 4)


@query(f""", q as (select p.vec_id, p.i, sqrt((x - 50) * (x - 50) + (y - vec_id % 90) * (y - vec_id % 90)) as dist from point p) select vec_id, min_by(i, (dist, i))::integer as nearest from q group by 1""", "contour")
def nearest_contour_point(spark, d):
    """J17."""
    p = F.struct(F.lit(50.0).alias("x"), (F.col("vec_id") % 90).cast("double").alias("y"))
    return fx.contour(spark, d).select("vec_id", geo.nearest_index(F.col("c"), p).alias("nearest"))


def _sharp(w: int, r_: int, weight: float) -> str:
    """Neighbourhood score at one scale of the point numbered vec_id % 64, in SQL."""
    top = min(2 * r_ + 1, max(2, r_ + 1))
    return f"""s{w} as (select a.vec_id, a.i, 1 - acos(greatest(-1, least(1, ((b.x - a.x) * (d.x - a.x) + (b.y - a.y) * (d.y - a.y)) / (sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * sqrt((d.x - a.x) * (d.x - a.x) + (d.y - a.y) * (d.y - a.y)))))) / pi() as s
      from point a join point b on a.vec_id = b.vec_id and b.i = (a.i + {64 - w}) % 64 join point d on a.vec_id = d.vec_id and d.i = (a.i + {w}) % 64),
    n{w} as (select vec_id, list_reverse_sort(list(s)) as l from s{w} where least((i - vec_id % 64 + 64) % 64, (vec_id % 64 - i + 64) % 64) <= {r_} group by 1), t{w} as (select vec_id, {weight} * (0.65 * l[1] + 0.35 * list_sum(l[1:{top}]) / {top}) as v from n{w})"""


@query(f""", {_sharp(5, 2, 1.0)}, {_sharp(8, 3, 1 / 1.5)} select t5.vec_id, {r(f"(t5.v + t8.v) / {1 + 1 / 1.5!r}::double", 5)} as sharpness from t5 join t8 using (vec_id)""", "contour")
def tip_sharpness(spark, d):
    """Sharpness round a point over several scales."""
    return rounded(fx.contour(spark, d).select("vec_id", geo.tip_sharpness(F.col("c"), (F.col("vec_id") % 64).cast("int"), 64).alias("sharpness")), 5)


# Detections: F13, F14, F15, F16, F17, X25.
_REGION = """rg as (select *, case when image_no % 3 <> 0 then greatest(0, least(999, round_even(100 - round_even(540 * 0.005, 0), 0))) end as rx1, case when image_no % 3 <> 0 then greatest(0, least(699, round_even(80 - round_even(540 * 0.005, 0), 0))) end as ry1,
    case when image_no % 3 <> 0 then least(1000, round_even(900 + round_even(540 * 0.005, 0), 0)) end as rx2, case when image_no % 3 <> 0 then least(700, round_even(620 + round_even(540 * 0.005, 0), 0)) end as ry2 from box),
    sh as (select *, greatest(least(x2, rx2) - greatest(x1, rx1), 0) * greatest(least(y2, ry2) - greatest(y1, ry1), 0) / ((x2 - x1) * (y2 - y1)) as share, (x1 + x2) / 2 between rx1 and rx2 and (y1 + y2) / 2 between ry1 and ry2 as centre from rg),
    st as (select *, coalesce(not centre or share < 0.55, false) as outside_tray, rx1 is null and (x1 <= 14 or y1 <= 14 or x2 >= 986 or y2 >= 686) as near_edge from sh)"""


def _detections(spark, d):
    tray = F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 100.0), ("y1", 80.0), ("x2", 900.0), ("y2", 620.0))])
    return fx.box(spark, d).withColumns({"width": F.lit(1000), "height": F.lit(700), "tray": F.when(F.col("image_no") % 3 != 0, tray)})


@query(
    f""", {_REGION}, cl as (select *, not outside_tray and not near_edge as inside from st), fin as (select image_no, box_id, outside_tray, near_edge, inside, floor(least(x1, y1, 1000 - x2, 700 - y2))::bigint as edge_distance,
      case when rx1 is null then null when inside and (x1 < rx1 or y1 < ry1 or x2 > rx2 or y2 > ry2) then 1.0::double else {r("share", 4)} end as tray_share,
      case when inside and rx1 is not null then greatest(x1, rx1) else x1 end as x1, case when inside and rx1 is not null then greatest(y1, ry1) else y1 end as y1, case when inside and rx1 is not null then least(x2, rx2) else x2 end as x2, case when inside and rx1 is not null then least(y2, ry2) else y2 end as y2 from cl)
    select * from fin""",
    "box",
)
def detection_places(spark, d):
    """tray with padding, else the image's edge; what stays is clipped."""
    out = boxes.tray_or_edge(_detections(spark, d))
    edge = F.floor(F.least("x1", "y1", 1000 - F.col("x2"), 700 - F.col("y2")))
    raw = fx.box(spark, d).select("image_no", "box_id", edge.alias("edge_distance"))
    return out.drop("edge_distance").join(raw, ["image_no", "box_id"]).select("image_no", "box_id", "outside_tray", "near_edge", "inside", "edge_distance", "tray_share", "x1", "y1", "x2", "y2")


@query(
    f""", {_REGION}, pl as (select image_no, box_id, conf, outside_tray, near_edge, not outside_tray and not near_edge as inside, case when not outside_tray and rx1 is not null then greatest(x1, rx1) else x1 end as x1, case when not outside_tray and rx1 is not null then greatest(y1, ry1) else y1 end as y1,
      case when not outside_tray and rx1 is not null then least(x2, rx2) else x2 end as x2, case when not outside_tray and rx1 is not null then least(y2, ry2) else y2 end as y2 from st),
    sd as (select *, (x2 - x1) * (y2 - y1) as area, greatest(x2 - x1, y2 - y1) as l, least(x2 - x1, y2 - y1) as s, inside and greatest(x2 - x1, y2 - y1) > 4 * greatest(least(x2 - x1, y2 - y1), 1) as bad from pl),
    m as (select image_no, median(area) filter (inside and not bad) as ma, median(l) filter (inside and not bad) as ml, median(s) filter (inside and not bad) as ms, count(*) filter (inside and not bad) as active from sd group by 1),
    fl as (select sd.*, coalesce(inside and not bad and active >= 8 and (area < 0.35 * ma or l < 0.45 * ml or s < 0.45 * ms), false) as small_, coalesce(inside and not bad and active >= 8 and (area > 3 * ma or l > 2.2 * ml or s > 2.2 * ms), false) as large_ from sd join m using (image_no)),
    sz as (select * from fl where inside and not bad and not small_ and not large_), {GREEDY},
    kp as (select sz.*, coalesce(list_contains(g1.g, box_id), false) as contained, coalesce(list_contains(g2.g, box_id), false) as gone from sz left join g1 using (image_no) left join g2 using (image_no)),
    c as (select image_no, box_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, y2 - y1 as h from kp where not gone), {READ},
    places as (select image_no, t.id as box_id, row_number() over (partition by image_no order by y, k, t.cx, t.id) as final_id from b)
    select fl.image_no, fl.box_id, final_id is not null as kept, final_id, concat_ws(',', case when outside_tray then 'outside_tray' end, case when near_edge then 'near_image_edge' end, case when bad then 'bad_aspect_ratio' end, case when small_ then 'too_small' end, case when large_ then 'too_large' end, case when contained then 'overlap_contained' when gone then 'overlap_multi_center' end) as reasons
    from fl left join (select image_no, box_id, contained, gone from kp) k2 using (image_no, box_id) left join places using (image_no, box_id)""",
    "box",
)
def detection_chain(spark, d):
    """The whole chain; a loop in the tests agrees too."""
    return boxes.filter_detections(_detections(spark, d)).select("image_no", "box_id", "kept", "final_id", F.array_join("reasons", ",").alias("reasons"))


# Axis candidates: P21, R3, R7, W17, W18.
_PARTS = "axp as (select l_orderkey as key, row_number() over (partition by l_orderkey order by {o}) as candidate, fmod(l_extendedprice, 180.0::double) as angle, l_quantity as length, l_discount * 8 as area, l_tax * 9 as width, (l_partkey % 100) / 120.0::double as color, (l_suppkey % 70) / 70.0::double as endpoint from lineitem)".format(o=fx._L)
_SCORED = f"""{_PARTS}, ref as (select key, quantile_cont(length, 0.9) as reference from axp where length > 0 group by 1), sc as (select axp.*, reference, greatest(3.0::double, reference * 0.72::double) as low from axp join ref using (key) where length >= 1),
    pen as (select *, case when length >= reference then 0.0::double when length >= low then greatest(0, least(1, (reference - length) / greatest(reference - low, 1e-6))) else 1.0::double end as length_penalty from sc),
    tot as (select *, greatest(0, least(1, (0.25 * area + 0.3 * width + 0.25 * color + 0.1 * length_penalty + 0.1 * endpoint) / (0.25::double + 0.3 + 0.25 + 0.1 + 0.1))) as score from pen)"""


def _candidates(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("candidate", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*fx._ORDER)).cast("long"))
    return li.select(F.col("l_orderkey").alias("key"), "candidate", F.pmod("l_extendedprice", F.lit(180.0)).alias("angle"), F.col("l_quantity").alias("length"), (F.col("l_discount") * 8).alias("area"), (F.col("l_tax") * 9).alias("width"), ((F.col("l_partkey") % 100) / 120.0).alias("color"), ((F.col("l_suppkey") % 70) / 70.0).alias("endpoint"))


@query(f"with {_SCORED} select key, candidate, {r('reference')} as reference, {r('length_penalty')} as length_penalty, {r('score', 5)} as score from tot")
def axis_scores(spark, d):
    """Penalties and total score of axis candidates."""
    return rounded(boxes.score_axes(_candidates(spark, d)).select("key", "candidate", "reference", "length_penalty", places(F.col("score"), 5).alias("score")))


@query(
    f"""with {_SCORED}, rk as (select *, row_number() over w as rank, lead(score) over w - score as margin from tot window w as (partition by key order by score, length desc, candidate)),
    o as (select key, min(area) as area_least, min(width) as width_least, min(color) as color_least, min_by(angle, (area, rank)) as best_area, min_by(angle, (width, rank)) as best_width, min_by(angle, (color, rank)) as best_color from rk group by 1),
    t as (select b.*, concat_ws('|', case when margin <= 0.035 then 'top2_margin<=0.035' end, case when area >= 0.7 then 'area_balance_penalty>=0.70' end, case when width >= 0.7 then 'width_symmetry_penalty>=0.70' end, case when color >= 0.7 then 'color_symmetry_penalty>=0.70' end, case when endpoint >= 0.7 then 'endpoint_penalty>=0.70' end,
      {", ".join(f"case when {c} - {c}_least >= 0.12 and least(fmod(angle - best_{c} + 180, 180::double), 180 - fmod(angle - best_{c} + 180, 180::double)) >= 25 then '{n}_winner_conflicts' end" for c, n in (("area", "area_balance_penalty"), ("width", "width_symmetry_penalty"), ("color", "color_symmetry_penalty")))}) as reasons from rk b join o using (key) where rank = 1)
    select key, candidate, {r("score", 5)} as score, reasons, reasons <> '' as unsure from t"""
)
def axis_choice(spark, d):
    """The best candidate and why it isn't sure; a loop in the tests agrees too."""
    return rounded(boxes.choose_axis(boxes.score_axes(_candidates(spark, d))).select("key", "candidate", places(F.col("score"), 5).alias("score"), "reasons", "unsure"))


_TRAYS = "tr as (select o_custkey as image_no, o_orderkey as candidate, 20000 + fmod(o_totalprice * 7, 400000::double) as contour_area, (o_orderkey * 13) % 1000 as cx, (o_orderkey * 29) % 700 as cy, 200 + (o_orderkey * 7) % 500 as rect_w, 200 + (o_orderkey * 11) % 500 as rect_h from orders)"


@query(
    f"""with {_TRAYS}, g as (select *, contour_area / 700000.0::double as share, greatest(rect_w, rect_h) as lo, least(rect_w, rect_h) as sh, contour_area / (rect_w * rect_h) as fill from tr), s as (select *, lo / sh::double as aspect from g),
    t as (select *, 120 * share + 2.4::double * greatest(-1, 1 - abs(cx - 500) / 500.0::double) + 1.8::double * greatest(-1, 1 - abs(cy - 700 * 0.52::double) / (700 * 0.35::double)) + 1.6::double * fill + 1.3::double * (1 - least(1, abs(aspect - 1) / (1.45::double - 1))) as score from s where share between 0.03 and 0.45 and aspect <= 1.45 and fill >= 0.45)
    select image_no, candidate, {r("score", 4)} as score, lo::double as long_side, sh::double as short_side from t qualify row_number() over (partition by image_no order by score desc, candidate) = 1"""
)
def tray_choice(spark, d):
    """The best tray candidate of each image."""
    k = F.col("o_orderkey")
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("image_no"), k.alias("candidate"), (20000 + F.pmod(F.col("o_totalprice") * 7, F.lit(400000.0))).alias("contour_area"), ((k * 13) % 1000).alias("cx"), ((k * 29) % 700).alias("cy"), (200 + (k * 7) % 500).cast("double").alias("rect_w"), (200 + (k * 11) % 500).cast("double").alias("rect_h"), F.lit(1000).alias("width"), F.lit(700).alias("height"))
    return rounded(boxes.choose_tray(o), 4)


@query(f"""select o_orderkey, {r("scale")} as scale, source, warning from (select o_orderkey, coalesce(m, f) as scale, case when m is not null then 'detected' when f is not null then 'fixed' end as source, case when m is null and f is not null then 'not detected' when abs(m - f) / greatest(f, 1e-6) > 0.03 then 'deviation' end as warning
    from (select o_orderkey, case when o_orderkey % 5 <> 0 then 0.05::double + (o_orderkey % 11) / 2000.0::double end as m, case when o_orderkey % 7 <> 0 then 0.052::double end as f from orders))""")  # fmt: skip
def scale_check(spark, d):
    """X23."""
    k = F.col("o_orderkey")
    both = traits.checked_scale(F.when(k % 5 != 0, F.lit(0.05) + (k % 11) / 2000.0), F.when(k % 7 != 0, F.lit(0.052)))
    return rounded(fx.table(spark, d, "orders").select("o_orderkey", both.alias("s")).select("o_orderkey", "s.scale", "s.source", "s.warning"))


def _clamped(x1: str, y1: str, x2: str, y2: str) -> str:
    lo = lambda v, top: f"greatest(0, least({top} - 1, round_even({v}, 0)))"
    hi = lambda v, top, o: f"greatest(greatest(0, least({top}, round_even({v}, 0))), least({top}, {lo(o, top)} + 1))"
    return f"[{lo(x1, 'w')}::bigint, {lo(y1, 'h')}::bigint, {hi(x2, 'w', x1)}::bigint, {hi(y2, 'h', y1)}::bigint]"


_IMAGES = "im as (select o_orderkey as image_no, 800 + o_orderkey % 300 as w, 600 + o_orderkey % 200 as h, case when o_orderkey % 4 = 0 then 300.0::double end as s1, case when o_orderkey % 3 <> 0 then 120.0::double + o_orderkey % 90 end as t1 from orders)"
_UNDER = lambda side, up, down, sign: _clamped(f"t1 + {sign} * {side} * 500", f"greatest(round_even(h * 0.5, 0), 420 - {up} * 300)", f"t1 + 500 - {sign} * {side} * 500", f"least(h, 420 + {down} * 300)")


@query(
    f"""with {_IMAGES}, rg as (select image_no, 0 as k, 'yolo_weight_screen' as source, 1.5::double as priority, {_clamped("s1 - 8", "350 - 4", "s1 + 160 + 8", "350 + 80 + 4")} as box from im where s1 is not null
      union all select image_no, 1, 'bottom_split_scan', 0.45::double, [0, round_even(h * 0.5, 0)::bigint, w, h] from im where s1 is null
      union all select image_no, 2, 'bottom_center_scan', 1.0::double, {_clamped("w * 0.22", "greatest(round_even(h * 0.5, 0), h * 0.62)", "w * 0.78", "h")} from im where s1 is null
      union all select image_no, 3, 'tray_bottom_scan', 1.2::double, {_UNDER(0.08, 0.06, 0.42, -1)} from im where s1 is null and t1 is not null
      union all select image_no, 4, 'tray_weight_screen_band', 1.35::double, {_UNDER(0.18, 0.02, 0.30, 1)} from im where s1 is null and t1 is not null)
    select image_no, source, priority, array_to_string(box, ',') as box from rg qualify row_number() over (partition by image_no, box order by k) = 1"""
)
def search_regions(spark, d):
    """Where an image's weight is searched."""
    k = F.col("o_orderkey")
    box = lambda x1, y1, x2, y2: F.struct(*[v.cast("double").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])
    left = 120 + k % 90
    im = fx.table(spark, d, "orders").select(k.alias("image_no"), (800 + k % 300).alias("width"), (600 + k % 200).alias("height"), F.when(k % 4 == 0, box(F.lit(300), F.lit(350), F.lit(460), F.lit(430))).alias("screen"), F.when(k % 3 != 0, box(left, F.lit(120), left + 500, F.lit(420))).alias("tray"))
    return traits.search_regions(im).select("image_no", "source", "priority", F.array_join("box", ",").alias("box"))


# Coordinates and label files: X29, X31, X37, X39, X41.
@query(
    f"""select image_no, box_id, greatest(0, least(999, round_even(7.4::double + greatest(0, floor(x1) - 20), 0)))::bigint as full_x, {r("least(greatest(1, conf * 6), greatest(1, 2600 / greatest(1, x2 - x1, y2 - y1)))")} as ocr_scale,
    greatest(2, least(3, round_even((y2 - y1) * 40 / 1000.0::double, 0)))::integer as radius, greatest(1, least(2, round_even((y2 - y1) * 40 / 1400.0::double, 0)))::integer as line, {r("greatest(0.34::double, least(0.46::double, (y2 - y1) * 40 / 3600.0::double))")} as letters, {r("(x1 + 0) * (900 / 1000.0::double)")} as shown_x, {r("(y1 + 150) * (900 / 1000.0::double)")} as shown_y, {r("greatest(0, least(699, y1 / 0.9::double - 150))")} as back_y from box""",
    "box",
)
def coordinates(spark, d):
    """Between cut-outs, whole images and displays."""
    b = fx.box(spark, d)
    h = F.col("y2") - F.col("y1")
    at = num.square_display(F.lit(1000), F.lit(700), 900)
    b = b.withColumns({"o": num.overlay_scale(h * 40 + 100000, h * 40), "s": at})
    return rounded(b.select(
        "image_no", "box_id", num.full_point(F.lit(7.4), F.floor("x1"), F.lit(1000)).alias("full_x"), num.scale_limit(F.col("conf") * 6, F.col("x2") - F.col("x1"), h, F.lit(2600)).alias("ocr_scale"), "o.radius", "o.line", "o.letters",
        num.to_display(F.col("x1"), F.col("s.left"), F.col("s.scale")).alias("shown_x"), num.to_display(F.col("y1"), F.col("s.above"), F.col("s.scale")).alias("shown_y"), num.from_display(F.col("y1"), F.col("s.above"), F.col("s.scale"), F.lit(700)).alias("back_y"),
    ))


@query(f"""select l_orderkey, {r("pred", 5)} as theta_deg, {r("cos(radians(pred))", 5)} as cos_theta, {r("sin(radians(pred))", 5)} as sin_theta, {r("cos(2 * radians(pred))", 5)} as cos2theta, {r("sin(2 * radians(pred))", 5)} as sin2theta from angle""", "angle")
def angle_encoding(spark, d):
    """X37."""
    return rounded(fx.angle(spark, d).select("l_orderkey", num.angle_encoding(F.col("pred")).alias("e")).select("l_orderkey", "e.theta_deg", "e.cos_theta", "e.sin_theta", "e.cos2theta", "e.sin2theta"), 5)


@query(f"""select model, {r("avg(1 - dot / n)", 5)} as loss, {r("avg(1 - dot / n) + 0.05::double * avg((n - 1) * (n - 1))", 5)} as with_length, {r("avg(dot / n)", 5)} as cosine from (select model, 1 + l_orderkey % 3 / 10.0::double as n, (1 + l_orderkey % 3 / 10.0::double) * cos(radians(pred) - radians(true_)) as dot from angle) group by 1""", "angle")
def direction_loss(spark, d):
    """Losses of predicted directions."""
    a = fx.angle(spark, d)
    n, p, t = 1 + F.col("l_orderkey") % 3 / 10.0, F.radians("pred"), F.radians("true")
    loss, longer, cosine = stats.direction_loss(n * F.cos(p), n * F.sin(p), F.cos(t), F.sin(t))
    return rounded(a.groupBy("model").agg(loss.alias("loss"), longer.alias("with_length"), cosine.alias("cosine")), 5)


# Labels of images: X9, U3, T6, R9, W16, R20.
@query(
    f"""with t as (select p_partkey % 500 as image_no, p_partkey + case when p_partkey % 500 % 4 = 0 then 1000000 else 0 end as line, {_norm('raw')} as text, (p_partkey % 100) / 100.0::double as conf, p_size::double as y, (p_partkey % 7)::double as x
      from (select *, case when p_partkey % 5 = 0 then 'P' || p_partkey when p_partkey % 3 = 0 then '-B' || p_partkey || '-' else concat_ws('_', p_brand, p_type, p_name) end as raw from part)), f as (select *, length(regexp_replace(text, '[^-]', '', 'g')) as h, length(regexp_replace(text, '[^A-Z0-9]', '', 'g')) as a from t where conf >= 0.2),
    b as (select image_no, text as label, 100 * conf + 12 * h + a + 20 as score from f where h >= 2 and a >= 8 qualify row_number() over (partition by image_no order by 100 * conf + 12 * h + a desc, line) = 1),
    w as (select image_no, nullif(regexp_extract(string_agg(text, '' order by y, x, line), '([A-Z0-9]+(?:-[A-Z0-9]+){{2,}})', 1), '') as target from f group by 1),
    p as (select image_no, conf from f join w using (image_no) where contains(target, text) or contains(text, target) qualify row_number() over (partition by image_no order by y, x, line) = 1)
    select image_no, coalesce(label, target) as label, {r("case when label is not null then score else round(conf * 100, 3) end")} as score from w left join b using (image_no) left join p using (image_no) where coalesce(label, target) is not null"""
)
def label_reading(spark, d):
    """The best line, else a label over all lines; a loop in the tests agrees too."""
    p = fx.table(spark, d, "part")
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("P"), k.cast("string"))).when(k % 3 == 0, F.concat(F.lit("-B"), k.cast("string"), F.lit("-"))).otherwise(F.concat_ws("_", "p_brand", "p_type", "p_name"))
    lines = p.select((k % 500).alias("image_no"), k.alias("line"), tx.normalise_label(raw).alias("text"), ((k % 100) / 100.0).alias("conf"), F.col("p_size").cast("double").alias("y"), (k % 7).cast("double").alias("x"))
    first = traits.first_source(lines.where("image_no % 4 <> 0"), lines.withColumn("line", F.col("line") + 1_000_000), "image_no")
    return rounded(traits.read_labels(first.where("conf >= 0.2")))


@query("""with i as (select n_nationkey, n_regionkey, n_nationkey in (select n_nationkey from nation where n_nationkey % 3 <> 0) as done from nation)
    select n_regionkey, n_nationkey, coalesce((select min(b.n_nationkey) from i b where b.n_regionkey = a.n_regionkey and not b.done and b.n_nationkey > a.n_nationkey), (select min(b.n_nationkey) from i b where b.n_regionkey = a.n_regionkey and not b.done)) as next from i a""")
def next_unlabelled(spark, d):
    """W16."""
    n = fx.table(spark, d, "nation")
    out = traits.next_unlabelled(n.select("n_regionkey", "n_nationkey", F.col("n_nationkey").alias("place")), n.where("n_nationkey % 3 <> 0").select("n_nationkey"), "n_nationkey", "n_regionkey", "place")
    return out.select("n_regionkey", "n_nationkey", "next")


@query(f"""select o_orderkey, {r("case when o_orderkey % 4 = 0 then null when o_orderkey % 3 = 0 then fmod(o_totalprice, 360::double) else 0.5 * fmod(o_totalprice, 180::double) end", 4)} as theta, o_orderkey % 4 = 0 as skipped from orders""")
def initial_angles(spark, d):
    """Skipped rows are blank; an angle comes from the row that is there, else from the start value."""
    k = F.col("o_orderkey")
    own, start = F.when(k % 3 == 0, F.pmod("o_totalprice", F.lit(360.0))), 0.5 * F.pmod("o_totalprice", F.lit(180.0))
    return rounded(fx.table(spark, d, "orders").select("o_orderkey", F.when(k % 4 != 0, F.coalesce(own, start)).alias("theta"), (k % 4 == 0).alias("skipped")), 4)


# Joins, counts, order and display: J3, J4, J18, J19, J21, G12, F5, F10, F21, T1, T2, T10, T11, X19, S14.
@query("select k.kernel_name, p.p_size from kernel k join part p on p.p_partkey = k.l_partkey + case when k.kernel_id % 2 = 0 then 1000000000 else 0 end", "kernel")
def with_axis(spark, d):
    """Objects with their axis; those without one, whose keys nothing has, go."""
    axis = fx.table(spark, d, "part").select(F.col("p_partkey").alias("axis"), "p_size")
    k = fx.kernel(spark, d).withColumn("axis", F.col("l_partkey") + F.when(F.col("kernel_id") % 2 == 0, 1_000_000_000).otherwise(0))
    return k.join(axis, "axis").select("kernel_name", "p_size")


@query("select kernel_name, coalesce(m.plant_name, 'UNKNOWN') as plant_name from kernel left join (select case when image_no % 5 = 0 then '?' else '' end || image_name as image_name, plant_name from image qualify row_number() over (partition by image_name order by seq desc) = 1) m using (image_name)", "kernel image")
def kernel_plant(spark, d):
    """Object to image to group, UNKNOWN where the image has none."""
    i = fx.image(spark, d).withColumn("image_name", F.concat(F.when(F.col("image_no") % 5 == 0, "?").otherwise(""), F.col("image_name")))  # names that no object has
    return traits.with_metadata(fx.kernel(spark, d), i).select("kernel_name", "plant_name")


@query("select i.stem, k.kernel_name from (select distinct stem from kernel) i join kernel k on regexp_extract(k.kernel_name, '^(.*)_kernel_', 1) = i.stem", "kernel")
def kernels_of_image(spark, d):
    """An image's objects by the beginning of their names; the beginning is a key, so it is an equi-join."""
    k = fx.kernel(spark, d)
    stems = k.select("stem").distinct()
    return stems.join(k.select(tx.kernel_stem(F.col("kernel_name")).alias("stem"), "kernel_name"), "stem")


@query("select o_orderkey, c_name, c_acctbal from orders left join customer on c_custkey = o_custkey + case when o_orderkey % 4 = 0 then 1000000000 else 0 end")
def plant_lookup(spark, d):
    """The group's row, or nulls for groups that nothing has."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("group"), "c_name", "c_acctbal")
    o = fx.table(spark, d, "orders").withColumn("group", F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 1_000_000_000).otherwise(0))
    return o.join(c, "group", "left").select("o_orderkey", "c_name", "c_acctbal")


@query("select s.n_nationkey as sample, e.label::bigint as label, p.p_name from nation s join embeddings e on e.vec_id = s.n_nationkey * 3 join part p on p.p_partkey = s.n_nationkey * 5")
def sample_rows(spark, d):
    """Samples that have both a latent and a profile."""
    s = fx.table(spark, d, "nation").select("n_nationkey")
    e = fx.table(spark, d, "embeddings").select((F.col("vec_id")).alias("v"), F.col("label").cast("long").alias("label"))
    p = fx.table(spark, d, "part").select("p_partkey", "p_name")
    return s.join(e, F.col("v") == F.col("n_nationkey") * 3).join(p, F.col("p_partkey") == F.col("n_nationkey") * 5).select(F.col("n_nationkey").alias("sample"), "label", "p_name")


@query("select o_orderstatus, count(*) as n, count(*) filter (o_orderkey % 3 = 0) as with_label, count(*) filter (o_orderkey % 5 = 0) as with_screen, count(*) filter (try_cast(case when o_orderkey % 2 = 0 then 'UNKNOWN' else o_totalprice::varchar end as double) is not null) as with_weight from orders group by 1")
def found_counts(spark, d):
    """G12."""
    k = F.col("o_orderkey")
    weight = F.when(k % 2 == 0, "UNKNOWN").otherwise(F.col("o_totalprice").cast("string")).try_cast("double")
    return fx.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(k % 3 == 0).alias("with_label"), F.count_if(k % 5 == 0).alias("with_screen"), F.count_if(weight.isNotNull()).alias("with_weight"))


@query("select kernel_name, circularity from kernel where not circularity > 0.95 and image_no not in (select o_orderkey from orders where o_orderstatus = 'F')", "kernel")
def without_round(spark, d):
    """round objects and those of deleted images go."""
    gone = fx.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_no"))
    return traits.delete_keys(fx.kernel(spark, d).where("not circularity > 0.95"), gone, "image_no").select("kernel_name", "circularity")


@query("""select o_orderkey, case when o_orderkey % 3 <> 0 then o_totalprice when o_orderkey % 2 = 0 then 7.0::double else 0.0::double end as x, case when o_orderkey % 3 <> 0 then 1.5::double when o_orderkey % 2 = 0 then 8.0::double else 0.0::double end as y from orders""")
def point_or_fallback(spark, d):
    """F21."""
    k = F.col("o_orderkey")
    x, y = F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")), F.lit(1.5)
    p = traits.valid_point(x, y, (F.when(k % 2 == 0, 7.0), F.when(k % 2 == 0, 8.0)))
    return fx.table(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.x", "p.y")


@query("""select image_no, kernel_id, row_number() over (partition by image_no order by regexp_extract(kernel_name, '_kernel_(\\d+)', 1)::bigint, kernel_name) as place, row_number() over (partition by image_no order by kernel_name desc) as by_name from kernel""", "kernel")
def sorted_names(spark, d):
    """By name and by the number in it, per image."""
    n = F.col("kernel_name")
    w = Window.partitionBy("image_no")
    return fx.kernel(spark, d).select("image_no", "kernel_id", F.row_number().over(w.orderBy(tx.kernel_number(n), n)).cast("long").alias("place"), F.row_number().over(w.orderBy(n.desc())).cast("long").alias("by_name"))


@query("select vec_id from embeddings order by vec_id limit 20")
def limited_rows(spark, d):
    """The first rows of a test list, a limit by nature."""
    return fx.table(spark, d, "embeddings").select("vec_id").orderBy("vec_id").limit(20)


@query("""select vec_id, coalesce(printf('%.2f', case when vec_id % 5 <> 0 then floor(vec_id * 3.7::double) / 8 end), '') as two, coalesce(printf('%.4f', case when vec_id % 3 <> 0 then floor(vec_id * 1.9::double) / 16 end), '') as four from embeddings""")
def display_numbers(spark, d):
    """X19."""
    v = F.col("vec_id")
    return fx.table(spark, d, "embeddings").select("vec_id", traits.display_text(F.when(v % 5 != 0, F.floor(v * 3.7) / 8), 2).alias("two"), traits.display_text(F.when(v % 3 != 0, F.floor(v * 1.9) / 16), 4).alias("four"))


# Latents: G14, G26, T8, T9, U10, M2, M6.
@query()
def correlation_stars(spark, d):
    """Tests hold the p-values against known ones and an integral."""
    li = fx.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("l_tax"))
    return rounded(stats.correlation_tests(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query(f"""select d - 1 as dim, vec_id as key, {r("embedding[d]::double")} as value from embeddings, range(1, 6) t(d) qualify row_number() over (partition by d order by abs(embedding[d]::double) desc, vec_id) = 1""")
def strongest_latents(spark, d):
    """T8."""
    return rounded(stats.strongest_rows(_latent(spark, d), "key", "z").select(F.col("dim").cast("long").alias("dim"), "key", "value"))


_MIDDLE = "md as (select d, median(embedding[d]::double) as m, min(embedding[d]::double) as lo, max(embedding[d]::double) as hi from embeddings, range(1, 6) t(d) group by 1)"


@query(f"""with {_MIDDLE}, f as (select vec_id, sum((embedding[d]::double - m) * (embedding[d]::double - m)) as dist from embeddings, md group by 1), a as (select vec_id from f order by round(dist, 12), vec_id limit 1)
    select vec_id as key, 'median' as pick from a union all (select vec_id, 'other' from embeddings where vec_id not in (select vec_id from a) order by md5('42' || vec_id), vec_id limit 4)""")
def median_and_others(spark, d):
    """A report of five by nature; the others by a hash, so they are the same on every run."""
    return stats.nearest_to_median(_latent(spark, d), "key", "z", 4, "42")


@query(f"""with {_MIDDLE} select a.d - 1 as dim, side, b.d - 1 as pos, {r("case when a.d <> b.d then b.m when side = 'low' then b.lo else b.hi end")} as value from md a, md b, (values ('low'), ('high')) s(side)""")
def substituted_medians(spark, d):
    """U10, R14."""
    out = stats.substituted(_latent(spark, d), "z", 5).select(F.col("dim").cast("long").alias("dim"), "side", F.posexplode("z").alias("pos", "value"))
    return rounded(out.select("dim", "side", F.col("pos").cast("long").alias("pos"), "value"))


@query(f"""with e as (select label, embedding[d]::double as x, embedding[d]::double * 0.9::double as recon from embeddings, range(1, 65) t(d)), k as (select label, -0.5 * avg(1 + embedding[d]::double / 2 - embedding[d]::double * embedding[d]::double - exp(embedding[d]::double / 2)) as kl from embeddings, range(1, 6) t(d) group by 1)
    select label::bigint as label, {r("mse")} as mse, {r("kl")} as kl, {r("mse + 0.001::double * kl")} as loss from (select label, avg((recon - x) * (recon - x)) as mse from e group by 1) join k using (label)""")
def latent_loss(spark, d):
    """M6: the loss of stored reconstructions and latents."""
    w = F.transform("embedding", lambda x: x.cast("double"))
    e = fx.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), w.alias("x"))
    e = e.select("label", "x", F.transform("x", lambda v: v * 0.9).alias("recon"), F.slice("x", 1, 5).alias("mu"), F.transform(F.slice("x", 1, 5), lambda v: v / 2).alias("logvar"))
    mse, kl = stats.vae_loss(F.col("recon"), F.col("x"), F.col("mu"), F.col("logvar"))
    out = e.groupBy("label").agg(mse.alias("mse"), kl.alias("kl"))
    return rounded(out.withColumn("loss", F.col("mse") + 0.001 * F.col("kl")))


@query(f"""with z as (select vec_id, d - 1 as pos, embedding[d]::double as v from embeddings, range(1, 6) t(d)), s as (select pos, avg(v) as m, stddev_samp(v) as sd from z group by 1) select vec_id as key, pos::integer as pos, {r("(v - m) / case when coalesce(sd, 0) = 0 then 1 else sd end", 5)} as value from z join s using (pos)""")
def latent_standardised(spark, d):
    """G14."""
    return rounded(stats.standardised(_latent(spark, d), "key", "z"), 5)



@query()
def pca_loadings(spark, d):
    """M2: loadings with the place along the profile; tests hold them against NumPy."""
    e = fx.table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return components_analysis.loadings(e, "v", 5)
