"""Named queries over the fixtures, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import numeric as num
from ..functions import profile as prof
from ..functions import text as tx
from ..operators import boxes, components_analysis, stats, traits
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a query under its function's name, with its SQL over the named views."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = fx.sql(views, sql)
        return f

    return put


def places(x, digits: int):
    """A double rounded as the SQL does it: scaled, then to a whole number; Spark rounds its decimal text, which goes the other way next to a half."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and a negative zero made a zero, for comparison."""
    return df.select(*[(places(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0::double)"


# Group traits: J1, J2, G1, G4, G5, G8.
@query(
    f"""select plant_name, n_kernels, {r("median_length")} as median_length, {r("median_width")} as median_width, {r("median_area")} as median_area, {r("median_circularity")} as median_circularity,
    length(source_images)::bigint as source_length, weight_text as weight_g, {r("case when n_kernels > 0 then round(try_cast(weight_text as double) / n_kernels, 4) end", 4)} as weight_per_kernel_g
    from (select plant_name, count(*) as n_kernels, median(length) as median_length, median(width) as median_width, median(area) as median_area, median(circularity) as median_circularity, string_agg(distinct image_name, ';' order by image_name) as source_images
      from (select k.*, coalesce(m.plant_name, 'UNKNOWN') as plant_name from kernel k left join (select image_name, plant_name from image qualify row_number() over (partition by image_name order by seq desc) = 1) m using (image_name)) group by plant_name)
    left join (select plant_name, weight_text from image where trim(coalesce(weight_text, '')) <> '' qualify row_number() over (partition by plant_name order by image_no, seq) = 1) using (plant_name)""",
    "kernel image",
)
def plant_trait_table(spark, d):
    images = fx.image(spark, d)
    groups = traits.group_traits(traits.with_metadata(fx.kernel(spark, d), images), ["length", "width", "area", "circularity"])
    out = groups.join(traits.group_weights(images), "plant_name", "left")
    each = traits.weight_each(F.col("weight_text"), F.col("n_kernels"))
    return rounded(out.select("plant_name", "n_kernels", *[f"median_{c}" for c in ("length", "width", "area", "circularity")], F.length("source_images").cast("long").alias("source_length"), F.col("weight_text").alias("weight_g"), each.alias("weight_per_kernel_g")))


# Object traits: J1, J6, F1, F3, X21.
@query(
    f"""select kernel_name, plant_name, {r("round(length * scale, 4)", 4)} as length_mm, {r("round(area * scale * scale, 4)", 4)} as area_mm2, {r("width / length")} as ratio from scaled""",
    "scaled",
)
def kernel_trait_table(spark, d):
    k = fx.scaled(spark, d)
    k = k.withColumns({"length_mm": num.to_mm(F.col("length"), F.col("scale")), "area_mm2": num.to_mm2(F.col("area"), F.col("scale")), "ratio": F.col("width") / F.col("length")})
    return rounded(traits.pick(k, ["kernel_name", "plant_name", "length_mm", "area_mm2", "ratio", "not_there"]), 6)


@query(f"""select kernel_name, {r("coalesce(scale, case when plant_name is not null then median(scale) over (partition by plant_name) end)", 8)} as scale_filled from scaled""", "scaled")
def scale_fill(spark, d):
    """The group's median scale where an image has none."""
    return rounded(traits.filled_scale(fx.scaled(spark, d)).select("kernel_name", "scale_filled"), 8)


@query(f"""select plant_name, count(*) as n, {r("case when count(scale) = count(*) then median(length * scale) end")} as median_length_mm from scaled group by plant_name""", "scaled")
def mm_all_or_nothing(spark, d):
    """G3."""
    k = fx.scaled(spark, d).withColumn("mm", F.col("length") * F.col("scale"))
    return rounded(k.groupBy("plant_name").agg(F.count("*").alias("n"), traits.median_if_complete("mm").alias("median_length_mm")))


@query(
    f"""select kernel_name, case when circularity > 0.9 then 'round' when confidence < 0.5 then 'uncertain' else 'ok' end as status, case when circularity > 0.9 then 'circularity' when confidence < 0.5 then 'confidence' end as reason,
    {r("circularity")} as circularity, case when not circularity > 0.9 then {r("length")} end as length, case when not circularity > 0.9 then {r("width")} end as width from kernel""",
    "kernel",
)
def round_classify(spark, d):
    """round objects keep their circularity and lose their sizes."""
    return rounded(traits.blank_round(fx.kernel(spark, d), ["length", "width"]).select("kernel_name", "status", "reason", "circularity", "length", "width"))


@query("""select kernel_name, image_no, kernel_id from kernel where length >= 100 and confidence >= 0.6 and kernel_id between 1 and 3""", "kernel")
def threshold_filter(spark, d):
    """Thresholds keep equal values."""
    return fx.kernel(spark, d).where("length >= 100 and confidence >= 0.6 and kernel_id between 1 and 3").select("kernel_name", "image_no", "kernel_id")


@query("""select image_no, kernel_id, area from kernel where area >= 1000 qualify row_number() over (partition by image_no order by area desc, kernel_id) = 1""", "kernel")
def largest_object(spark, d):
    """the largest object of an image over a least area."""
    return traits.one_per_key(fx.kernel(spark, d).where("area >= 1000"), "image_no", [F.desc("area"), F.col("kernel_id")]).select("image_no", "kernel_id", "area")


@query("select c_name, c_mktsegment from customer where contains(lower(c_name), '00012')")
def substring_filter(spark, d):
    """F4."""
    return traits.containing(fx.table(spark, d, "customer").select("c_name", "c_mktsegment"), " 00012 ")


@query("select c_custkey, c_name, c_nationkey from customer")
def drop_columns(spark, d):
    """columns dropped by name and by beginning."""
    return traits.without(fx.table(spark, d, "customer"), ["c_mktsegment"], ("c_acct",))


@query("select k.kernel_name, b.box_id from kernel k join box b on b.image_no = floor(k.image_no / 20)::bigint and b.box_id = k.kernel_id", "kernel box")
def box_lookup(spark, d):
    """A join on image and number."""
    k = fx.kernel(spark, d).select("kernel_name", F.floor(F.col("image_no") / 20).alias("image_no"), F.col("kernel_id").alias("box_id"))
    return k.join(fx.box(spark, d), ["image_no", "box_id"]).select("kernel_name", "box_id")


@query(
    """select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then 'pre' end, case when o_orderkey % 2 = 0 then s.l_returnflag end, 'none') as source from orders left join (select l_orderkey, min(l_returnflag) as l_returnflag from lineitem group by 1) s on l_orderkey = o_orderkey"""
)
def priority_fill(spark, d):
    """The first source that has a value fills."""
    o = fx.table(spark, d, "orders")
    s = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    j = o.join(s, o["o_orderkey"] == s["l_orderkey"], "left")
    return j.select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, "pre"), F.when(F.col("o_orderkey") % 2 == 0, F.col("flag")), F.lit("none")).alias("source"))


@query("select vec_id, label::bigint as label from embeddings where vec_id in (select n_nationkey * 7 from nation)")
def semi_profiles(spark, d):
    """Profiles restricted to known ids."""
    ids = fx.table(spark, d, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("vec_id"))
    return fx.profile(spark, d).join(ids, "vec_id", "left_semi").select("vec_id", "label")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def anti_labels(spark, d):
    """Labels whose overlay is gone go too, unless none is left."""
    labels = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    present = fx.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return traits.without_deleted(labels, present, "o_orderkey")


_FUZZY = """i as (select 'S' || n_nationkey as image_name, lower(n_name) as stem, case when n_nationkey % 4 = 0 then lower(n_name) else 'x' end as plant_name from nation),
    p as (select case when n_nationkey % 2 = 0 then lower(n_name) else 'q' || n_nationkey end as name, n_nationkey as ord from nation union all select substr(lower(r_name), 1, 2), 100 + r_regionkey from region)"""


@query(
    f"""with {_FUZZY}, e as (select image_name, name from i join p on plant_name = name)
    select image_name, coalesce(e.name, f.name) as profile from i left join e using (image_name) left join (select image_name, name from i join p on contains(stem, name) or contains(name, stem)
      where image_name not in (select image_name from e) qualify row_number() over (partition by image_name order by ord) = 1) f using (image_name)"""
)
def fuzzy_plant(spark, d):
    """By group, else by the first name that is part of the other."""
    n, g = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    i = n.select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("image_name"), F.lower("n_name").alias("stem"), F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise("x").alias("plant_name"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")))
    p = n.select(name.alias("name"), F.col("n_nationkey").alias("ord")).union(g.select(F.substring(F.lower("r_name"), 1, 2), 100 + F.col("r_regionkey")))
    return traits.match_profile(i, p)


@query(
    """select c.image_no, c.line_id, k.box_id from (select image_no, box_id as line_id, x1 as px, y1 as py from box where box_id <= 2) c left join lateral (select box_id from box b where b.image_no = c.image_no and b.box_id > 2 and
      ((b.x1 + b.x2) / 2 - px) * ((b.x1 + b.x2) / 2 - px) + ((b.y1 + b.y2) / 2 - py) * ((b.y1 + b.y2) / 2 - py) <= 40000 order by ((b.x1 + b.x2) / 2 - px) * ((b.x1 + b.x2) / 2 - px) + ((b.y1 + b.y2) / 2 - py) * ((b.y1 + b.y2) / 2 - py), box_id limit 1) k on true""",
    "box",
)
def nearest_kernel(spark, d):
    """A calibration line's nearest object within 200 px, one aggregate per line."""
    b = fx.box(spark, d)
    lines = b.where("box_id <= 2").select("image_no", F.col("box_id").alias("line_id"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    c = b.where("box_id > 2").select("image_no", "box_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return boxes.nearest_within(lines, c, 200.0)


@query("select o_orderkey, coalesce(a.p_name, b.p_name) as mask from orders left join part a on a.p_partkey = o_orderkey and o_orderkey % 2 = 0 left join part b on b.p_partkey = o_orderkey + 1")
def fallback_match(spark, d):
    """By exact name, else by stem."""
    o, p = fx.table(spark, d, "orders"), fx.table(spark, d, "part").select("p_partkey", "p_name")
    a, b = p.select(F.col("p_partkey").alias("ka"), F.col("p_name").alias("na")), p.select(F.col("p_partkey").alias("kb"), F.col("p_name").alias("nb"))
    j = o.join(a, (F.col("ka") == F.col("o_orderkey")) & (F.col("o_orderkey") % 2 == 0), "left").join(b, F.col("kb") == F.col("o_orderkey") + 1, "left")
    return j.select("o_orderkey", F.coalesce("na", "nb").alias("mask"))


@query("select n_name, row_number() over (order by case when n_nationkey % 3 = 0 then n_nationkey end asc nulls last, n_name) as place from nation")
def label_upsert_order(spark, d):
    """Rows in a list's order, unlisted ones last."""
    n = fx.table(spark, d, "nation")
    out = traits.upsert_in_order(n.select("n_name"), n.where("n_nationkey % 3 = 0").select("n_name", F.col("n_nationkey").alias("ord")), "n_name")
    return out.select("n_name", F.col("place").cast("long").alias("place"))


@query("select image_no, weight_text from image qualify row_number() over (partition by image_no order by seq desc) = 1", "image")
def last_label_wins(spark, d):
    """Of repeated rows the last wins."""
    return traits.last_per_key(fx.image(spark, d), "image_no", "seq").select("image_no", "weight_text")


@query("select n_nationkey, coalesce(k.c, 0) as raw, coalesce(k.f, 0) as filtered from (select n_nationkey from nation union all select n_nationkey + 100 from nation) left join (select c_nationkey, count(*) as c, count(*) filter (c_acctbal < 0) as f from customer group by 1) k on c_nationkey = n_nationkey")
def empty_image_rows(spark, d):
    """Images without any row have zero counts."""
    n = fx.table(spark, d, "nation").select("n_nationkey")
    n = n.unionByName(n.select((F.col("n_nationkey") + 100).alias("n_nationkey")))  # keys that no customer has
    k = fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("raw"), F.count_if(F.col("c_acctbal") < 0).alias("filtered"))
    return n.join(k, "n_nationkey", "left").na.fill(0)


@query("select image_name, min(kernel_id) as first_seen, count(*) as n from kernel group by 1", "kernel")
def first_seen_images(spark, d):
    """G36."""
    return fx.kernel(spark, d).groupBy("image_name").agg(F.min("kernel_id").alias("first_seen"), F.count("*").alias("n"))


# Profiles: G2, G6, G7, G13, W8, X43-X51.
_POS = "pos as (select vec_id, label, i - 1 as pos, w[i] as v from profile, range(1, 65) t(i))"


@query(f""", {_POS} select label, pos::integer as pos, {r("median(v)")} as value from pos group by label, pos""", "profile")
def profile_median(spark, d):
    return rounded(stats.element_median(fx.profile(spark, d), "label", "w"))


@query(
    f"""select vec_id, {r("w[floor(0.25 * 63)::int + 1]")} as w25, {r("w[floor(0.5 * 63)::int + 1]")} as w50, {r("w[floor(0.75 * 63)::int + 1]")} as w75, {r("list_max(w)")} as most, {r("100 * (list_position(w, list_max(w)) - 1) / 63.0::double")} as at_percent from profile""",
    "profile",
)
def profile_quartile_widths(spark, d):
    w = F.col("w")
    return rounded(fx.profile(spark, d).select("vec_id", *[prof.at_fraction(w, f).alias(n) for f, n in ((0.25, "w25"), (0.5, "w50"), (0.75, "w75"))], F.array_max(w).alias("most"), prof.peak_percent(w).alias("at_percent")))


@query(f""", {_POS} select vec_id, pos::integer as pos, {r("v * 100 / 640.0::double")} as value from pos""", "profile")
def profile_normalised(spark, d):
    p = fx.profile(spark, d).select("vec_id", prof.to_axis(F.col("w"), F.lit(640.0)).alias("w"))
    return rounded(p.select("vec_id", F.posexplode("w").alias("pos", "value")))


def _gauss() -> str:
    import math

    g = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7)]
    return " + ".join(f"{x / sum(g)!r}::double * w[greatest(1, least(64, i + {k}))]" for k, x in zip(range(-6, 7), g, strict=True))


@query(f"""select vec_id, (i - 1)::integer as pos, {r(f"case when i in (1, 64) then w[i] else {_gauss()} end")} as value from profile, range(1, 65) t(i)""", "profile")
def profile_smoothed(spark, d):
    return rounded(fx.profile(spark, d).select("vec_id", F.posexplode(prof.gaussian(F.col("w"))).alias("pos", "value")))


@query("select vec_id from profile where not len(list_filter(w, lambda x: x - 15 <= 0)) / len(w)::double > 0.1", "profile")
def degenerate_filter(spark, d):
    """F9."""
    return fx.profile(spark, d).where(~prof.mostly_empty(F.transform("w", lambda x: x - 15))).select("vec_id")


_MID = f"{_POS}, mid as (select label, pos, median(v) as m from pos group by label, pos)"
_RMSE = f"{_MID}, err as (select vec_id, label, sqrt(sum((v / 2 - m / 2) * (v / 2 - m / 2)) / 64) as rmse from pos join mid using (label, pos) group by vec_id, label)"


@query(
    f""", {_RMSE}, f as (select label, quantile_cont(rmse, 0.75) + 1.5 * (quantile_cont(rmse, 0.75) - quantile_cont(rmse, 0.25)) as high, quantile_cont(rmse, 0.25) - 1.5 * (quantile_cont(rmse, 0.75) - quantile_cont(rmse, 0.25)) as low from err group by label)
    select vec_id, label, {r("rmse")} as rmse, rmse < low or rmse > high as outlier from err join f using (label)""",
    "profile",
)
def kernel_rmse_outliers(spark, d):
    """Distance of each half profile from its group's median, and the outliers among them."""
    p = fx.profile(spark, d)
    mid = stats.gathered(stats.element_median(p, "label", "w"), "label", "m")
    half = lambda c: F.transform(c, lambda x: x / 2)
    e = p.join(mid, "label").select("vec_id", "label", prof.rmse(half("w"), half("m")).alias("rmse"))
    return rounded(stats.with_outliers(e, ["label"], "rmse").select("vec_id", "label", "rmse", "outlier"))


@query(f""", {_MID} select vec_id, {r("sum(least(v, m)) / sum(greatest(v, m))")} as iou from pos join mid using (label, pos) group by vec_id""", "profile")
def profile_iou(spark, d):
    p = fx.profile(spark, d)
    mid = stats.gathered(stats.element_median(p, "label", "w"), "label", "m")
    return rounded(p.join(mid, "label").select("vec_id", prof.iou(F.col("w"), F.col("m")).alias("iou")))


@query(f""", {_POS}, s as (select pos, avg(v) as m, stddev_pop(v) as sd from pos group by pos) select vec_id, pos::integer as pos, {r("(v - m) / case when sd < 1e-8 then 1 else sd end", 5)} as value from pos join s using (pos)""", "profile")
def profile_standardised(spark, d):
    """G13, X47."""
    p = fx.profile(spark, d)
    long = p.select(F.posexplode("w").alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    arrays = long.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("a")).select(F.col("a.m").alias("m"), F.col("a.s").alias("s"))  # one row per position of a profile
    out = p.crossJoin(F.broadcast(arrays)).select("vec_id", F.posexplode(prof.standardise(F.col("w"), F.col("m"), F.col("s"))).alias("pos", "value"))
    return rounded(out, 5)


@query(f"""select vec_id, (i - 1)::integer as pos, {r("case when i <= 64 then w[i] / 2 else -w[129 - i] / 2 end")} as x, {r("case when i <= 64 then (i - 1) / 63.0::double else (128 - i) / 63.0::double end")} as y from profile, range(1, 129) t(i)""", "profile")
def profile_outline(spark, d):
    """X48."""
    p = fx.profile(spark, d).select("vec_id", F.posexplode(prof.outline(F.col("w"))).alias("pos", "p"))
    return rounded(p.select("vec_id", "pos", "p.x", "p.y"))


@query(f"""select vec_id, {r("list_sum(list_sort(w)[1:58]) / 58")} as value from profile""", "profile")
def trimmed_mean(spark, d):
    """Without a tenth of the greatest values."""
    return rounded(fx.profile(spark, d).select("vec_id", prof.trimmed_mean(F.col("w"), 0.1).alias("value")))


@query(
    f"""with recursive s as (select vec_id, 1 as i, w[1] as y, w from (select vec_id, list_transform(embedding, lambda x: 20 * (1 + x::double)) as w from embeddings) union all select vec_id, i + 1, 0.72::double * y + (1 - 0.72::double) * w[i + 1], w from s where i < 64)
    select vec_id, {r("y")} as last from s where i = 64"""
)
def exponential_smoothing(spark, d):
    """W13."""
    return rounded(fx.profile(spark, d).select("vec_id", F.element_at(prof.exponential(F.col("w")), -1).alias("last")))


# Statistics: G10-G38 without G26, W3-W15 without W11 and W12, U1-U9.
@query(
    f"""select label, {r("q1")} as q1, {r("q2")} as q2, {r("q3")} as q3, {r("q3 - q1")} as iqr, {r("q1 - 1.5 * (q3 - q1)")} as low, {r("q3 + 1.5 * (q3 - q1)")} as high from
    (select l_returnflag as label, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as q2, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1)"""
)
def trait_iqr_fences(spark, d):
    """G15."""
    return rounded(stats.fences(fx.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label"), ["label"], "l_extendedprice"))


@query(
    f""", {_RMSE}, q as (select label, quantile_cont(rmse, 0.25) as q1, quantile_cont(rmse, 0.5) as q2, quantile_cont(rmse, 0.75) as q3 from err group by label)
    select label, count(*) as n, {r("avg(rmse)")} as mean, {r("stddev_pop(rmse)")} as std, {r("min(rmse)")} as least, {r("any_value(q1)")} as q1, {r("any_value(q2)")} as q2, {r("any_value(q3)")} as q3, {r("max(rmse)")} as most, {r("any_value(q3 - q1)")} as iqr,
      count(*) filter (rmse < q1 - 1.5 * (q3 - q1) or rmse > q3 + 1.5 * (q3 - q1)) as outliers, {r("100 * count(*) filter (rmse < q1 - 1.5 * (q3 - q1) or rmse > q3 + 1.5 * (q3 - q1)) / count(*)::double")} as outlier_percent from err join q using (label) group by label""",
    "profile",
)
def metric_summary(spark, d):
    """G16 over X44."""
    p = fx.profile(spark, d)
    mid = stats.gathered(stats.element_median(p, "label", "w"), "label", "m")
    half = lambda c: F.transform(c, lambda x: x / 2)
    return rounded(stats.summary(p.join(mid, "label").select("label", prof.rmse(half("w"), half("m")).alias("rmse")), ["label"], "rmse"))


_ERR = "err as (select *, abs(fmod(fmod(pred - true_ + 180, 360::double) + 360, 360::double) - 180) as e from angle)"


@query(f""", {_ERR} select l_orderkey, {r("pred")} as pred, {r("e")} as error, {r("cos(radians(pred)) * cos(radians(true_)) + sin(radians(pred)) * sin(radians(true_))", 5)} as cosine from err""", "angle")
def angle_error(spark, d):
    """X33, X36, R11."""
    a = fx.angle(spark, d)
    p, t = F.radians("pred"), F.radians("true")
    return rounded(a.select("l_orderkey", F.round("pred", 6).alias("pred"), num.directed_gap(F.col("pred"), F.col("true")).alias("error"), F.round(F.cos(p) * F.cos(t) + F.sin(p) * F.sin(t), 5).alias("cosine")))


@query(
    f""", {_ERR} select model, count(*) as n, {r("avg(e)")} as mean, {r("quantile_cont(e, 0.5)")} as p50, {r("quantile_cont(e, 0.9)")} as p90, {r("quantile_cont(e, 0.95)")} as p95, {r("quantile_cont(e, 0.99)")} as p99, {r("max(e)")} as most, {r("avg((e < 5)::int)")} as within_5, {r("avg((e < 10)::int)")} as within_10 from err group by model""",
    "angle",
)
def error_summary(spark, d):
    """G17, G18."""
    a = fx.angle(spark, d).select("model", num.directed_gap(F.col("pred"), F.col("true")).alias("e"))
    return rounded(stats.error_summary(a, ["model"], "e"))


@query(f""", {_ERR} select b as bin, coalesce(n, 0) as n, {r("coalesce(mean, 0)")} as mean, {r("coalesce(std, 0)")} as std from range(12) t(b) left join (select floor(true_ / 30)::bigint as b, count(*) as n, avg(e) as mean, stddev_pop(e) as std from err group by 1) using (b)""", "angle")
def angle_bins(spark, d):
    """G19."""
    a = fx.angle(spark, d).select("true", num.directed_gap(F.col("pred"), F.col("true")).alias("e"))
    return rounded(stats.binned(a, "true", "e"))


@query(f""", {_ERR}, m as (select min(e) as lo, max(e) as hi from err) select least(floor((e - lo) / ((hi - lo) / 40)), 39)::bigint as bin, count(*) as n from err, m group by 1""", "angle")
def error_histogram(spark, d):
    """G20."""
    return stats.histogram(fx.angle(spark, d).select(num.directed_gap(F.col("pred"), F.col("true")).alias("e")), "e", 40)


@query(f"""select l_quantity as v, {r("sum(count(*)) over (order by l_quantity) / sum(count(*)) over ()")} as share from lineitem group by l_quantity""")
def error_cdf(spark, d):
    """Counts per value first, so the ordered window holds distinct values only."""
    return rounded(stats.distribution(fx.table(spark, d, "lineitem").select(F.col("l_quantity").alias("v")), "v"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i:]]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})', 4)} as r from lineitem" for a, b in _PAIRS))
def corr_matrix(spark, d):
    """G22, G25."""
    return rounded(stats.correlations(fx.table(spark, d, "lineitem"), _COLS))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'covar_samp({a}, {b})', 4)} as cov from lineitem" for a, b in _PAIRS))
def covariance(spark, d):
    """G30."""
    return rounded(stats.covariances(fx.table(spark, d, "lineitem"), _COLS), 4)


_LOAD = "load as (select d - 1 as dim, p - 1 as pos, corr(embedding[d]::double, embedding[p + 5]::double) as r from embeddings, range(1, 6) t(d), range(1, 60) u(p) group by d, p)"


def _latent(spark, d):
    e = fx.table(spark, d, "embeddings")
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("key"), "label", as_double(F.slice("embedding", 1, 5)).alias("z"), as_double(F.slice("embedding", 6, 59)).alias("w"))


@query(f"with {_LOAD} select dim::integer as dim, pos::integer as pos, {r('r')} as r from load")
def latent_loadings(spark, d):
    """G23."""
    return rounded(stats.loadings(_latent(spark, d), "z", "w"))


@query(f"with {_LOAD} select dim::integer as dim, pos::integer as pos, {r('r')} as r from load qualify row_number() over (partition by dim order by abs(r) desc, pos) = 1")
def strongest_loading(spark, d):
    """G24."""
    return rounded(stats.strongest(stats.loadings(_latent(spark, d), "z", "w")))


@query(f"select l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)', 4)} as slope, {r('regr_intercept(l_extendedprice, l_quantity)', 3)} as intercept, {r('regr_r2(l_extendedprice, l_quantity)')} as r2, count(*) as n from lineitem group by 1")
def linear_fit(spark, d):
    """G27."""
    f = stats.linear_fit(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(f.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "r2", "n"))


@query(
    """with s as (select l_quantity / 4.0::double as sx, l_discount * 100 / (4.0::double * 1.7320508075688772::double) as sy from lineitem), c as (select *, floor(sx + 0.5) as ax, floor(sy + 0.5) as ay, floor(sx) as bx, floor(sy) as by_ from s),
    h as (select case when (sx - ax) * (sx - ax) + 3 * (sy - ay) * (sy - ay) <= (sx - bx - 0.5) * (sx - bx - 0.5) + 3 * (sy - by_ - 0.5) * (sy - by_ - 0.5) then 2 * ax else 2 * bx + 1 end::bigint as hx,
      case when (sx - ax) * (sx - ax) + 3 * (sy - ay) * (sy - ay) <= (sx - bx - 0.5) * (sx - bx - 0.5) + 3 * (sy - by_ - 0.5) * (sy - by_ - 0.5) then 2 * ay else 2 * by_ + 1 end::bigint as hy from c) select hx, hy, count(*) as n from h group by 1, 2"""
)
def hexbin(spark, d):
    """G28."""
    li = fx.table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("y"))
    return stats.hexagons(li, "l_quantity", "y", 4.0)


@query(f"select 0.0::double + 2.0::double * i as at, {r('sum(exp(-0.5 * ((0.0::double + 2.0::double * i - l_quantity) / 2) * ((0.0::double + 2.0::double * i - l_quantity) / 2))) / (count(*) * 2.0::double * sqrt(2 * 3.141592653589793::double))')} as density from lineitem, range(26) t(i) group by i")
def kernel_density(spark, d):
    """G29."""
    return rounded(stats.density(fx.table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 0.0, 50.0, 26, 2.0))


@query(f"with s as (select l_partkey % 50 as key, l_suppkey % 4 as dim, max(l_discount) - min(l_discount) as span from lineitem group by 1, 2) select dim, {r('median(span)')} as median_span, median(span) < 0.5 as collapsed from s group by dim")
def latent_span_collapse(spark, d):
    """G33."""
    li = fx.table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("key"), (F.col("l_suppkey") % 4).alias("dim"), F.col("l_discount").alias("value"))
    return rounded(stats.collapsed(li))


@query(f"select d - 1 as dim, {r('min(embedding[d]::double)')} as least, {r('median(embedding[d]::double)')} as middle, {r('max(embedding[d]::double)')} as most from embeddings, range(1, 6) t(d) group by d")
def latent_summary(spark, d):
    """G31, G32."""
    long = _latent(spark, d).select(F.posexplode("z").alias("dim", "v"))
    return rounded(long.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.min("v").alias("least"), F.median("v").alias("middle"), F.max("v").alias("most")))


@query(
    f"""select key, dim::integer as dim, step::integer as step, {r("-top + 2 * top * step / 6.0::double")} as value from (select vec_id as key, d - 1 as dim, case when abs(embedding[d]::double) < 1e-6 then 1 else 3 * abs(embedding[d]::double) end as top from embeddings, range(1, 6) t(d)), range(7) u(step)"""
)
def latent_sweep(spark, d):
    """U9."""
    return rounded(stats.sweep(_latent(spark, d), "z"))


@query(
    """with f as (select vec_id, case when x >= 0 and y >= 0 then 1 when x < 0 and y >= 0 then 2 when x < 0 and y < 0 then 3 else 4 end as quadrant, sqrt(x * x + y * y) as dist from (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)) select vec_id, quadrant from f qualify rank() over (partition by quadrant order by dist desc) = 1"""
)
def quadrant_extremes(spark, d):
    """W5, X40."""
    e = _latent(spark, d).select(F.col("key").alias("vec_id"), F.col("z")[0].alias("x"), F.col("z")[1].alias("y"))
    return stats.quadrant_extremes(e, "x", "y").select("vec_id", "quadrant")


@query(
    """with c as (select vec_id, embedding[2]::double as y from embeddings order by abs(embedding[1]::double), vec_id limit 20) select vec_id, 'high' as side from (select *, rank() over (order by y desc) as k from c) where k = 1 union all select vec_id, 'low' from (select *, rank() over (order by y) as k from c) where k = 1"""
)
def axis_extremes(spark, d):
    """W6."""
    e = _latent(spark, d).select(F.col("key").alias("vec_id"), F.col("z")[0].alias("x"), F.col("z")[1].alias("y"))
    return stats.axis_extremes(e, "x", "y", "vec_id").select("vec_id", "side")


@query("select vec_id, 'pc1' as component, embedding[1]::double as loading from embeddings union all select vec_id, 'pc2', embedding[2]::double from embeddings")
def unpivot_loadings(spark, d):
    """U2."""
    e = _latent(spark, d).select(F.col("key").alias("vec_id"), F.col("z")[0].alias("pc1"), F.col("z")[1].alias("pc2"))
    return e.unpivot("vec_id", ["pc1", "pc2"], "component", "loading")


@query("select p_partkey, min_by(p_name, t) as p_name from (select p_partkey, p_name, 0 as t from part where p_size < 20 union all select p_partkey, 'second', 1 from part where p_size < 40) group by 1")
def union_distinct_first(spark, d):
    """U1, U4."""
    p = fx.table(spark, d, "part")
    return stats.union_first(p.where("p_size < 20").select("p_partkey", "p_name"), p.where("p_size < 40").select("p_partkey", F.lit("second").alias("p_name")), "p_partkey")


@query(f"""select image_no, candidate, rank, {r("case when rank = 1 then next - score end")} as margin from (select *, row_number() over w as rank, lead(score) over w as next from (select l_orderkey as image_no, row_number() over (partition by l_orderkey order by {fx._L}) as candidate, l_discount + l_tax as score, l_quantity as length from lineitem) window w as (partition by image_no order by score, length desc, candidate))""")
def candidate_rank(spark, d):
    """W3, W4, R3."""
    k = fx.table(spark, d, "lineitem")
    k = k.withColumn("candidate", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*fx._ORDER)).cast("long"))
    k = k.select(F.col("l_orderkey").alias("image_no"), "candidate", (F.col("l_discount") + F.col("l_tax")).alias("score"), F.col("l_quantity").alias("length"))
    return rounded(stats.rank_candidates(k, "image_no").select("image_no", "candidate", "rank", "margin"))


@query("select l_orderkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey limit 5")
def top5_worst(spark, d):
    """The five greatest, a report by nature."""
    return fx.table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey").limit(5).select("l_orderkey", "l_extendedprice")


@query("""with s as (select *, row_number() over (order by md5('42' || vec_id), vec_id) as k, count(*) over () as n from embeddings) select vec_id, case when k <= greatest(1, floor(n * 0.8::double)) then 'train' when k <= greatest(1, floor(n * 0.8::double)) + greatest(1, floor(n * 0.1::double)) then 'val' else 'test' end as split from s""")
def train_split(spark, d):
    """Membership by hash, so a set is the same on every run."""
    return stats.split_sets(fx.table(spark, d, "embeddings").select("vec_id"), "vec_id", (0.8, 0.1), "42").select("vec_id", "split")


@query("""with s as (select *, row_number() over (order by md5('7' || vec_id), vec_id) as k, count(*) over () as n from embeddings) select vec_id, case when k <= n - greatest(1, round_even(n * 0.2::double, 0)) - greatest(1, round_even(n * 0.1::double, 0)) then 'train' when k <= n - greatest(1, round_even(n * 0.1::double, 0)) then 'val' else 'test' end as split from s""")
def rounded_split(spark, d):
    """U7."""
    return stats.split_sets(fx.table(spark, d, "embeddings").select("vec_id"), "vec_id", (0.7, 0.2), "7", rounded=True).select("vec_id", "split")


@query(f"""with e as (select o_custkey as step, min(o_totalprice) as loss from orders group by 1), b as (select step, loss, min(loss) over (order by step) as best from e) select step, {r("loss", 4)} as loss, {r("best", 4)} as best, step - min(step) over (partition by best) as stall from b""")
def early_stop(spark, d):
    """W14."""
    e = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("step")).agg(F.min("o_totalprice").alias("loss"))
    return rounded(stats.running_best(e, "step", "loss").select("step", "loss", "best", "stall"), 4)


@query(f"""select o_orderpriority, {r("sum(o_totalprice * n) / sum(n)", 4)} as weighted, {r("avg(o_totalprice)", 4)} as plain from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey group by 1""")
def weighted_loss(spark, d):
    """G35, W15, G38."""
    n = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = fx.table(spark, d, "orders").join(n, "o_orderkey")
    return rounded(j.groupBy("o_orderpriority").agg((F.sum(F.col("o_totalprice") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg("o_totalprice").alias("plain")), 4)


# Text: X1-X17.
@query("""select kernel_name, regexp_extract(regexp_replace(kernel_name, '\\.[^.]*$', ''), '^(.*)_kernel_(\\d+)$', 1) as stem, cast(regexp_extract(kernel_name, '_kernel_(\\d+)\\.', 1) as bigint) as number, regexp_replace(kernel_name, '_kernel_\\d+', '') as image_name, 'kernel_' || printf('%03d', kernel_id) as short from kernel""", "kernel")
def kernel_identity(spark, d):
    """X1-X5, J18."""
    n = F.col("kernel_name")
    return fx.kernel(spark, d).select("kernel_name", tx.kernel_stem(n).alias("stem"), tx.kernel_number(n).alias("number"), tx.image_of_kernel(n).alias("image_name"), tx.short_id(n, F.col("stem")).alias("short"))


def _norm(c: str) -> str:
    step = f"replace(upper(trim({c})), 'O', '0')"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({step}, 'C([0-9])', '0\\1', 'g'), 'C([0-9])', '0\\1', 'g'), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_LABELS = f"labelled as (select *, {_norm('raw')} as label from texts), graded as (select *, length(regexp_replace(label, '[^-]', '', 'g')) as h, length(regexp_replace(label, '[^A-Z0-9]', '', 'g')) as a from labelled)"


@query(f", {_LABELS} select p_partkey, label, h >= 2 and a >= 8 as valid from graded", "text")
def label_normalise(spark, d):
    """X7, F18."""
    t = fx.text(spark, d).withColumn("label", tx.normalise_label(F.col("raw")))
    return t.select("p_partkey", "label", tx.label_valid(F.col("label")).alias("valid"))


@query(f", {_LABELS} select image_no, label, {r('100 * conf + 12 * h + a + case when h >= 2 and a >= 8 then 20 else 0 end')} as score from graded where h >= 2 and a >= 8 qualify row_number() over (partition by image_no order by 100 * conf + 12 * h + a + case when h >= 2 and a >= 8 then 20 else 0 end desc, p_partkey) = 1", "text")
def label_best(spark, d):
    """X8, W4."""
    t = fx.text(spark, d).withColumn("label", tx.normalise_label(F.col("raw")))
    t = t.withColumn("score", tx.label_score(F.col("label"), F.col("conf"))).where("score is not null")
    return rounded(traits.one_per_key(t, "image_no", [F.desc("score"), F.col("p_partkey")]).select("image_no", "label", "score"))


_RAW = "case when o_orderkey % 23 = 0 then (o_orderkey % 90) || '-3.' || (o_orderkey % 9) when o_orderkey % 29 = 0 then (o_orderkey % 90) || '.5-' else case o_orderkey % 5 when 0 then 'W: ' || o_orderkey || '.2S g' when 1 then 'O' || (o_orderkey % 100) || ',5' when 2 then '-' || (o_orderkey % 1000) || '.4.1' when 3 then (10000 + o_orderkey % 90000) || '' else (o_orderkey % 300) || '.' || (10 + o_orderkey % 90) end end"
_CLEAN = "regexp_replace(translate(raw, 'OoIl|BS,:;', '0011185...'), '[^0-9.\\-]', '', 'g')"
_WEIGHT = f"""wr as (select o_orderkey, {_RAW} as raw from orders), wc as (select o_orderkey, {_CLEAN} as c from wr), wd as (select o_orderkey, case when contains(c, '-') then '-' else '' end as m, replace(c, '-', '') as c from wc),
    wn as (select o_orderkey, m || case when instr(c, '.') > 0 then substr(c, 1, instr(c, '.')) || replace(substr(c, instr(c, '.') + 1), '.', '') else c end as text from wd)"""


def _weights(spark, d):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    raw = F.when(k % 23 == 0, F.concat(s(k % 90), F.lit("-3."), s(k % 9))).when(k % 29 == 0, F.concat(s(k % 90), F.lit(".5-"))).when(k % 5 == 0, F.concat(F.lit("W: "), s(k), F.lit(".2S g"))).when(k % 5 == 1, F.concat(F.lit("O"), s(k % 100), F.lit(",5"))).when(k % 5 == 2, F.concat(F.lit("-"), s(k % 1000), F.lit(".4.1"))).when(k % 5 == 3, s(10000 + k % 90000)).otherwise(F.concat(s(k % 300), F.lit("."), s(10 + k % 90)))
    return fx.table(spark, d, "orders").select("o_orderkey", tx.normalise_weight(raw).alias("text"))


@query(f"with {_WEIGHT} select o_orderkey, text from wn")
def weight_normalise(spark, d):
    """X6."""
    return _weights(spark, d)


_CAND = f"""{_WEIGHT}, e as (select o_orderkey, unnest(regexp_extract_all(text, '\\d{{1,3}}\\.\\d{{1,2}}'))::double as value, 'explicit_decimal' as kind from wn),
    i as (select o_orderkey, regexp_replace(text, '\\D', '', 'g')::double / 100 as value, 'inferred_decimal' as kind from wn where regexp_full_match(regexp_replace(text, '\\D', '', 'g'), '\\d{{3,5}}')), c as (select * from e union all select * from i)"""


@query(f"with {_CAND} select o_orderkey, value, kind from c where value between 0.05 and 999.99")
def weight_candidates(spark, d):
    """X10."""
    return _weights(spark, d).select("o_orderkey", F.explode(tx.weight_candidates(F.col("text"), 0.05, 999.99)).alias("c")).select("o_orderkey", "c.value", "c.kind")


@query(
    f"""with {_CAND}, s as (select o_orderkey % 500 as image_no, o_orderkey, value, kind, (o_orderkey % 90) + case kind when 'explicit_decimal' then 25 else 8 end + case o_orderkey % 3 when 0 then 5 when 1 then 2.5::double else 0 end + 10 * case o_orderkey % 2 when 0 then 1 else 0.25::double end as score from c where value between 0.05 and 999.99)
    select image_no, o_orderkey, value, kind, {r("score")} as score from s qualify row_number() over (partition by image_no order by kind, score desc, o_orderkey, value) = 1"""
)
def weight_best(spark, d):
    """X11: numbers with a dot are preferred to inferred ones whatever the score; the first wins ties."""
    k = F.col("o_orderkey")
    c = weight_candidates(spark, d).withColumn("image_no", k % 500)
    source = F.when(k % 3 == 0, "screen_binary").when(k % 3 == 1, "screen_scaled").otherwise("screen")
    c = c.withColumn("score", tx.weight_score(F.col("kind"), (k % 90) / 100, source, F.when(k % 2 == 0, 1.0).otherwise(0.25)))
    c = c.withColumn("score", F.round("score", 6))
    return traits.one_per_key(c, "image_no", [F.col("kind"), F.desc("score"), k, F.col("value")]).select("image_no", "o_orderkey", "value", "kind", "score")


@query(
    f"""with {_CAND}, s as (select o_orderkey % 500 as image_no, o_orderkey, value, kind, (o_orderkey % 90) + case kind when 'explicit_decimal' then 25 else 8 end + 10 + case when o_orderkey % 5 = 0 then 0 else 8 * greatest(-1, 1 - abs((o_orderkey * 7) % 1300 - 400) / 400.0::double) + 6 * ((o_orderkey * 11) % 600) / 600.0::double end as score from c where value between 0.05 and 999.99)
    select image_no, o_orderkey, value, kind, {r("score")} as score from s qualify row_number() over (partition by image_no order by kind, round(score, 6) desc, o_orderkey, value) = 1"""
)
def weight_best_placed(spark, d):
    """X11 with the place of a text: the middle and the lower part of an image count more; where the place isn't known nothing is added."""
    k = F.col("o_orderkey")
    c = weight_candidates(spark, d).withColumn("image_no", k % 500)
    known = lambda v: F.when(k % 5 != 0, v)
    place = (known((k * 7) % 1300), known((k * 11) % 600), F.lit(800), F.lit(600))
    c = c.withColumn("score", F.round(tx.weight_score(F.col("kind"), (k % 90) / 100, F.lit("screen"), F.lit(1.0), place), 6))
    return traits.one_per_key(c, "image_no", [F.col("kind"), F.desc("score"), k, F.col("value")]).select("image_no", "o_orderkey", "value", "kind", "score")


_SEG = "select o_orderkey, (o_orderkey % 97)::double as px, (o_custkey % 89)::double as py, (o_orderkey % 31)::double as ax, (o_custkey % 23)::double as ay, case when o_orderkey % 13 = 0 then (o_orderkey % 31)::double else (o_orderkey % 71)::double end as bx, case when o_orderkey % 13 = 0 then (o_custkey % 23)::double else (o_custkey % 53)::double end as by_ from orders"


@query(
    f"""with s as ({_SEG}), t as (select *, case when bx = ax and by_ = ay then 0 else greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) end as f from s)
    select o_orderkey, {r("sqrt((px - ax - f * (bx - ax)) * (px - ax - f * (bx - ax)) + (py - ay - f * (by_ - ay)) * (py - ay - f * (by_ - ay)))", 5)} as distance from t"""
)
def segment_distance(spark, d):
    """Distance of a point from a segment, also from one without a length."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dot = k % 13 == 0
    b = [F.when(dot, k % 31).otherwise(k % 71).cast("double"), F.when(dot, c % 23).otherwise(c % 53).cast("double")]
    far = num.point_to_segment((k % 97).cast("double"), (c % 89).cast("double"), (k % 31).cast("double"), (c % 23).cast("double"), *b)
    return rounded(fx.table(spark, d, "orders").select("o_orderkey", far.alias("distance")), 5)


@query(
    f"""select vec_id, (k - 1)::integer as pos, {r("case when k in (1, 64) then 0 when k in (65, 128) then 0 when k <= 64 then w[k] / 2 else -w[129 - k] / 2 end")} as x, {r("case when k <= 64 then (k - 1) / 63.0::double else (128 - k) / 63.0::double end")} as y from profile, range(1, 129) t(k)""",
    "profile",
)
def closed_outline(spark, d):
    """The symmetric outline of a profile with its tips closed."""
    p = fx.profile(spark, d).select("vec_id", F.posexplode(prof.outline(F.col("w"), closed=True)).alias("pos", "p"))
    return rounded(p.select("vec_id", "pos", "p.x", "p.y"))


@query("select o_orderkey, case when length(x) = 1 then '0.0' || x else substr(x, 1, length(x) - 2) || '.' || right(x, 2) end as weight from (select o_orderkey, cast(o_orderkey % 2000 as varchar) as x from orders)")
def digit_weight(spark, d):
    """X13."""
    return fx.table(spark, d, "orders").select("o_orderkey", tx.digits_to_weight((F.col("o_orderkey") % 2000).cast("string")).alias("weight"))


@query("""select conv_id, turn, case when s = '' then 'UNKNOWN' else s end as name from (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(trim(text), '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as s from conversations)""")
def sanitise_name(spark, d):
    """X14."""
    return fx.table(spark, d, "conversations").select("conv_id", "turn", tx.sanitise(F.col("text")).alias("name"))


@query(f"""select image_no, box_id, {r("x2 - x1")} as w, floor(x1)::bigint || ',' || floor(y1)::bigint || ',' || floor(x2)::bigint || ',' || floor(y2)::bigint as text from box""", "box")
def box_text(spark, d):
    """Boxes to text and back."""
    b = fx.box(spark, d)
    t = tx.format_box(F.array(*[F.floor(c) for c in ("x1", "y1", "x2", "y2")]))
    return rounded(b.select("image_no", "box_id", (F.col("x2") - F.col("x1")).alias("w"), t.alias("text")))


@query("""select image_no, string_agg('src' || (p_partkey % 3) || ':' || p_partkey, ' | ' order by p_partkey) as summary from texts group by image_no""", "text")
def text_summary(spark, d):
    """X12, X16."""
    part = F.format_string("src%d:%d", F.col("p_partkey") % 3, F.col("p_partkey"))
    return fx.text(spark, d).groupBy("image_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", part.alias("t")))), lambda s: s["t"]), " | ").alias("summary"))


# Angles, units, boxes: X22-X42 without X24, X29-X31 and X37.
@query(f"""select l_orderkey, {r("fmod(pred * 3 + 720, 360::double)", 5)} as turned, {r("least(fmod(fmod(pred - true_, 180::double) + 180, 180::double), 180 - fmod(fmod(pred - true_, 180::double) + 180, 180::double))", 5)} as undirected from angle""", "angle")
def angle_normalise(spark, d):
    """X32, X34."""
    return rounded(fx.angle(spark, d).select("l_orderkey", num.turn(F.col("pred") * 3 + 720).alias("turned"), num.undirected_gap(F.col("pred"), F.col("true")).alias("undirected")), 5)


@query(f"""select image_no, box_id, {r("x1 / sqrt(x1 * x1 + y1 * y1)")} as ux, {r("y1 / sqrt(x1 * x1 + y1 * y1)")} as uy from box where x1 * x1 + y1 * y1 > 0""", "box")
def unit_vectors(spark, d):
    """Zero vectors are rejected."""
    b = fx.box(spark, d).withColumn("u", num.unit(F.col("x1"), F.col("y1"))).where("u is not null")
    return rounded(b.select("image_no", "box_id", F.col("u.x").alias("ux"), F.col("u.y").alias("uy")))


@query(f"""select image_no, box_id, {r("350.0::double / nullif((x2 - x1 + y2 - y1) / 2, 0)")} as scale from box""", "box")
def tray_scale(spark, d):
    """X22."""
    return rounded(fx.box(spark, d).select("image_no", "box_id", num.tray_scale(F.lit(350.0), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("scale")))


_T = "(100, 80, 900, 620)"


@query(
    f""", o as (select *, greatest(least(x2, 900) - greatest(x1, 100), 0) * greatest(least(y2, 620) - greatest(y1, 80), 0) / ((x2 - x1) * (y2 - y1)) as share, (x1 + x2) / 2 between 100 and 900 and (y1 + y2) / 2 between 80 and 620 as inside from box)
    select image_no, box_id, {r("share")} as tray_share, not inside or share < 0.55 as outside_tray, {r("greatest(x1, 100)")} as cx1, {r("least(y2, 620)")} as cy2 from o""",
    "box",
)
def box_containment(spark, d):
    """F13, F14, X26."""
    b = fx.box(spark, d).withColumns({"tx1": F.lit(100.0), "ty1": F.lit(80.0), "tx2": F.lit(900.0), "ty2": F.lit(620.0)})
    return rounded(boxes.clip_to_tray(b, ("tx1", "ty1", "tx2", "ty2")).select("image_no", "box_id", "tray_share", "outside_tray", "cx1", "cy2"))


_FLAG = """, g as (select *, (x2 - x1) * (y2 - y1) as area, greatest(x2 - x1, y2 - y1) as l, least(x2 - x1, y2 - y1) as s, greatest(x2 - x1, y2 - y1) > 4 * least(x2 - x1, y2 - y1) as bad_aspect from box),
    m as (select image_no, median(area) filter (not bad_aspect) as ma, median(l) filter (not bad_aspect) as ml, median(s) filter (not bad_aspect) as ms, count(*) filter (not bad_aspect) as active from g group by 1),
    t as (select g.*, coalesce(not bad_aspect and active >= 8 and (area < 0.35 * ma or l < 0.45 * ml or s < 0.45 * ms), false) as too_small, coalesce(not bad_aspect and active >= 8 and (area > 3 * ma or l > 2.2 * ml or s > 2.2 * ms), false) as too_large from g join m using (image_no)),
    f as (select *, too_small or too_large as odd_size from t)"""


@query(f"""{_FLAG} select image_no, box_id, bad_aspect, odd_size, concat_ws(',', case when bad_aspect then 'bad_aspect_ratio' end, case when too_small then 'too_small' end, case when too_large then 'too_large' end) as reasons from f""", "box")
def box_size_outliers(spark, d):
    """F15, F16, F17, G9."""
    return boxes.flag_sizes(fx.box(spark, d)).select("image_no", "box_id", "bad_aspect", "odd_size", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{_FLAG} select image_no, count(*) as raw, count(*) filter (bad_aspect) as bad_aspect, count(*) filter (odd_size) as odd_size, count(*) filter (not bad_aspect and not odd_size) as accepted from f group by 1""", "box")
def box_summary(spark, d):
    """G10, G11, R2, K6."""
    b = boxes.flag_sizes(fx.box(spark, d))
    return b.groupBy("image_no").agg(F.count("*").alias("raw"), F.count_if("bad_aspect").alias("bad_aspect"), F.count_if("odd_size").alias("odd_size"), F.count_if("kept").alias("accepted"))


@query(f"""{_FLAG} select image_no, box_id, case when not bad_aspect and not odd_size then sum((not bad_aspect and not odd_size)::int) over (partition by image_no order by y1, x1, box_id)::bigint end as final_id from f""", "box")
def kernel_ids(spark, d):
    """W2."""
    return boxes.final_ids(boxes.flag_sizes(fx.box(spark, d)), [F.col("y1"), F.col("x1"), F.col("box_id")]).select("image_no", "box_id", "final_id")


_PAIR = """, pairs as (select a.image_no, a.box_id as a, b.box_id as b, (a.x2 - a.x1) * (a.y2 - a.y1) as sa, (b.x2 - b.x1) * (b.y2 - b.y1) as sb, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i
    from box a join box b on a.image_no = b.image_no and a.box_id < b.box_id and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2),
    nested as (select image_no, a, b, i / least(sa, sb) as overlap, greatest(sa, sb) / least(sa, sb) as ratio, case when sa >= sb then a else b end as larger from pairs where i / least(sa, sb) >= 0.86 and greatest(sa, sb) / least(sa, sb) >= 1.15)"""


@query(
    f""", li as (select image_no, list({{'n': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) as bs from box group by 1), fi as (select image_no, bs, unnest(bs) as a from li), pr as (select image_no, a, unnest(bs) as b from fi),
    ov as (select image_no, a.n as a_box_id, b.n as b_box_id, (a.x2 - a.x1) * (a.y2 - a.y1) as sa, (b.x2 - b.x1) * (b.y2 - b.y1) as sb, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i from pr where a.n < b.n and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2)
    select image_no, a_box_id, b_box_id, {r("i / least(sa, sb)")} as overlap, {r("greatest(sa, sb) / least(sa, sb)")} as ratio, case when sa >= sb then a_box_id else b_box_id end as larger from ov where i / least(sa, sb) >= 0.86 and greatest(sa, sb) / least(sa, sb) >= 1.15""",
    "box",
)
def box_overlap_pairs(spark, d):
    """J12, T4, X28."""
    return rounded(boxes.overlap_pairs(fx.box(spark, d)).select("image_no", "a_box_id", "b_box_id", "overlap", "ratio", "larger"))


@query("""select a.image_no, a.box_id, count(*) as centres from box a join box b on a.image_no = b.image_no and a.box_id <> b.box_id and (b.x1 + b.x2) / 2 between a.x1 and a.x2 and (b.y1 + b.y2) / 2 between a.y1 and a.y2 group by 1, 2 having count(*) >= 2""", "box")
def box_multi_center(spark, d):
    """J13."""
    return boxes.holding_centres(fx.box(spark, d))


#: Folds over ordered lists: what is gone grows by the third of each list whose first two are both still there.
_FOLD = "lambda g, p: case when list_contains(g, p[1]) or list_contains(g, p[2]) then g else list_append(g, p[3]) end"
_ODD = "abs(ln({0}.area / m.ma)) + 0.45::double * (abs(ln({0}.l / m.ml)) + abs(ln({0}.s / m.ms))) - 0.25::double * {0}.conf"
#: Greedy suppression over boxes sz (with area, long side l and short side s) and median sizes m (image_no, ma, ml, ms): g1 what nested pairs delete, g2 with fused boxes too.
GREEDY = f"""np as (select a.image_no, a.box_id as a, b.box_id as b, ma, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(least(a.area, b.area), 1) as overlap, greatest(a.area, b.area) / greatest(least(a.area, b.area), 1) as ratio, least(a.area, b.area) as lesser, greatest(a.area, b.area) as greater,
      case when a.area <= b.area then a.box_id else b.box_id end as small, case when a.area <= b.area then b.box_id else a.box_id end as large, {_ODD.format("a")} as odd_a, {_ODD.format("b")} as odd_b, a.conf as conf_a, b.conf as conf_b
      from sz a join sz b on a.image_no = b.image_no and a.box_id < b.box_id and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 join m on m.image_no = a.image_no),
    worse as (select *, case when lesser < 0.35 * ma then small when greater > 3 * ma then large when abs(odd_a - odd_b) > 0.05 then case when odd_a > odd_b then a else b end when abs(conf_a - conf_b) > 0.05 then case when conf_a < conf_b then a else b end else large end as w from np where overlap >= 0.86 and ratio >= 1.15),
    g1 as (select m.image_no, list_reduce(list_concat([[]::bigint[]], coalesce(list([a, b, w] order by overlap desc, ratio desc, a, b) filter (a is not null), [])), {_FOLD}) as g from m left join worse using (image_no) group by 1),
    big as (select a.image_no, a.box_id, a.area, list(b.box_id) as inside from sz a join sz b on a.image_no = b.image_no and a.box_id <> b.box_id and (b.x1 + b.x2) / 2 between a.x1 and a.x2 and (b.y1 + b.y2) / 2 between a.y1 and a.y2 join m on m.image_no = a.image_no and a.area >= 1.25 * ma group by 1, 2, 3),
    g2 as (select g1.image_no, list_reduce(list_concat([any_value(g)], coalesce(list(list_concat([box_id], inside) order by area desc, box_id) filter (box_id is not null), [])), lambda g, p: case when list_contains(g, p[1]) then g when len(list_filter(p[2:], lambda x: not list_contains(g, x))) >= 2 then list_append(g, p[1]) else g end) as g from g1 left join big using (image_no) group by 1)"""
_NESTED = f""", sz as (select *, (x2 - x1) * (y2 - y1) as area, greatest(x2 - x1, y2 - y1) as l, least(x2 - x1, y2 - y1) as s from box), m as (select image_no, median(area) as ma, median(l) as ml, median(s) as ms from sz group by 1), {GREEDY}"""


@query(f"{_NESTED} select image_no, unnest(g) as box_id from g2", "box")
def nested_suppression(spark, d):
    """M11."""
    return boxes.suppress_nested(fx.box(spark, d)).select("image_no", "box_id")


#: Rows of boxes c (image_no, box_id, cx, cy, h) as one reads: b has a line for each box t with its row k and that row's mean y.
READ = """r as (select image_no, greatest(10, 0.6 * median(h)) as reach, list([{'total': cy, 'n': 1, 'items': [{'cx': cx, 'id': box_id}]}] order by cy, cx, box_id) as l from c group by 1),
    f as (select image_no, list_reduce(l, lambda m, p: case when list_position(list_transform(m, lambda q: abs(q.total / q.n - p[1].total) <= reach), true) is null then list_concat(m, p)
      else list_transform(m, lambda q, i: case when i = list_position(list_transform(m, lambda z: abs(z.total / z.n - p[1].total) <= reach), true) then {'total': q.total + p[1].total, 'n': q.n + 1, 'items': list_concat(q.items, p[1].items)} else q end) end) as rows from r),
    u as (select image_no, unnest(rows) as q, generate_subscripts(rows, 1) as k from f), b as (select image_no, q.total / q.n as y, k, unnest(q.items) as t from u)"""


@query(
    f""", c as (select image_no, box_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, y2 - y1 as h from box), {READ} select image_no, t.id as box_id, row_number() over (partition by image_no order by y, k, t.cx, t.id) as place from b""",
    "box",
)
def reading_order(spark, d):
    """W1."""
    return boxes.reading_order(fx.box(spark, d))


@query(
    f""", p as (select a.image_no, a.box_id as a, b.box_id as b, case when a.conf >= b.conf then b.box_id else a.box_id end as w from digit a join digit b on a.image_no = b.image_no and a.box_id < b.box_id and greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * 20 / 240 > 0.8),
    g as (select d.image_no, list_reduce(list_concat([[]::bigint[]], coalesce(list([a, b, w] order by a, b) filter (a is not null), [])), {_FOLD}) as g from (select distinct image_no from digit) d left join p using (image_no) group by 1),
    o as (select g.image_no, coalesce(string_agg(digit, '' order by x1, box_id) filter (not list_contains(g, box_id) and digit <> '.'), '') as digits from g join digit using (image_no) group by 1)
    select image_no, digits, case when length(digits) = 1 then '0.0' || digits when length(digits) >= 2 then substr(digits, 1, length(digits) - 2) || '.' || right(digits, 2) end as weight from o""",
    "digit",
)
def digit_reading(spark, d):
    """J14, T5, X13."""
    out = boxes.unique_digits(fx.digit(spark, d))
    return out.select("image_no", "digits", tx.digits_to_weight(F.col("digits")).alias("weight"))


# Polygons: P1-P15 without P6 and P13, X50.
@query(f""", s as (select vec_id, abs(sum(px * qy - qx * py)) / 2 as a, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) as p from edge group by 1) select vec_id, {r("a", 4)} as area, {r("p", 4)} as perimeter, {r("4 * pi() * a / (p * p)")} as circularity from s""", "contour")
def polygon_area_perimeter(spark, d):
    """P1-P3."""
    c = fx.contour(spark, d).select("vec_id", geo.opened(F.col("c")).alias("c"))
    c = c.select("vec_id", geo.area(F.col("c")).alias("area"), geo.perimeter(F.col("c")).alias("perimeter"))
    return c.select("vec_id", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"), F.round(geo.circularity(F.col("area"), F.col("perimeter")), 6).alias("circularity"))


@query(
    f""", a as (select vec_id, sum(px * qy - qx * py) / 2 as a, sum((px + qx) * (px * qy - qx * py)) as sx, sum((py + qy) * (px * qy - qx * py)) as sy from edge group by 1), c as (select vec_id, a, sx / (6 * a) as cx, sy / (6 * a) as cy from a),
    e as (select c.vec_id, a, cx, cy, px - cx as px, py - cy as py, qx - cx as qx, qy - cy as qy from edge join c using (vec_id)),
    m as (select vec_id, any_value(cx) as cx, any_value(cy) as cy, sum((px * px + px * qx + qx * qx) * (px * qy - qx * py)) / 12 / any_value(a) as xx, sum((py * py + py * qy + qy * qy) * (px * qy - qx * py)) / 12 / any_value(a) as yy, sum((px * qy + 2 * px * py + 2 * qx * qy + qx * py) * (px * qy - qx * py)) / 24 / any_value(a) as xy from e group by 1),
    g as (select *, (xx + yy) / 2 as h, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) as q from m)
    select vec_id, {r("cx", 4)} as cx, {r("cy", 4)} as cy, {r("fmod(degrees(0.5 * atan2(2 * xy, xx - yy)) + 180, 180::double)", 3)} as angle, {r("sqrt(greatest(h - q, 0) / (h + q))", 5)} as ratio, {r("sqrt(1 - greatest(h - q, 0) / (h + q))", 4)} as eccentricity from g""",
    "contour",
)
def polygon_moments(spark, d):
    """P4, P5, P7, X38."""
    c = fx.contour(spark, d).withColumn("at", geo.centroid(F.col("c")))
    c = c.withColumn("m", geo.second_moments(F.col("c"), F.col("at"))).withColumn("p", geo.principal(F.col("m")))
    return c.select("vec_id", F.round("at.x", 4).alias("cx"), F.round("at.y", 4).alias("cy"), F.round("p.angle", 3).alias("angle"), F.round("p.ratio", 5).alias("ratio"), F.round(geo.eccentricity(F.col("p.ratio")), 4).alias("eccentricity"))


#: Crossings of a line with a contour, sorted, where one within a pixel of the one before it is averaged into it; and how far apart the outermost are.
MERGED = "list_reduce(list_transform(list_sort(list(hit)), lambda x: [x]), lambda m, h: case when h[1] - m[len(m)] <= 1 then list_concat(m[:len(m) - 1], [(m[len(m)] + h[1]) / 2]) else list_concat(m, h) end)"
EXTENT = "coalesce(case when len(m) >= 2 then m[len(m)] - m[1] end, 0)"


def upright(name: str, fractions: str) -> str:
    """Widths (vec_id, k, width) across the axis from (0, -120) to (0, 120) at fractions of it, in SQL; fractions are rows (k, fr)."""
    return f"""{name}_f as (select vec_id, k, fr from (select distinct vec_id from edge), ({fractions})), {name}_h as (select e.vec_id, k, py + 120 - 240 * fr as s, qy + 120 - 240 * fr as t, px, qx from edge e join {name}_f f using (vec_id)),
    {name}_x as (select vec_id, k, {MERGED} as m from (select vec_id, k, px + (qx - px) * s / (s - t) as hit from {name}_h where (s >= 0) <> (t >= 0)) group by 1, 2), {name} as (select f.vec_id, f.k, {EXTENT} as width from {name}_f f left join {name}_x x on x.vec_id = f.vec_id and x.k = f.k)"""


@query(f""", {upright("u", "select k, k / 99.0::double as fr from range(100) t(k)")} select vec_id, k::integer as pos, {r("width", 4)} as width from u""", "contour")
def width_profile(spark, d):
    """Widths across an upright axis."""
    at = lambda y: F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"))
    c = fx.contour(spark, d).select("vec_id", F.posexplode(geo.width_profile(F.col("c"), at(-120.0), at(120.0))).alias("pos", "width"))
    return rounded(c, 4)


#: Points of a contour as two lists; a place in them counts from 1.
_LISTS = ", l as (select vec_id, list(x order by i) as xs, list(y order by i) as ys from point group by 1)"


@query(
    f"""{_LISTS}, s as (select vec_id, xs, ys, unnest(range(24)) as k from l), a as (select vec_id, k, xs, ys, floor(k * 64 / 24.0::double)::integer as i, (floor(k * 64 / 24.0::double)::integer + 1) % 64 as j, k * 64 / 24.0::double - floor(k * 64 / 24.0::double) as f from s)
    select vec_id, k::integer as pos, {r("xs[i + 1] + f * (xs[j + 1] - xs[i + 1])", 4)} as x, {r("ys[i + 1] + f * (ys[j + 1] - ys[i + 1])", 4)} as y from a""",
    "contour",
)
def outline_resample(spark, d):
    """P14."""
    c = fx.contour(spark, d).select("vec_id", F.posexplode(geo.sampled(F.col("c"), 24)).alias("pos", "p"))
    return rounded(c.select("vec_id", "pos", "p.x", "p.y"), 4)


@query(
    f""", m as (select vec_id, avg(x) as mx, avg(y) as my from point group by 1), q as (select p.vec_id, atan2(y - my, x - mx) as t, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) as r from point p join m using (vec_id)), a as (select vec_id, avg(r) as ar from q group by 1)
    select vec_id, (row_number() over (partition by vec_id order by t, r) - 1)::integer as pos, {r("r / ar * 0.5 - 0.5")} as deviation from q join a using (vec_id)""",
    "contour",
)
def circle_deviation(spark, d):
    """X50."""
    return rounded(fx.contour(spark, d).select("vec_id", F.posexplode(geo.circle_deviation(F.col("c"))).alias("pos", "deviation")))


@query(
    f"""{_LISTS}, n as (select vec_id, xs, ys, unnest(range(64)) as i from l), c as (select vec_id, i, xs[(i + 59) % 64 + 1] - xs[i + 1] as ax, ys[(i + 59) % 64 + 1] - ys[i + 1] as ay, xs[(i + 5) % 64 + 1] - xs[i + 1] as bx, ys[(i + 5) % 64 + 1] - ys[i + 1] as by_ from n)
    select vec_id, i::integer as pos, {r("1 - acos(greatest(-1, least(1, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))))) / pi()", 5)} as sharpness from c""",
    "contour",
)
def local_sharpness(spark, d):
    """W10."""
    return rounded(fx.contour(spark, d).select("vec_id", F.posexplode(geo.sharpness(F.col("c"), 5)).alias("pos", "sharpness")), 5)


@query(f"""select a.vec_id, a.i::integer as pos, {r("avg(b.x)", 4)} as x, {r("avg(b.y)", 4)} as y from point a join range(-2, 3) t(k) on true join point b on b.vec_id = a.vec_id and b.i = (a.i + k + 64) % 64 group by 1, 2""", "contour")
def circular_smooth(spark, d):
    """W9."""
    c = fx.contour(spark, d).select("vec_id", F.posexplode(geo.smoothed(F.col("c"), 5, 64)).alias("pos", "p"))
    return rounded(c.select("vec_id", "pos", "p.x", "p.y"), 4)


@query(
    f""", l as (select *, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) over (partition by vec_id order by i) as stop, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) as len from edge), n as (select vec_id, max(stop) as total from l group by 1),
    pt as (select vec_id, k, k * total / 360 as d from n, (select unnest(range(360)) as k)), hit as (select pt.vec_id, k, d, min(i) as i from pt join l on l.vec_id = pt.vec_id and l.stop > d + 1e-12 group by 1, 2, 3)
    select hit.vec_id, k::integer as pos, {r("px + (d - (stop - len)) / len * (qx - px)", 4)} as x, {r("py + (d - (stop - len)) / len * (qy - py)", 4)} as y from hit join l on l.vec_id = hit.vec_id and l.i = hit.i""",
    "contour",
)
def arc_resample(spark, d):
    """Points at even distances along the outline."""
    c = fx.contour(spark, d).select("vec_id", F.posexplode(geo.resampled(F.col("c"), 360)).alias("pos", "p"))
    return rounded(c.select("vec_id", "pos", "p.x", "p.y"), 4)


_NEAR = "list_position(list_transform(m, lambda {0}: least(fmod({0}.angle - p[1].angle + 180, 180::double), 180 - fmod({0}.angle - p[1].angle + 180, 180::double)) < 10), true)"


@query(
    f"""with c as (select l_orderkey as key, row_number() over (partition by l_orderkey order by {fx._L}) as candidate, fmod(l_extendedprice, 180.0::double) as angle, l_quantity as length, case when l_returnflag <> 'N' then [l_returnflag] else []::varchar[] end as sources from lineitem),
    f as (select key, list_reduce(list([{{'candidate': candidate, 'angle': angle, 'length': length, 'sources': sources}}] order by length desc, candidate), lambda m, p: case when {_NEAR.format("q")} is null then list_concat(m, p)
      else list_transform(m, lambda q, i: case when i = {_NEAR.format("z")} then {{'candidate': q.candidate, 'angle': q.angle, 'length': q.length, 'sources': list_distinct(list_concat(q.sources, p[1].sources))}} else q end) end) as kept from c group by 1)
    select key, k.candidate, {r("k.angle", 4)} as angle, k.length, greatest(1, len(k.sources))::bigint as merged from (select key, unnest(kept) as k from f)"""
)
def axis_merge(spark, d):
    """J22."""
    li = fx.table(spark, d, "lineitem").withColumn("candidate", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*fx._ORDER)).cast("long"))
    source = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return boxes.merge_axes(li.select(F.col("l_orderkey").alias("key"), "candidate", source.alias("source"), F.pmod("l_extendedprice", F.lit(180.0)).alias("angle"), F.col("l_quantity").alias("length"))).withColumn("angle", F.round("angle", 4) + F.lit(0.0))


@query(f"""with s as (select *, 'IMG_' || o_orderkey as name from orders) select o_orderkey, case when o_totalprice < 1000 then 'small' when o_orderkey % 9 = 0 then 'no mask' else 'ok' end as status, {r("case when not (o_totalprice < 1000 or o_orderkey % 9 = 0) then o_totalprice / 2 end", 4)} as x from s""")
def centroid_status(spark, d):
    """The first reason that applies, and a value only where all is well."""
    o = fx.table(spark, d, "orders")
    status = F.when(F.col("o_totalprice") < 1000, "small").when(F.col("o_orderkey") % 9 == 0, "no mask").otherwise("ok")
    return rounded(o.withColumn("status", status).select("o_orderkey", "status", F.when(F.col("status") == "ok", F.col("o_totalprice") / 2).alias("x")), 4)


# Components: M1-M3; checked in tests by variance, orthonormality and reconstruction.
def _vectors(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query()
def pca_scores(spark, d):
    """M1, T3."""
    return components_analysis.scores(_vectors(spark, d), "vec_id", "v", 5)


@query()
def pca_variance(spark, d):
    """M1, W7."""
    return components_analysis.variance(_vectors(spark, d), "v", 5)


@query()
def latent_pca(spark, d):
    """M3: centred only."""
    return components_analysis.scores(_latent(spark, d).select(F.col("key").alias("vec_id"), F.col("z").alias("v")), "vec_id", "v", 2, scale=False)
