"""Distributions, correlations, ranks and reshaping."""

from __future__ import annotations

import math
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components_analysis import centred_sums


#: Rows that one range of an ordered column should hold, and the most ranges; their bounds are all that the driver gets.
ROWS_PER_RANGE, MOST_RANGES = 200_000, 4096


def in_ranges(df: DataFrame, column: str, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """df with __range, the number of an interval of a numeric column; later intervals hold greater values, null stands in the first.

    Bounds are approximate quantiles, so that intervals hold about as many rows
    each; they are constants of the plan, so every use of it agrees on them.
    """
    n = df.where(F.col(column).isNotNull()).count()
    parts = min(MOST_RANGES, n // rows + 1)
    if parts == 1:
        return df.withColumn("__range", F.lit(0))
    at = F.percentile_approx(F.col(column).cast("double"), F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100 * parts))
    bounds = sorted(set(df.agg(at).first()[0]))
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    own = F.col(column).cast("double")
    array = lambda xs: F.array(*map(F.lit, xs))
    block = F.greatest(F.size(F.filter(array([b[0] for b in blocks]), lambda b: b <= own)), F.lit(1))
    inside = F.size(F.filter(F.get(F.array(*map(array, blocks)), block - 1), lambda b: b <= own))
    return df.withColumn("__range", F.coalesce((block - 1) * step + inside, F.lit(0)))


def before_each(ranges: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, __range, __before, __all): the sum of n over a key's earlier ranges, and over all; a row per key and range, which is what the window sees."""
    each = ranges.groupBy(*keys, "__range").agg(F.sum(n).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__range")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumns({"__before": before, "__all": F.sum("__n").over(Window.partitionBy(*keys))}).drop("__n")


#: Values of a group that one task may hold; the largest group's count decides.
MOST_HELD = 1_000_000


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], rows: int = ROWS_PER_RANGE, held: int | None = None) -> DataFrame:
    """(keys, q): exact quantiles of value by linear interpolation, as an array; nulls are left out.

    One pass counts the groups. If the largest fits a task, one aggregate gives
    all quantiles. Beyond that equal values are counted first, counts are summed
    up within ranges of values, and only the values next to the wanted ranks are
    gathered, so no task holds a group, however few groups there are.
    """
    df = df.where(F.col(value).isNotNull())
    largest = df.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    if largest <= (MOST_HELD if held is None else held):
        return df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in at])).alias("q"))
    counts = in_ranges(df, value, rows).groupBy(*keys, "__range", value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy(value))
    placed = counts.withColumn("__upto", upto).join(before_each(counts, keys, "__n"), [*keys, "__range"])
    last = F.col("__before") + F.col("__upto")
    holds = lambda rank: (rank < last) & (rank >= last - F.col("__n"))
    h = [(F.col("__all") - 1) * F.lit(float(p)) for p in at]
    picks = [F.max(F.when(holds(f(x)), F.col(value).cast("double"))).alias(f"{n}{i}") for i, x in enumerate(h) for n, f in (("lo", F.floor), ("hi", F.ceil))]
    got = placed.groupBy(*keys).agg(F.first("__all").alias("__all"), *picks)
    part = lambda i, x: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (x - F.floor(x))
    return got.select(*keys, F.array(*[part(i, x) for i, x in enumerate(h)]).alias("q"))


def element_median(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, pos, value): the median of an array column at each position; one group per key and position keeps groups small."""
    return df.select(key, F.posexplode(values).alias("pos", "value")).groupBy(key, "pos").agg(F.median("value").alias("value"))


def gathered(long: DataFrame, key: str, name: str) -> DataFrame:
    """Positions put back into an array in order."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias(name))


def fences(df: DataFrame, keys: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles by linear interpolation and the fences beyond which values are outliers."""
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return q.select(*keys, q1.alias("q1"), F.col("q")[1].alias("q2"), q3.alias("q3"), (q3 - q1).alias("iqr"), (q1 - reach * (q3 - q1)).alias("low"), (q3 + reach * (q3 - q1)).alias("high"))


def with_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    f = fences(df, keys, value)
    return df.join(f, keys).withColumn("outlier", (F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population deviation, extremes, quartiles, and count and percent of outliers."""
    marked = with_outliers(df, keys, value)
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("q3").alias("q3"), F.max(value).alias("most"), F.first("iqr").alias("iqr"),
        F.count_if("outlier").alias("outliers"), (100 * F.count_if("outlier") / F.count("*")).alias("outlier_percent"),
    )


def error_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.avg((F.col(value) < 5).cast("double")).alias("within_5"), F.avg((F.col(value) < 10).cast("double")).alias("within_10"))
    out = out.join(quantiles(df, keys, value, [0.5, 0.9, 0.95, 0.99]).withColumnRenamed("q", "p"), keys)
    return out.select(*keys, "n", "mean", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((50, 90, 95, 99))], "most", "within_5", "within_10")


def binned(df: DataFrame, key: str, value: str, width: float = 30.0, bins: int = 12) -> DataFrame:
    """Count, mean and population deviation of value in bins of key; empty bins have zeros."""
    spark = df.sparkSession
    every = spark.range(bins).select(F.col("id").alias("bin"))
    got = df.groupBy(F.floor(F.col(key) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return every.join(got, "bin", "left").na.fill(0)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal bins between the least and the greatest value, which falls into the last bin; equal values lie in the middle of a range of 1. Nulls are left out."""
    df = df.where(F.col(value).isNotNull())
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    same = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1).cast("bigint"))
    return df.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value with the share of values that don't exceed it; counts are summed per value first."""
    counts = in_ranges(df, value).groupBy("__range", value).agg(F.count("*").alias("n"))
    placed = counts.withColumn("__upto", F.sum("n").over(Window.partitionBy("__range").orderBy(value))).join(F.broadcast(before_each(counts, [], "n")), "__range")  # a row per range
    return placed.select(value, ((F.col("__before") + F.col("__upto")) / F.col("__all")).alias("share"))


def correlations(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows that have all of them; one pass."""
    whole = df.na.drop(subset=columns)
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2)]
    row = whole.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{i}"), digits).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.covar_samp(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("cov")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def loadings(df: DataFrame, dims: str, values: str) -> DataFrame:
    """Pearson correlation of each latent dimension with each position of a profile, null where one of them doesn't vary; from block sums, so rows aren't multiplied."""
    rows = df.where(F.col(dims).isNotNull() & F.col(values).isNotNull())
    first = rows.select(F.size(dims)).first()
    schema = "dim int, pos int, r double"
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    k = first[0]
    _, _, cov = centred_sums(rows.select(F.concat(F.col(dims).cast("array<double>"), F.col(values).cast("array<double>")).alias("v")), "v")
    var = np.diag(cov)
    both = np.sqrt(np.outer(var[:k], var[k:]))
    r = np.divide(cov[:k, k:], both, out=np.full(both.shape, np.nan), where=both > 0)
    return df.sparkSession.createDataFrame([(i, j, None if np.isnan(x) else float(x)) for (i, j), x in np.ndenumerate(r)], schema)


def strongest(load: DataFrame) -> DataFrame:
    """The position of each dimension's strongest loading, the first on ties."""
    w = Window.partitionBy("dim").orderBy(F.abs("r").desc(), "pos")
    return load.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def correlation_tests(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each two columns over the rows that have both, the p-value of its t-test, and stars at .05, .01 and .001.

    One pass; the p-values are of one row per pair. Under three rows there is no p-value.
    """
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(*[F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(both(a, b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if m < 3 or pd.isna(x) else beta_share(max(0.0, 1 - x * x), (m - 2) / 2, 0.5) for x, m in zip(r, n, strict=True)], dtype="float64")

    out = row.select(F.explode(each).alias("s")).select("s.*").withColumn("p", p_value("r", "n"))
    return out.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def strongest_rows(df: DataFrame, key: str, dims: str) -> DataFrame:
    """(dim, key, value): the row with the greatest absolute value of each latent dimension, the smallest key on ties."""
    long = df.select(key, F.posexplode(dims).alias("dim", "value"))
    best = long.groupBy("dim").agg(F.min(F.struct((-F.abs("value")).alias("rank"), key, "value")).alias("b"))
    return best.select("dim", F.col(f"b.{key}").alias(key), "b.value")


def median_vector(df: DataFrame, dims: str) -> DataFrame:
    """One row: the median, least and greatest value of each dimension, as arrays middle, least and most."""
    each = df.select(F.posexplode(dims).alias("pos", "v")).groupBy("pos").agg(F.median("v").alias("middle"), F.min("v").alias("least"), F.max("v").alias("most"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("pos", "middle", "least", "most"))).alias("a"))  # one row per dimension
    return one.select(F.col("a.middle").alias("middle"), F.col("a.least").alias("least"), F.col("a.most").alias("most"))


def nearest_to_median(df: DataFrame, key: str, dims: str, others: int, seed: str) -> DataFrame:
    """(key, pick): the row next to the median vector, the smallest key on ties, and so many others chosen by a hash of key and seed."""
    far = df.crossJoin(F.broadcast(median_vector(df, dims))).select(key, F.aggregate(F.zip_with(dims, "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"))  # one row of medians
    first = far.orderBy("d", key).limit(1).select(key, F.lit("median").alias("pick"))
    rest = df.select(key).join(F.broadcast(first.select(key)), key, "left_anti").orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(others)
    return first.unionByName(rest.withColumn("pick", F.lit("other")))


def substituted(df: DataFrame, dims: str, n: int) -> DataFrame:
    """(dim, side, z): the median vector with one of n dimensions at its least (low) or greatest (high) value."""
    row = median_vector(df, dims)
    both = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dim")).select("*", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("side"))
    other = F.when(F.col("side") == "low", F.get("least", F.col("dim"))).otherwise(F.get("most", F.col("dim")))
    return both.select("dim", "side", other.alias("__o"), "middle").select("dim", "side", F.transform("middle", lambda x, i: F.when(i == F.col("dim"), F.col("__o")).otherwise(x)).alias("z"))


def vae_loss(recon: Column, x: Column, mu: Column, logvar: Column, beta: float = 0.001) -> tuple[Column, Column]:
    """Aggregates: mean squared error over all elements, and the mean divergence from a standard normal, of array columns; the loss is the first plus beta times the second."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    squares = F.sum(total(F.zip_with(recon, x, lambda a, b: (a - b) * (a - b)))) / F.sum(F.size(x))
    kl = -0.5 * F.sum(total(F.zip_with(mu, logvar, lambda m, v: 1 + v - m * m - F.exp(v)))) / F.sum(F.size(mu))
    return squares, kl


def direction_loss(px: Column, py: Column, tx: Column, ty: Column, weight: float = 0.05) -> tuple[Column, Column, Column]:
    """Mean of 1 - cosine between predicted and true directions, the same plus a penalty on predicted lengths other than 1, and the mean cosine."""
    n = F.greatest(F.hypot(px, py), F.lit(1e-8))
    cosine = (px * tx + py * ty) / n
    penalty = (F.hypot(px, py) - 1) * (F.hypot(px, py) - 1)
    return F.avg(1 - cosine), F.avg(1 - cosine) + weight * F.avg(penalty), F.avg(cosine)


def standardised(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, pos, value): each position of an array column over its mean and sample deviation; 1 where there is none."""
    long = df.select(key, F.posexplode(values).alias("pos", "v"))
    each = long.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return long.join(F.broadcast(each), "pos").select(key, "pos", ((F.col("v") - F.col("m")) / F.when(F.coalesce("s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("s"))).alias("value"))  # one row per position


def linear_fit(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def hexagons(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Counts per hexagon: of the two nearest centres on offset grids, the nearer one."""
    sx, sy = F.col(x) / size, F.col(y) / (size * 3**0.5)
    ax, ay = F.floor(sx + 0.5), F.floor(sy + 0.5)
    bx, by = F.floor(sx), F.floor(sy)
    da = (sx - ax) * (sx - ax) + 3 * (sy - ay) * (sy - ay)
    db = (sx - bx - 0.5) * (sx - bx - 0.5) + 3 * (sy - by - 0.5) * (sy - by - 0.5)
    hx = F.when(da <= db, 2 * ax).otherwise(2 * bx + 1)
    hy = F.when(da <= db, 2 * ay).otherwise(2 * by + 1)
    return df.groupBy(hx.alias("hx"), hy.alias("hy")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, low: float, high: float, points: int, width: float) -> DataFrame:
    """Gaussian kernel density at points of a grid: one sum per point in one pass, so rows aren't multiplied."""
    at = [low + (high - low) / (points - 1) * i for i in range(points)]
    z = lambda x: (F.lit(x) - F.col(value)) / width
    row = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), *[F.sum(F.exp(-0.5 * z(x) * z(x))).alias(f"s{i}") for i, x in enumerate(at)])
    each = F.array(*[F.struct(F.lit(x).alias("at"), (F.col(f"s{i}") / (F.col("n") * width * (2 * math.pi) ** 0.5)).alias("density")) for i, x in enumerate(at)])
    return row.where("n > 0").select(F.explode(each).alias("d")).select("d.*")


def collapsed(df: DataFrame, most: float = 0.5) -> DataFrame:
    """Dimensions whose span within objects is small in the middle of them: (key, dim, value) rows in."""
    spans = df.groupBy("key", "dim").agg((F.max("value") - F.min("value")).alias("span"))
    return spans.groupBy("dim").agg(F.median("span").alias("median_span")).withColumn("collapsed", F.col("median_span") < most)


def sweep(df: DataFrame, dims: str, steps: int = 7) -> DataFrame:
    """Even steps between -3|z| and 3|z| of each latent dimension, between -1 and 1 where z is next to 0."""
    flat = df.select("key", F.posexplode(dims).alias("dim", "z"))
    top = F.when(F.abs("z") < 1e-6, 1.0).otherwise(3 * F.abs("z"))
    return flat.select("key", "dim", top.alias("top"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).select("key", "dim", "step", (-F.col("top") + 2 * F.col("top") * F.col("step") / (steps - 1)).alias("value"))


def quadrant(x: Column, y: Column) -> Column:
    return F.when((x >= 0) & (y >= 0), 1).when((x < 0) & (y >= 0), 2).when((x < 0) & (y < 0), 3).otherwise(4)


def quadrant_extremes(df: DataFrame, x: str, y: str) -> DataFrame:
    """The rows farthest from the origin in each quadrant, ties kept."""
    far = df.withColumns({"quadrant": quadrant(F.col(x), F.col(y)), "distance": F.hypot(x, y)})
    return far.withColumn("k", F.rank().over(Window.partitionBy("quadrant").orderBy(F.desc("distance")))).where("k = 1").drop("k")


def axis_extremes(df: DataFrame, near: str, along: str, key: str, n: int = 20) -> DataFrame:
    """Of the n rows nearest to an axis, those with the greatest and the least value along it, ties kept."""
    close = df.orderBy(F.abs(near), key).limit(n)
    most = close.withColumns({"k": F.rank().over(Window.orderBy(F.desc(along))), "side": F.lit("high")}).where("k = 1")
    least = close.withColumns({"k": F.rank().over(Window.orderBy(along)), "side": F.lit("low")}).where("k = 1")
    return most.unionByName(least).drop("k")


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, one per key; those of the first table win."""
    both = first.withColumn("__t", F.lit(0)).unionByName(second.withColumn("__t", F.lit(1)))
    w = Window.partitionBy(key).orderBy("__t", *[c for c in first.columns if c != key])
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__t")


def rank_candidates(df: DataFrame, key: str) -> DataFrame:
    """Rank by score, longer first on ties; the selected one's margin is the gap to the second."""
    w = Window.partitionBy(key).orderBy("score", F.desc("length"), "candidate")
    return df.withColumns({"rank": F.row_number().over(w).cast("long"), "margin": F.lead("score").over(w) - F.col("score")}).withColumn("margin", F.when(F.col("rank") == 1, F.col("margin")))


def split_sets(df: DataFrame, key: str, shares: tuple[float, float], seed: str, rounded: bool = False) -> DataFrame:
    """train, val and test by a hash of key and seed.

    Truncated: train and val have their share, one at least, and test the rest.
    Rounded (half to even): val and test have theirs, one at least, and train the rest.
    """
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    # The hash is spread evenly, so its beginning makes even ranges.
    hashed = hashed.withColumn("__range", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    placed = hashed.withColumn("__upto", F.row_number().over(Window.partitionBy("__range").orderBy("__h", key)))
    placed = placed.join(F.broadcast(before_each(hashed.withColumn("__one", F.lit(1)), [], "__one")), "__range")  # a row per range
    n, place = F.col("__all"), F.col("__before") + F.col("__upto")
    if rounded:
        # What is left of 1 is a decimal share like the others, without the rounding of their sum.
        val, test = (F.greatest(F.lit(1), F.bround(n * x).cast("long")) for x in (shares[1], round(1 - sum(shares), 9)))
        train = n - val - test
    else:
        train, val = (F.greatest(F.lit(1), F.floor(n * x).cast("long")) for x in shares)
        val = F.when(train + val >= n, F.greatest(F.lit(1), n - train - 1)).otherwise(val)
    return placed.withColumn("split", F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test")).select(*df.columns, "split")


def running_best(df: DataFrame, order: str, value: str) -> DataFrame:
    """The best value so far and how many steps ago it was reached first, over a log of training steps."""
    # A best goes with the first step that reached it, so a plateau needs no key of its own.
    log = in_ranges(df, order).withColumn("__at", F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("best"), F.col(order).alias("step"))))
    # What earlier ranges have reached is one row each.
    ranges = log.groupBy("__range").agg(F.min("__at").alias("__least"))
    earlier = ranges.select("__range", F.min("__least").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    own = F.min("__at").over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    best = log.withColumn("__own", own).join(F.broadcast(earlier), "__range").withColumn("__best", F.least("__own", "__earlier"))
    return best.select(*df.columns, F.col("__best.best").alias("best"), (F.col(order) - F.col("__best.step")).alias("stall"))
