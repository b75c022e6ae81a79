"""The star-schema tables seen as objects, images, profiles, boxes and text, in Spark and in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def kernel(spark: SparkSession, d: str) -> DataFrame:
    """Objects: line items, numbered within their order."""
    li = table(spark, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long")
    li = li.withColumns({"kernel_id": n, "stem": F.concat(F.lit("IMG_"), F.col("l_orderkey").cast("string"))})
    return li.select(
        F.col("l_orderkey").alias("image_no"), "stem", F.concat("stem", F.lit(".jpg")).alias("image_name"), "kernel_id", tx.kernel_name(F.col("stem"), F.col("kernel_id")).alias("kernel_name"),
        (F.col("l_quantity") * 10).alias("length"), (F.col("l_quantity") * (3 + 20 * F.col("l_discount"))).alias("width"), F.col("l_extendedprice").alias("area"),
        (0.8 + 2 * F.col("l_discount")).alias("circularity"), (1 - 8 * F.col("l_tax")).alias("confidence"), "l_partkey", "l_suppkey",
    )


def image(spark: SparkSession, d: str) -> DataFrame:
    """Image metadata: orders, some of them twice, some without a weight."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("IMG_"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    weight = F.when(F.col("o_orderkey") % 11 == 0, "UNKNOWN").when(F.col("o_orderkey") % 17 == 0, " ").otherwise(F.round("o_totalprice").cast("bigint").cast("string"))
    first = o.select(name.alias("image_name"), F.col("o_orderkey").alias("image_no"), F.lit(1).alias("seq"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("plant_name"), weight.alias("weight_text"))
    again = o.where("o_orderkey % 13 = 0").select(name.alias("image_name"), F.col("o_orderkey").alias("image_no"), F.lit(2).alias("seq"), F.concat(F.lit("P"), (F.col("o_custkey") + 1).cast("string")).alias("plant_name"), F.lit("12.5").alias("weight_text"))
    return first.unionByName(again)


def scaled(spark: SparkSession, d: str) -> DataFrame:
    """Objects with their group and image's scale; every seventh image has none."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_no"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("plant_name"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") * 1.0471975511965976e-6).alias("scale"))
    return kernel(spark, d).join(o, "image_no")


def profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: 20 * (1 + x.cast("double"))).alias("w"))


def contour(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    r = lambda x: 100 * (1 + x.cast("double"))
    at = lambda i: i * (2 * math.pi / 64)
    return e.select("vec_id", F.transform("embedding", lambda x, i: F.struct((r(x) * F.cos(at(i))).alias("x"), (r(x) * F.sin(at(i))).alias("y"))).alias("c"))


def box(spark: SparkSession, d: str) -> DataFrame:
    """Boxes: line items of twenty orders at a time, on a canvas of 1000 by 700."""
    li = table(spark, d, "lineitem").withColumn("image_no", F.floor(F.col("l_orderkey") / 20))
    n = F.row_number().over(Window.partitionBy("image_no").orderBy("l_orderkey", *_ORDER)).cast("long")
    x, y = ((F.col("l_partkey") * 37) % 1000).cast("double"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 97) % 700).cast("double")
    w, h = 20 + 3 * F.col("l_quantity"), 15 + (F.col("l_partkey") % 90).cast("double")
    return li.select("image_no", n.alias("box_id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), (1 - 5 * F.col("l_discount")).alias("conf"))


def digit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    x = ((F.col("event_id") * 7919) % 100).cast("double")
    return e.select((F.col("event_id") % 2000).alias("image_no"), F.col("event_id").alias("box_id"), F.when(F.col("event_id") % 17 == 0, ".").otherwise((F.col("event_id") % 10).cast("string")).alias("digit"), x.alias("x1"), F.lit(5.0).alias("y1"), (x + 12).alias("x2"), F.lit(25.0).alias("y2"), (((F.col("event_id") * 31) % 997) / 997.0).alias("conf"))


def angle(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_returnflag").alias("model"), F.pmod("l_extendedprice", F.lit(360.0)).alias("pred"), ((F.col("l_partkey") * 7) % 360).cast("double").alias("true"))


def text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat_ws("_", "p_brand", "p_type", "p_name").alias("raw"), ((F.col("p_partkey") % 100) / 100.0).alias("conf"), (F.col("p_partkey") % 200).alias("image_no"))


_L = ", ".join(_ORDER)
_TWO_PI_64 = repr(2 * math.pi / 64)

#: The same views in DuckDB SQL.
SQL = {
    "kernel": f"""kernel as (select *, printf('%s_kernel_%03d.jpg', stem, kernel_id) as kernel_name from (select l_orderkey as image_no, 'IMG_' || l_orderkey as stem, 'IMG_' || l_orderkey || '.jpg' as image_name,
        row_number() over (partition by l_orderkey order by {_L}) as kernel_id, l_quantity * 10 as length, l_quantity * (3 + 20 * l_discount) as width, l_extendedprice as area,
        0.8::double + 2 * l_discount as circularity, 1 - 8 * l_tax as confidence, l_partkey, l_suppkey from lineitem))""",
    "image": """image as (select 'IMG_' || o_orderkey || '.jpg' as image_name, o_orderkey as image_no, 1 as seq, 'P' || o_custkey as plant_name,
        case when o_orderkey % 11 = 0 then 'UNKNOWN' when o_orderkey % 17 = 0 then ' ' else cast(cast(round(o_totalprice) as bigint) as varchar) end as weight_text from orders
        union all select 'IMG_' || o_orderkey || '.jpg', o_orderkey, 2, 'P' || (o_custkey + 1), '12.5' from orders where o_orderkey % 13 = 0)""",
    "scaled": """scaled as (select k.*, 'P' || o_custkey as plant_name, case when o_orderkey % 7 <> 0 then o_totalprice * 1.0471975511965976e-6::double end as scale from kernel k join orders on image_no = o_orderkey)""",
    "profile": "profile as (select vec_id, label::bigint as label, list_transform(embedding, lambda x: 20 * (1 + x::double)) as w from embeddings)",
    "contour": f"""point as (select vec_id, i - 1 as i, 100 * (1 + embedding[i]::double) * cos((i - 1) * {_TWO_PI_64}::double) as x, 100 * (1 + embedding[i]::double) * sin((i - 1) * {_TWO_PI_64}::double) as y
        from embeddings, range(1, 65) t(i)), edge as (select p.vec_id, p.i, p.x as px, p.y as py, q.x as qx, q.y as qy from point p join point q on p.vec_id = q.vec_id and q.i = (p.i + 1) % 64)""",
    "box": f"""box as (select image_no, row_number() over (partition by image_no order by l_orderkey, {_L}) as box_id, x as x1, y as y1, x + 20 + 3 * l_quantity as x2, y + 15 + (l_partkey % 90) as y2, 1 - 5 * l_discount as conf
        from (select *, floor(l_orderkey / 20)::bigint as image_no, ((l_partkey * 37) % 1000)::double as x, ((l_suppkey * 53 + l_linenumber * 97) % 700)::double as y from lineitem))""",
    "digit": """digit as (select event_id % 2000 as image_no, event_id as box_id, case when event_id % 17 = 0 then '.' else cast(event_id % 10 as varchar) end as digit, ((event_id * 7919) % 100)::double as x1, ((event_id * 7919) % 100)::double + 12 as x2, ((event_id * 31) % 997) / 997.0::double as conf from events)""",
    "angle": "angle as (select l_orderkey, l_returnflag as model, fmod(l_extendedprice, 360.0::double) as pred, ((l_partkey * 7) % 360)::double as true_ from lineitem)",
    "text": "texts as (select p_partkey, concat_ws('_', p_brand, p_type, p_name) as raw, (p_partkey % 100) / 100.0::double as conf, p_partkey % 200 as image_no from part)",
}
_NEEDS = {"scaled": ["kernel"]}


def sql(views: str, body: str) -> str:
    """A query over some of the views."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    return ("with " + ", ".join(SQL[n] for n in names) + " " if names else "") + body
