"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in edges (a, b), where component is the smallest id reachable.

    Each round links all neighbours above an id, then those not above it, to
    the smallest id known in their midst, until every id points to its
    component's smallest. Rounds grow with the logarithm of the component; no
    component is gathered in one place. Rows with null ends are ignored.
    """
    spark = edges.sparkSession
    own = stage_table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = sign(own)
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage_table(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = stage_table(small, name)
        release(spark, own, large)
        own, now = new, sign(new)
        if now == seen:
            ids = own.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.unionByName(own.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now
