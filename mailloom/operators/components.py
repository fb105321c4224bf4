"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: larger neighbours of u get the least node around u; small: u and its smaller neighbours do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, most: int = 50) -> DataFrame:
    """(node, component) of every node with an edge; the component is named by its least node.

    Every round ends in a table in the shared folder, so lost executors cost a round at most. Rows
    with a null end and loops are ignored; an empty edge list gives an empty result.
    """
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct(), "edges")
    seen = None
    for _ in range(most):
        before, e = e, written(_star(_star(e, True), False), "edges")
        drop(before)
        sign = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
