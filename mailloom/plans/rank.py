"""Numbering rows within groups when one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailloom.plans.storage import partitions_for, written

LEAST_SLICES = 256


def slices_for(spark: SparkSession) -> int:
    """Slices of a group: more on a cluster that is set up for more partitions, so that a slice fits a task."""
    return max(LEAST_SLICES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def slice_of(*order: str, slices: int) -> Column:
    """A deterministic slice of the rows; recomputed tasks give the same."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(slices)).cast("int")


def numbered(df: DataFrame, group: list[str], order: list[str], into: str, weight: str | None = None, slice_col: Column | None = None, ordered: bool = False) -> DataFrame:
    """Adds ``into``: the 0-based number of the row in its group, or the sum of ``weight`` of the rows before it.

    Rows of a group are ordered by (slice, order), so a group is ranked in many independent tasks; the
    sizes of its slices give each its offset. With ``ordered`` the numbers follow ``order`` itself: rows
    are range-partitioned by (group, order), whatever the values look like, and a partition is a slice;
    the slices are written first, as borders are sampled and two samples would differ. Otherwise the
    slice is ``slice_col``, or a hash.
    """
    if ordered:
        df = written(df.repartitionByRange(partitions_for(df), *group, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    else:
        df = df.withColumn("_slice", slice_col if slice_col is not None else slice_of(*order, slices=slices_for(df.sparkSession)))
    amount = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    sizes = df.groupBy(*group, "_slice").agg(F.sum(amount).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    if weight:
        local = F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    else:
        local = (F.row_number().over(inside) - 1).cast("bigint")
    at = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_slice") == F.col("_s")]
    cond = at[0]
    for c in at[1:]:
        cond = cond & c
    return df.withColumn("_local", local).join(offsets, cond, "left").withColumn(into, F.col("_local") + F.col("_offset")).drop("_slice", "_local", "_s", "_offset", *[f"_g{i}" for i in range(len(group))])
