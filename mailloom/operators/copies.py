"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid_form(c: Column) -> Column:
    """One way of writing a uuid: 32 lower-case hex digits, without braces, urn prefix and dashes."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^urn:uuid:|[{}-]", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def differs(left: Column, right: Column, tolerance: float | None = None) -> Column:
    """Null-safe: a null differs from any value, two nulls are equal; NaN equals NaN."""
    if tolerance is None:
        return ~left.eqNullSafe(right)
    return F.when(left.isNull() | right.isNull(), ~left.eqNullSafe(right)).otherwise(~(left.eqNullSafe(right) | (F.abs(left - right) <= tolerance)))


def copy_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, float | None]) -> DataFrame:
    """One row per key that is missing on a side or differs: ``side`` and ``diffs``.

    ``left`` and ``right`` carry the normalised ``keys`` and ``fields`` (name -> tolerance or None).
    side is ``only_left``, ``only_right`` or ``both``; diffs is an array of
    struct(field, left_value, right_value), empty for one-sided rows.

    Keys are compared null-safely, so a null key matches a null key. Repeated identical rows count
    once. A key with several different rows on a side is represented by its smallest row (fields in
    the given order, nulls first); both sides choose alike, so equal sets of rows never differ.
    Further columns of the inputs are ignored, so clashing names do no harm.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        packed = F.struct(*[F.col(f) for f in fields])
        # a null key and any value differ as strings, so sides grouped by these need no second shuffle to be joined
        plain = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
        rows = df.select(*plain, packed.alias("_row"), F.struct(*[F.col(k) for k in keys]).alias("_key"))
        return rows.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_row").alias(f"{tag}_row"), F.min("_key").alias(f"{tag}_key"))

    joined = side(left, "l").join(side(right, "r"), [f"_k{i}" for i in range(len(keys))], "full_outer")
    here, there = F.col("l_key").isNotNull(), F.col("r_key").isNotNull()
    items = []
    for f, tolerance in fields.items():
        x, y = F.col(f"l_row.{f}"), F.col(f"r_row.{f}")
        items.append(F.when(here & there & differs(x, y, tolerance), F.struct(F.lit(f).alias("field"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))))
    return joined.select(
        *[F.when(here, F.col(f"l_key.{k}")).otherwise(F.col(f"r_key.{k}")).alias(k) for k in keys],
        F.when(here & there, "both").when(here, "only_left").otherwise("only_right").alias("side"),
        F.filter(F.array(*items), lambda x: x.isNotNull()).alias("diffs"),
    ).filter((F.col("side") != "both") | (F.size("diffs") > 0))


def membership(df: DataFrame) -> DataFrame:
    """clusters in the form that both systems share."""
    return df.select("run_id", base_name(F.col("member")).alias("member_name"), uuid_form(F.col("cluster_id")).alias("cluster_id"), F.col("score").cast("double").alias("score"), F.date_trunc("second", "assigned_at").alias("assigned_at"))


def cluster_copy_differences(clusters: DataFrame, copy: DataFrame) -> DataFrame:
    return copy_differences(membership(clusters), membership(copy), ["run_id", "member_name"], {"cluster_id": None, "score": 1e-6, "assigned_at": None})
