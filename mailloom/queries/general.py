"""Queries of the general data problems: p2 (deliveries), p3 (copies), p5 (instants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators.copies import cluster_copy_differences
from mailloom.operators.instants import normalised_instants, sender_domain
from mailloom.plans.storage import table
from mailloom.streaming.dedup import delivery_stream, surplus_rows


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_rows(delivery_stream(spark, f"{sf_dir}/messages.parquet")).select(F.col("id").alias("delivery_id"))


def p2_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with exactly one row of each mail: the anti-join with the surplus ids, which are few, so the narrow side shuffles or is broadcast by its measured size."""
    surplus = p2_found(spark, sf_dir)
    return table(spark, sf_dir, "messages").select("delivery_id", "batch_id", "hdr_message_id", "hdr_to").dropDuplicates(["delivery_id"]).join(surplus, "delivery_id", "left_anti")


def p3_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_copy_differences(table(spark, sf_dir, "clusters"), table(spark, sf_dir, "clusters_copy"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.col("side") == "only_left", F.array(F.lit("only_in_clusters"))).when(F.col("side") == "only_right", F.array(F.lit("only_in_copy"))).otherwise(F.transform("diffs", lambda d: d.field))
    return p3_differences(spark, sf_dir).select("run_id", "member_name", F.explode(one).alias("finding"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").withColumn("_source", sender_domain(F.col("hdr_from")))
    return normalised_instants(m, "delivery_id", "hdr_date", "origin_zone", "_source", "received_at").select("delivery_id", "utc_micros")


QUERIES = {"p2_found": p2_found, "p2_deduplicated": p2_deduplicated, "p3_found": p3_found, "p5_found": p5_found}

_KEYED = r"""
keyed AS (
  SELECT DISTINCT delivery_id, batch_id, received_at, hdr_message_id, hdr_to,
    nullif(regexp_replace(coalesce(hdr_message_id, ''), '^[\s<]+|[\s>]+$', '', 'g'), '') AS mid,
    list_sort(list_distinct(list_filter(list_transform(
      string_split_regex(regexp_replace(regexp_replace(coalesce(hdr_to, ''), '"[^"]*"', ' ', 'g'), '\([^()]*\)', ' ', 'g'), '[,;]'),
      lambda p: lower(CASE WHEN contains(p, '<') THEN regexp_extract(p, '<\s*([^<>]*?)\s*>', 1) ELSE regexp_replace(p, '\s+', '', 'g') END)),
      lambda a: contains(a, '@')))) AS addresses
  FROM messages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mid, addresses ORDER BY received_at, delivery_id) AS rn FROM keyed)"""

_SIDES = r"""
l AS (SELECT run_id, regexp_extract(member, '([^/\\]*)$', 1) AS member_name, regexp_replace(lower(trim(cluster_id)), '^urn:uuid:|[{}-]', '', 'g') AS cluster_id, score, date_trunc('second', assigned_at) AS assigned_at FROM clusters),
r AS (SELECT run_id, regexp_extract(member, '([^/\\]*)$', 1) AS member_name, regexp_replace(lower(trim(cluster_id)), '^urn:uuid:|[{}-]', '', 'g') AS cluster_id, score, date_trunc('second', assigned_at) AS assigned_at FROM clusters_copy),
j AS (
  SELECT coalesce(l.run_id, r.run_id) AS run_id, coalesce(l.member_name, r.member_name) AS member_name,
    CASE WHEN r.member_name IS NULL THEN 'only_in_clusters' WHEN l.member_name IS NULL THEN 'only_in_copy' END AS side,
    l.cluster_id IS DISTINCT FROM r.cluster_id AS c, CASE WHEN l.score IS NULL OR r.score IS NULL THEN l.score IS DISTINCT FROM r.score ELSE abs(l.score - r.score) > 1e-6 END AS s, l.assigned_at IS DISTINCT FROM r.assigned_at AS a
  FROM (SELECT DISTINCT * FROM l) l FULL JOIN (SELECT DISTINCT * FROM r) r ON l.run_id = r.run_id AND l.member_name = r.member_name)"""

ORACLES = {
    "p2_found": f"WITH {_KEYED} SELECT delivery_id FROM ranked WHERE mid IS NOT NULL AND rn > 1",
    "p2_deduplicated": f"WITH {_KEYED} SELECT delivery_id, batch_id, hdr_message_id, hdr_to FROM ranked WHERE mid IS NULL OR rn = 1",
    "p3_found": f"""WITH {_SIDES}
SELECT run_id, member_name, side AS finding FROM j WHERE side IS NOT NULL
UNION SELECT run_id, member_name, 'cluster_id' FROM j WHERE side IS NULL AND c
UNION SELECT run_id, member_name, 'score' FROM j WHERE side IS NULL AND s
UNION SELECT run_id, member_name, 'assigned_at' FROM j WHERE side IS NULL AND a""",
}
