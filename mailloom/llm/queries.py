"""Queries of the problems on texts for language models: p1, p4, p6 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm.garbled import garbled_fields
from mailloom.llm.language import label_findings, segments
from mailloom.llm.markup import clean_pages
from mailloom.llm.mixing import mix, shares, source_form
from mailloom.llm.packing import pack
from mailloom.llm.pii import personal_items
from mailloom.llm.similar import similar_groups, similar_rows
from mailloom.llm.tokens import sized
from mailloom.operators.instants import sender_domain
from mailloom.plans.storage import cores, partitions_for, scan_splits, table


def _personal(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    to = table(spark, sf_dir, "mails").filter(F.col("error").isNull()).select(F.col("mail_id").alias("key"), F.lit("To").alias("field_name"), F.col("headers")["To"].alias("text")).filter(F.length("text") > 0)
    fields = table(spark, sf_dir, "features").select("mail_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("text_payloads", "html_payloads")])).alias("f"))
    return personal_items(to.unionByName(fields.select(F.col("mail_id").alias("key"), "f.field_name", "f.text").filter(F.length("text") > 0)), once=once)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _personal(spark, sf_dir, once=False).select("key", "field_name", F.explode("items").alias("i"))
    return items.select(F.col("key").alias("mail_id"), "field_name", F.col("i.kind").alias("pii_type"), F.col("i.text").alias("pii_text")).distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select(F.col("key").alias("mail_id"), "field_name", "redacted", F.size("items").alias("n_items"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mail_id, host): the domain each mail was sent from."""
    return table(spark, sf_dir, "mails").filter(F.col("error").isNull()).select("mail_id", sender_domain(F.col("headers")["From"]).alias("host")).groupBy("mail_id").agg(F.max("host").alias("host"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML payloads with the host that sent them."""
    hosts = _hosts(spark, sf_dir)
    pages = table(spark, sf_dir, "features").select("mail_id", "html_payloads").filter(F.col("html_payloads") != "")
    if scan_splits(pages) < cores(spark):  # too few files for Python behind an adaptive join
        pages = pages.repartition(partitions_for(pages), "mail_id")
    return pages.join(hosts, "mail_id", "left").select(F.col("mail_id").alias("key"), F.when(F.col("host") != "", F.col("host")).alias("host"), F.col("html_payloads").alias("page"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pages(_pages(spark, sf_dir)).select(F.col("key").alias("mail_id"), F.col("clean").alias("text"), "kinds", "marked")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("plain")))
    return p4_clean(spark, sf_dir).filter("marked").select("mail_id", F.explode(kinds).alias("element")).distinct()


def _campaign_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "features").select("mail_id", F.concat_ws(" ", "subject", "text_payloads", "html_skeletons").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_rows(_campaign_texts(spark, sf_dir), "mail_id", "text", 3, 0.6, 20).select(F.col("key_a").alias("mail_id_a"), F.col("key_b").alias("mail_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_campaign_texts(spark, sf_dir), "mail_id", "text", 3, 0.6, 20).withColumnRenamed("key", "mail_id")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "features").select("mail_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("subject", "text_payloads")])).alias("f"))
    rows = fields.join(_hosts(spark, sf_dir), "mail_id", "left").select(F.col("mail_id").alias("key"), F.col("host").alias("source"), "f.field_name", "f.text")
    return garbled_fields(rows).withColumnRenamed("key", "mail_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_repaired(spark, sf_dir).select("mail_id", "field_name").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "pack_limits").agg(F.max("capacity_tokens")).first()[0]
    return pack(sized(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", int(capacity))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_containers(spark, sf_dir).filter(F.col("n_pieces") > 1).select("doc_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used against the least number that could hold all tokens."""
    capacity = table(spark, sf_dir, "pack_limits").agg(F.max("capacity_tokens")).first()[0]
    each = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return each.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.ceil(F.sum("t") / F.lit(capacity)).alias("lower_bound"), (F.sum("t") / F.count("*") / F.lit(capacity)).alias("fill"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_source", source_form(F.col("source")))
    items = sized(docs, "doc_id", "text", "_source").select("doc_id", F.col("_source").alias("source"), "n_tokens")
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", source_form(F.col("source")))
    return mix(items, targets, "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", source_form(F.col("source")))
    return shares(p9_mix(spark, sf_dir), targets, "doc_id")


def _segments(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    return segments(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", once=once)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_findings(_segments(spark, sf_dir, once=False)).withColumnRenamed("key", "doc_id")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select(F.col("key").alias("doc_id"), "doc_lang", "doc_confidence", "segment", "seg_start", "seg_end", "seg_lang", "seg_confidence")


QUERIES = {"p7_found": p7_found, "p7_repaired": p7_repaired, "p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p4_clean": p4_clean, "p10_found": p10_found, "p10_segments": p10_segments, "p6_found": p6_found, "p6_groups": p6_groups, "p8_found": p8_found, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares}
#: The similarity join by counting common shingles of all pairs, which small tables allow.
_SETS = r"""w AS (SELECT mail_id, regexp_extract_all(lower(subject || ' ' || text_payloads || ' ' || html_skeletons), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT * FROM features)),
g AS (SELECT DISTINCT mail_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20)"""
_PAIRS = f"""{_SETS}, n AS (SELECT mail_id, count(*) AS n FROM g GROUP BY mail_id),
o AS (SELECT a.mail_id AS a, b.mail_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.mail_id < b.mail_id GROUP BY ALL),
pairs AS (SELECT a, b, o / (x.n + y.n - o) AS s FROM o JOIN n x ON x.mail_id = a JOIN n y ON y.mail_id = b WHERE o >= 0.6 * (x.n + y.n - o))"""
ORACLES: dict[str, str] = {
    "p6_found": f"WITH {_PAIRS} SELECT a AS mail_id_a, b AS mail_id_b FROM pairs",
    "p6_groups": f"""WITH RECURSIVE {_PAIRS}, edges AS (SELECT a, b, s FROM pairs UNION ALL SELECT b, a, s FROM pairs),
reach AS (SELECT mail_id AS a, mail_id AS b FROM n UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
grp AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a), cls AS (SELECT mail_id, least(mail_id, coalesce(min(b), mail_id)) AS class_id FROM n LEFT JOIN edges ON a = mail_id AND s = 1 GROUP BY mail_id)
SELECT c.mail_id, c.class_id, group_id, count(DISTINCT o.class_id) FILTER (WHERE o.class_id <> c.class_id) AS n_links
FROM cls c JOIN grp ON grp.a = c.mail_id LEFT JOIN edges e ON e.a = c.mail_id LEFT JOIN cls o ON o.mail_id = e.b GROUP BY ALL""",
    # sizes are far from the capacity on either side, so letters tell what tokens do
    "p8_found": "SELECT DISTINCT doc_id FROM documents CROSS JOIN pack_limits WHERE length(text) > 4 * capacity_tokens",
}
