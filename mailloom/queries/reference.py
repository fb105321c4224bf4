"""Queries of the mail operators: parsing, features, pseudonyms, clusterings and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import mime
from mailloom.operators import anonymize, compare, grouping, piecewise
from mailloom.operators import features as feat
from mailloom.operators.copies import uuid_form
from mailloom.operators.sweep import SWEEP, sweep
from mailloom.plans.storage import spread, table
from mailloom.sources import mails as src

CAT = feat.CATEGORICAL


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "mails"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "features").dropDuplicates()


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("mail_id", F.concat("text_payloads", "html_payloads").alias("text"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clusters").withColumn("cluster_id", uuid_form(F.col("cluster_id")))
    return compare.members(c, "run_id")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("run_id = 'gold'").select(F.col("cluster_id").alias("gold_id"), "member")


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("run_id != 'gold'")


# ---- sources and parsing


def parsed_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages to payload rows, by the MIME walk."""
    m = src.parsed(table(spark, sf_dir, "mails").select("mail_id", "raw"))
    return m.filter("error IS NULL").select("mail_id", "ord", F.posexplode("payloads").alias("pos", "p")).select("mail_id", "ord", "pos", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), "p.content", "p.content_type", "p.encoding", "p.extension", "p.charset")


def parsed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mails(spark, sf_dir).filter("error IS NULL").select("mail_id", "raw").dropDuplicates().select("mail_id", mime.headers("raw").alias("h"))
    return m.select("mail_id", *[F.col("h")[n].alias("hdr_" + n.lower().replace("-", "_")) for n in mime.HEADER_NAMES])


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that parsing rejects."""
    return src.rejects(src.parsed(table(spark, sf_dir, "mails").select("mail_id", "raw"))).select("mail_id")


def mail_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages")
    return m.select("delivery_id", src.mail_hash(F.col("hdr_message_id"), F.col("hdr_to")).alias("mail_hash"), src.eml_file_name(F.col("hdr_date"), F.col("hdr_message_id"), F.col("hdr_to")).alias("file_name"))


def leaf_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of clusters' member paths as a tree; folders with subfolders are none."""
    files = table(spark, sf_dir, "clusters").select(F.regexp_extract("member", r"^(.*)/", 1).alias("folder"), F.regexp_extract("member", r"([^/]*)$", 1).alias("name")).distinct()
    return src.leaf_clusters(files)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text parts put back into their raw message and read again: (mail_id, same)."""
    m = _mails(spark, sf_dir).filter("error IS NULL").select("mail_id", "raw", "payloads").dropDuplicates(["mail_id"])
    parts = F.transform("payloads", lambda p: F.struct(p.content_type.alias("kind"), p.content.alias("content"), p.encoding.alias("encoding"), p.charset.alias("charset")))
    t = m.select("mail_id", "raw", "payloads", mime.part_texts(parts).alias("texts"))
    again = t.select("mail_id", "texts", mime.payloads(mime.update_content("raw", "payloads", "texts")).alias("p2"))
    parts2 = F.transform("p2", lambda p: F.struct(p.content_type.alias("kind"), p.content.alias("content"), p.encoding.alias("encoding"), p.charset.alias("charset")))
    return again.select("mail_id", (F.array_join(F.transform(mime.part_texts(parts2), F.rtrim), "|") == F.array_join(F.transform("texts", F.rtrim), "|")).alias("same"))


# ---- features


def mail_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven features from the raw messages, line breaks in one form, as transport doesn't keep it; the skeleton has its own query."""
    f = feat.extracted(_mails(spark, sf_dir)).drop("html_skeletons")
    return f.withColumns({c: F.replace(c, F.lit("\r\n"), F.lit("\n")) for c in ("text_payloads", "html_payloads")})


def html_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_features(spark, sf_dir).select("mail_id", "html_payloads")).select("mail_id", mime.html_skeleton("html_payloads").alias("skeleton"))


def uri_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spread(_visible(spark, sf_dir))
    return v.select("mail_id", feat.uri_amount(F.col("text")).alias("uri_amount"), feat.schemes(F.col("text")).alias("schemes_string"), feat.hosts(F.col("text")).alias("hosts_string"), F.array_join(feat.hosts_clean(F.col("text")), " ").alias("hosts_clean"))


def payload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _mails(spark, sf_dir).filter("error IS NULL").select("mail_id", "payloads").dropDuplicates(["mail_id"])
    kinds = F.transform("payloads", lambda x: F.when(x.content_type == "PLAINTEXT", "text").when(x.content_type == "HTMLTEXT", "html").when(x.content_type == "IMAGE", "image").otherwise(""))
    return p.select("mail_id", F.array_join(kinds, "").alias("payload_types"))


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("delivery_id", feat.size_bucket(F.col("n_bytes") * 100).alias("bucket"))


def categorical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.selected(_features(spark, sf_dir), non_categorical=False)


def non_categorical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.selected(_features(spark, sf_dir), categorical=False)


# ---- pseudonyms


def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers of every text part, plain or HTML."""
    parts = _features(spark, sf_dir).select("mail_id", F.explode(F.array("text_payloads", "html_payloads")).alias("text"))
    return spread(parts).select("mail_id", F.explode(anonymize.phone_numbers(F.col("text"))).alias("phone")).distinct()


def _domains(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["domain"] for r in table(spark, sf_dir, "block_domains").select("domain").distinct().collect()]  # a bounded list


def listed_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_visible(spark, sf_dir)).select("mail_id", F.explode(anonymize.listed_mailboxes(F.col("text"), _domains(spark, sf_dir))).alias("mailbox"))


def recipient_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("delivery_id", F.explode(anonymize.recipient_words(F.col("hdr_to"))).alias("word"))


def pseudonymized_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain texts with listed mailboxes under pseudonyms, natively; anonymized_mails does the whole job."""
    v = spread(_features(spark, sf_dir).select("mail_id", "text_payloads"))
    pairs = anonymize.keyed(anonymize.listed_mailboxes(F.col("text_payloads"), _domains(spark, sf_dir)), "email")
    return v.select("mail_id", anonymize.replaced(F.col("text_payloads"), pairs).alias("text"))


def anonymized_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mails(spark, sf_dir).dropDuplicates(["mail_id"])
    return anonymize.anonymized(m, _domains(spark, sf_dir)).select("mail_id", "raw", F.col("headers")["To"].alias("hdr_to"), F.array_join("texts", "\n").alias("text"), "n_keys")


# ---- clusterings


def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.long_form(_features(spark, sf_dir), CAT)


def attribute_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.attribute_entropy(feature_long(spark, sf_dir).withColumn("node", F.lit("")), ["node"]).select("attr", "attr_pos", "n_values", "entropy")


def node_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grouping.attribute_entropy(feature_long(spark, sf_dir).withColumn("node", F.lit("")), ["node"])
    return grouping.node_split(e, ["node"], 50.0).select("impurity", "split_attr")


def cctree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold 50 on the categorical features, clusters named by their least mail."""
    return grouping.renamed_by_member(grouping.entropy_tree(_features(spark, sf_dir), CAT, 50.0))


def cctree_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold that some node may reach, so that the tree is grown level by level."""
    return grouping.renamed_by_member(grouping.entropy_tree(_features(spark, sf_dir), CAT, 14.0))


def fptree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.value_paths(_features(spark, sf_dir), CAT).select("mail_id", F.array_join("path", "|").alias("path"))


def fptree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.renamed_by_member(grouping.prefix_tree(_features(spark, sf_dir), CAT))


def clope_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.transactions_observed(_features(spark, sf_dir), len(CAT), 1.0)


def clope_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.transactions(_features(spark, sf_dir), CAT, 2.0)


def clope_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    p = grouping.profit(grouping.renamed_by_member(grouping.prefix_tree(f, CAT)), f, CAT, 2.0)
    return p.select("n_clusters", F.round("profit", 6).alias("profit"))


def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return grouping.cluster_statistics(fptree_clusters(spark, sf_dir), f, CAT)


def ctph_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.signatures(table(spark, sf_dir, "features"), piecewise.joined_features(feat.FEATURES))


def ctph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.piecewise_clusters(table(spark, sf_dir, "features"), piecewise.joined_features(feat.FEATURES), 80)


# ---- comparison


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def cluster_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters without the mails that parsing rejects."""
    gone = table(spark, sf_dir, "mails").filter("error IS NOT NULL").select(F.col("mail_id").alias("member"))
    return compare.removed(_runs(spark, sf_dir), gone)


def cluster_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.inverted(_runs(spark, sf_dir)).select("member", F.array_join("clusters", " ").alias("clusters"))


def cluster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the largest gold cluster against those of the largest ctph cluster."""
    runs = _runs(spark, sf_dir)
    top = runs.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.max(F.struct("n", "cluster_id")).alias("m")).select("run_id", "m.cluster_id")
    big = runs.join(top, ["run_id", "cluster_id"], "left_semi")
    return compare.pair_difference(big.filter("run_id = 'gold'"), big.filter("run_id = 'ctph_t80'"))


def overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overlap(_gold(spark, sf_dir), _tests(spark, sf_dir))


def mutual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.mutual_match(overlap_jaccard(spark, sf_dir)).select("run_id", "gold_id", "cluster_id", "jaccard")


def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.match_status(_gold(spark, sf_dir), _tests(spark, sf_dir))


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_counts(_gold(spark, sf_dir), _tests(spark, sf_dir))


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.contingency(_gold(spark, sf_dir), _tests(spark, sf_dir))


def unmatched_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.unmatched_members(_gold(spark, sf_dir), _tests(spark, sf_dir))


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pair_metrics(contingency(spark, sf_dir))


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.label_metrics(_gold(spark, sf_dir), _tests(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.profile(_runs(spark, sf_dir))


def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand in several orders: members of more than one cluster."""
    runs = table(spark, sf_dir, "lineitem").select(F.lit("orders").alias("run_id"), F.col("l_orderkey").cast("string").alias("cluster_id"), F.col("l_partkey").cast("string").alias("member"))
    return compare.duplicate_members(runs).select("member", F.size("clusters").alias("n_clusters"), F.element_at("clusters", 1).alias("first_cluster"))


def f1_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.f1_baselines(_runs(spark, sf_dir))


def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.report(_runs(spark, sf_dir))


def cctree_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.renamed_by_member(grouping.entropy_tree(_features(spark, sf_dir), feat.FEATURES, 50.0))


def fptree_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.renamed_by_member(grouping.prefix_tree(_features(spark, sf_dir), feat.FEATURES))


def clope_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve features at repulsion 10."""
    return grouping.transactions_observed(_features(spark, sf_dir), len(feat.FEATURES), 10.0)


def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, Rand index and the fate of every cluster, as lines."""
    return compare.diff_report(_gold(spark, sf_dir), _tests(spark, sf_dir))


def sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusterings of features against the gold run of clusters."""
    return sweep(_features(spark, sf_dir), _gold(spark, sf_dir), SWEEP)


QUERIES = {f.__name__: f for f in (
    parsed_mails, parsed_headers, rejects, mail_file_names, leaf_clusters, round_trip, mail_features, html_skeletons, uri_features, payload_types, size_buckets, categorical_features,
    non_categorical_features, phone_numbers, listed_mailboxes, recipient_words, pseudonymized_mailboxes, anonymized_mails, feature_long, attribute_entropy, node_split, cctree_clusters, cctree_loop,
    fptree_paths, fptree_clusters, clope_observed, clope_paper, clope_profit, cluster_statistics, ctph_signatures, ctph_clusters, cluster_members, cluster_remove, cluster_inverted, cluster_diff,
    overlap_jaccard, mutual_match, match_status, diff_counts, contingency, unmatched_members, pair_metrics, label_metrics, profile, duplicate_members, f1_baselines, profile_report, sweep_metrics, cctree_all_features, fptree_all_features, clope_all_features, diff_report)}

_URI = feat.URI.replace("'", "''")
_F = "f AS (SELECT DISTINCT * FROM features)"
_V = f"{_F}, v AS (SELECT mail_id, text_payloads || html_payloads AS text FROM f)"
_CELLS = f"{_F}, cells AS (" + " UNION ALL ".join(f"SELECT mail_id, {i} AS attr_pos, '{a}' AS attr, {a} AS value FROM f" for i, a in enumerate(CAT)) + ")"
_ENTROPY = f"""{_CELLS}, n AS (SELECT attr, attr_pos, value, count(*) AS n FROM cells GROUP BY ALL),
ent AS (SELECT attr, attr_pos, count(*) AS n_values, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) AS entropy FROM n GROUP BY attr, attr_pos)"""
_PATHS = f"""{_CELLS}, vn AS (SELECT value, count(*) AS n FROM cells GROUP BY value),
paths AS (SELECT mail_id, list(value ORDER BY n DESC, attr_pos) AS path FROM cells JOIN vn USING (value) GROUP BY mail_id),
fp AS (SELECT mail_id, min(mail_id) OVER (PARTITION BY path[1:{len(CAT) - 1}]) AS cluster_id FROM paths)"""
_RUNS = r"""runs AS (SELECT DISTINCT run_id, regexp_replace(lower(trim(cluster_id)), '^urn:uuid:|[{}-]', '', 'g') AS cluster_id, regexp_extract(member, '([^/\\]*)$', 1) AS member FROM clusters),
gold AS (SELECT cluster_id AS gold_id, member FROM runs WHERE run_id = 'gold'), tests AS (SELECT * FROM runs WHERE run_id <> 'gold')"""
_OVER = f"""{_RUNS}, both_ AS (SELECT run_id, gold_id, cluster_id, count(*) AS tp FROM gold JOIN tests USING (member) GROUP BY ALL),
ng AS (SELECT gold_id, count(*) AS n_gold FROM gold GROUP BY ALL), no_ AS (SELECT run_id, cluster_id, count(*) AS n_other FROM tests GROUP BY ALL),
ov AS (SELECT run_id, gold_id, cluster_id, tp, n_gold, n_other, round(tp / (n_gold + n_other - tp), 9) AS jaccard FROM both_ JOIN ng USING (gold_id) JOIN no_ USING (run_id, cluster_id)),
mm AS (SELECT run_id, gold_id, cluster_id, jaccard, tp, n_gold, n_other FROM ov QUALIFY row_number() OVER (PARTITION BY run_id, gold_id ORDER BY jaccard DESC, cluster_id) = 1 AND row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY jaccard DESC, gold_id) = 1),
st AS (SELECT run_id, gold_id, cluster_id, 'matched' AS status FROM mm
  UNION ALL SELECT r.run_id, g.gold_id, NULL, 'missing' FROM (SELECT DISTINCT run_id FROM tests) r CROSS JOIN (SELECT DISTINCT gold_id FROM gold) g WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.run_id = r.run_id AND mm.gold_id = g.gold_id)
  UNION ALL SELECT run_id, NULL, cluster_id, 'additional' FROM (SELECT DISTINCT run_id, cluster_id FROM tests) t WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.run_id = t.run_id AND mm.cluster_id = t.cluster_id)),
con AS (SELECT run_id, gold_id, cluster_id, count(*) AS n FROM gold JOIN tests USING (member) GROUP BY ALL)"""
_F12 = ", ".join(feat.FEATURES)
_CELLS12 = f"{_F}, cells AS (" + " UNION ALL ".join(f"SELECT mail_id, {i} AS attr_pos, {a} AS value FROM f" for i, a in enumerate(feat.FEATURES)) + ")"
_NAMES = ("accuracy", "precision", "recall", "f1_macro", "f1_micro")
ORACLES = {
    "round_trip": "SELECT DISTINCT mail_id, true AS same FROM mails WHERE error IS NULL",
    "cctree_all_features": f"WITH {_F} SELECT mail_id, min(mail_id) OVER (PARTITION BY {_F12}) AS cluster_id FROM f",
    "fptree_all_features": f"""WITH {_CELLS12}, vn AS (SELECT value, count(*) AS n FROM cells GROUP BY value), paths AS (SELECT mail_id, list(value ORDER BY n DESC, attr_pos) AS path FROM cells JOIN vn USING (value) GROUP BY mail_id)
SELECT mail_id, min(mail_id) OVER (PARTITION BY path[1:11]) AS cluster_id FROM paths""",
    "clope_all_features": "SELECT mail_id, row_number() OVER (ORDER BY mail_id) - 1 AS cluster_id FROM (SELECT DISTINCT mail_id FROM features)",
    "parsed_mails": "SELECT mail_id, ord, pos - 1 AS pos, p.\"start\" AS p_start, p.\"end\" AS p_end, p.content, p.content_type, p.encoding, p.extension, p.charset FROM (SELECT mail_id, ord, unnest(payloads) AS p, generate_subscripts(payloads, 1) AS pos FROM (SELECT DISTINCT * FROM mails) WHERE error IS NULL)",
    "parsed_headers": "SELECT DISTINCT mail_id, headers['From'] AS hdr_from, headers['To'] AS hdr_to, headers['Sender'] AS hdr_sender, headers['Subject'] AS hdr_subject, headers['Thread-Topic'] AS hdr_thread_topic FROM mails WHERE error IS NULL",
    "rejects": "SELECT DISTINCT mail_id FROM mails WHERE error IS NOT NULL",
    "mail_file_names": r"""WITH d AS (SELECT *, regexp_replace(hdr_date, ' \(.+\)', '') AS d, md5(coalesce(hdr_message_id, 'None') || coalesce(hdr_to, 'None')) AS mail_hash FROM messages)
SELECT delivery_id, mail_hash, CASE WHEN regexp_full_match(d, '[A-Za-z]{3}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}') THEN
  regexp_extract(d, '(\d{4}) \d{2}:', 1) || '-' || lpad(CAST((instr('JanFebMarAprMayJunJulAugSepOctNovDec', regexp_extract(d, '\d ([A-Z][a-z]{2}) ', 1)) + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(d, ', (\d{1,2}) ', 1), 2, '0') || '-' || regexp_extract(d, '(\d{2}:\d{2}:\d{2})', 1) || '_' || mail_hash || '.eml' END AS file_name FROM d""",
    "leaf_clusters": r"""WITH f AS (SELECT DISTINCT regexp_extract(member, '^(.*)/', 1) AS folder, regexp_extract(member, '([^/]*)$', 1) AS name FROM clusters)
SELECT folder AS cluster_id, name AS member FROM f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT folder FROM f) o WHERE starts_with(o.folder, f.folder || '/'))""",
    "mail_features": "SELECT DISTINCT * EXCLUDE (html_skeletons) REPLACE (replace(text_payloads, chr(13) || chr(10), chr(10)) AS text_payloads, replace(html_payloads, chr(13) || chr(10), chr(10)) AS html_payloads) FROM features",
    "uri_features": rf"""WITH {_V}, u AS (SELECT mail_id, text, regexp_extract_all(text, '{_URI}', 1) AS s, list_transform(regexp_extract_all(text, '{_URI}', 3), lambda h: coalesce(nullif(h, ''), 'None')) AS h FROM v)
SELECT mail_id, CAST(len(s) AS VARCHAR) AS uri_amount, coalesce(array_to_string(list_sort(list_distinct(s)), ''), '') AS schemes_string, coalesce(array_to_string(list_sort(list_distinct(h)), ''), '') AS hosts_string,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:https?|ftp)://(?:[^\s/@]*@)?([A-Za-z0-9.-]+)', 1), lambda x: lower(x)))), ' '), '') AS hosts_clean FROM u""",
    "payload_types": "SELECT mail_id, coalesce(array_to_string(list_transform(payloads, lambda p: CASE p.content_type WHEN 'PLAINTEXT' THEN 'text' WHEN 'HTMLTEXT' THEN 'html' WHEN 'IMAGE' THEN 'image' ELSE '' END), ''), '') AS payload_types FROM (SELECT DISTINCT mail_id, payloads FROM mails WHERE error IS NULL)",
    "size_buckets": "SELECT delivery_id, CAST(least(n_bytes * 100 // 65536 + 1, 256) * 65536 AS VARCHAR) AS bucket FROM messages",
    "categorical_features": f"WITH {_F} SELECT mail_id, {', '.join(CAT)} FROM f",
    "non_categorical_features": f"WITH {_F} SELECT mail_id, {', '.join(feat.NON_CATEGORICAL)} FROM f",
    "phone_numbers": rf"WITH {_F}, p AS (SELECT mail_id, text_payloads AS t FROM f UNION ALL SELECT mail_id, html_payloads FROM f) SELECT DISTINCT mail_id, unnest(regexp_extract_all(t, '{anonymize.PHONE}')) AS phone FROM p",
    "listed_mailboxes": rf"WITH {_V}, b AS (SELECT DISTINCT mail_id, unnest(regexp_extract_all(text, '[-a-zA-Z0-9_.]+@[-a-zA-Z0-9_.]*' || replace(replace(domain, '.', '\.'), '-', '\-'))) AS mailbox FROM v CROSS JOIN block_domains) SELECT * FROM b",
    "feature_long": f"WITH {_CELLS} SELECT * FROM cells",
    "attribute_entropy": f"WITH {_ENTROPY} SELECT attr, attr_pos, n_values, entropy FROM ent",
    "node_split": f"WITH {_ENTROPY} SELECT round(sum(entropy), 9) AS impurity, CASE WHEN round(sum(entropy), 9) < 50 THEN first(attr ORDER BY entropy DESC, attr_pos) END AS split_attr FROM ent",
    "cctree_clusters": f"WITH {_F} SELECT mail_id, min(mail_id) OVER (PARTITION BY {', '.join(CAT)}) AS cluster_id FROM f",
    "fptree_paths": f"WITH {_PATHS} SELECT mail_id, array_to_string(path, '|') AS path FROM paths",
    "fptree_clusters": f"WITH {_PATHS} SELECT mail_id, cluster_id FROM fp",
    "clope_observed": f"SELECT mail_id, (row_number() OVER (ORDER BY mail_id) - 1) // 3 AS cluster_id FROM (SELECT DISTINCT mail_id FROM features)",
    "clope_profit": f"""WITH {_PATHS}, s AS (SELECT cluster_id, count(*) AS s, count(DISTINCT (attr, value)) AS w, count(DISTINCT mail_id) AS m FROM cells JOIN fp USING (mail_id) GROUP BY cluster_id)
SELECT count(*) AS n_clusters, round(sum(s * m / pow(w, 2)) / sum(m), 6) AS profit FROM s""",
    "cluster_statistics": f"WITH {_PATHS} SELECT cluster_id, count(DISTINCT mail_id) AS n_members, count(*) AS size, count(DISTINCT (attr, value)) AS width FROM cells JOIN fp USING (mail_id) GROUP BY cluster_id",
    "cluster_members": f"WITH {_RUNS} SELECT run_id, cluster_id, member FROM runs",
    "cluster_remove": f"WITH {_RUNS} SELECT run_id, cluster_id, member FROM runs WHERE member NOT IN (SELECT mail_id FROM mails WHERE error IS NOT NULL)",
    "cluster_inverted": f"WITH {_RUNS} SELECT member, string_agg(DISTINCT cluster_id, ' ' ORDER BY cluster_id) AS clusters FROM runs GROUP BY member",
    "cluster_diff": f"""WITH {_RUNS}, top AS (SELECT run_id, cluster_id FROM runs GROUP BY run_id, cluster_id QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, cluster_id DESC) = 1),
a AS (SELECT member FROM runs JOIN top USING (run_id, cluster_id) WHERE run_id = 'gold'), b AS (SELECT member FROM runs JOIN top USING (run_id, cluster_id) WHERE run_id = 'ctph_t80')
SELECT coalesce(a.member, b.member) AS member, CASE WHEN a.member IS NULL THEN 'false_positive' WHEN b.member IS NULL THEN 'false_negative' ELSE 'true_positive' END AS status FROM a FULL JOIN b ON a.member = b.member""",
    "overlap_jaccard": f"WITH {_OVER} SELECT * FROM ov",
    "mutual_match": f"WITH {_OVER} SELECT run_id, gold_id, cluster_id, jaccard FROM mm",
    "match_status": f"WITH {_OVER} SELECT * FROM st",
    "diff_counts": f"""WITH {_OVER}, k AS (SELECT count(DISTINCT member) AS n, count(DISTINCT gold_id) AS g FROM gold), ins AS (SELECT run_id, cluster_id, count(*) AS ni FROM tests WHERE member IN (SELECT member FROM gold) GROUP BY ALL)
SELECT st.run_id, CAST(sum(CASE WHEN status = 'matched' THEN tp ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN status = 'matched' THEN k.n - ng.n_gold - coalesce(ni, 0) + tp ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE status WHEN 'matched' THEN no_.n_other - tp WHEN 'additional' THEN no_.n_other ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE status WHEN 'matched' THEN ng.n_gold - tp WHEN 'missing' THEN ng.n_gold ELSE 0 END) AS BIGINT) AS fn,
  any_value(k.n) AS n, any_value(k.g) AS n_gold_clusters, CAST(sum(CASE WHEN status <> 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS n_clusters
FROM st CROSS JOIN k LEFT JOIN ng USING (gold_id) LEFT JOIN no_ ON no_.run_id = st.run_id AND no_.cluster_id = st.cluster_id LEFT JOIN both_ ON both_.run_id = st.run_id AND both_.gold_id = st.gold_id AND both_.cluster_id = st.cluster_id LEFT JOIN ins ON ins.run_id = st.run_id AND ins.cluster_id = st.cluster_id GROUP BY st.run_id""",
    "contingency": f"WITH {_OVER} SELECT * FROM con",
    "unmatched_members": f"WITH {_RUNS} SELECT run_id, count(DISTINCT member) AS n_unmatched FROM tests WHERE member NOT IN (SELECT member FROM gold) GROUP BY run_id",
    "pair_metrics": f"""WITH {_OVER}, a AS (SELECT run_id, gold_id, CAST(sum(n) AS DOUBLE) AS a FROM con GROUP BY ALL), b AS (SELECT run_id, cluster_id, CAST(sum(n) AS DOUBLE) AS b FROM con GROUP BY ALL), t AS (SELECT run_id, CAST(sum(n) AS DOUBLE) AS t FROM con GROUP BY ALL),
i AS (SELECT run_id, sum(n * (n - 1) / 2) AS pij, sum(n / t * ln(n * t / (a * b))) AS mi FROM con JOIN a USING (run_id, gold_id) JOIN b USING (run_id, cluster_id) JOIN t USING (run_id) GROUP BY run_id),
pa AS (SELECT run_id, sum(a * (a - 1) / 2) AS pa, ln(any_value(t)) - sum(a * ln(a)) / any_value(t) AS ha FROM a JOIN t USING (run_id) GROUP BY run_id),
pb AS (SELECT run_id, sum(b * (b - 1) / 2) AS pb, ln(any_value(t)) - sum(b * ln(b)) / any_value(t) AS hb FROM b JOIN t USING (run_id) GROUP BY run_id),
sa AS (SELECT run_id, a, count(*) AS ca FROM a GROUP BY ALL), sb AS (SELECT run_id, b, count(*) AS cb FROM b GROUP BY ALL),
k AS (SELECT run_id, a, b, ca, cb, t, CAST(unnest(generate_series(CAST(greatest(1, a + b - t) AS BIGINT), CAST(least(a, b) AS BIGINT))) AS DOUBLE) AS x FROM sa JOIN sb USING (run_id) JOIN t USING (run_id)),
e AS (SELECT run_id, sum(ca * cb * x / t * ln(t * x / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(t - a - b + x + 1))) AS emi FROM k GROUP BY run_id)
SELECT run_id, round((t * (t - 1) / 2 + 2 * pij - pa - pb) / (t * (t - 1) / 2), 6) AS ri, round((pij - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami
FROM t JOIN i USING (run_id) JOIN pa USING (run_id) JOIN pb USING (run_id) JOIN e USING (run_id)""",
    "label_metrics": f"""WITH {_OVER}, tt AS (SELECT con.run_id, 'g' || con.gold_id AS truth, coalesce('g' || mm.gold_id, 'c' || con.cluster_id) AS guess, n FROM con LEFT JOIN mm ON mm.run_id = con.run_id AND mm.cluster_id = con.cluster_id),
u AS (SELECT run_id, truth AS label, n AS g, 0 AS t, CASE WHEN truth = guess THEN n ELSE 0 END AS h FROM tt UNION ALL SELECT run_id, guess, 0, n, 0 FROM tt), p AS (SELECT run_id, label, sum(g) AS g, sum(t) AS t, sum(h) AS h FROM u GROUP BY ALL)
SELECT run_id, round(sum(h) / sum(g), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN h / t ELSE 0 END), 6) AS precision, round(avg(CASE WHEN g > 0 THEN h / g ELSE 0 END), 6) AS recall, round(avg(2 * h / (g + t)), 6) AS f1_macro, round(sum(h) / sum(g), 6) AS f1_micro FROM p GROUP BY run_id""",
    "profile": f"""WITH {_RUNS}, k AS (SELECT run_id, member, count(DISTINCT cluster_id) AS k FROM runs GROUP BY ALL), c AS (SELECT run_id, count(DISTINCT cluster_id) AS n_clusters FROM runs GROUP BY run_id)
SELECT run_id, count(*) AS n_members, any_value(n_clusters) AS n_clusters, round(count(*) / any_value(n_clusters), 6) AS avg_cluster_size, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicates FROM k JOIN c USING (run_id) GROUP BY run_id""",
    "duplicate_members": "SELECT CAST(l_partkey AS VARCHAR) AS member, CAST(count(DISTINCT l_orderkey) AS INTEGER) AS n_clusters, min(CAST(l_orderkey AS VARCHAR)) AS first_cluster FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1",
    "f1_baselines": f"""WITH {_RUNS}, r AS (SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY cluster_id) - 1 AS label, row_number() OVER (PARTITION BY run_id ORDER BY cluster_id, member) - 1 AS i FROM runs),
s AS (SELECT run_id, label, count(*) AS s, sum(CASE WHEN i = label THEN 1 ELSE 0 END) AS hit FROM r GROUP BY ALL), n AS (SELECT run_id, count(*) AS n, greatest(count(DISTINCT label), 2) AS k FROM r GROUP BY run_id)
SELECT run_id, round(sum(CASE WHEN label = 1 THEN 2 * s / (s + n) ELSE 0 END) / any_value(k), 6) AS f1_macro_all_in_one, round(sum(CASE WHEN label = 1 THEN s ELSE 0 END) / any_value(n), 6) AS f1_micro_all_in_one,
  round(sum(CASE WHEN hit > 0 THEN 2 / (s + 1) ELSE 0 END) / any_value(n), 6) AS f1_macro_one_for_each, round(sum(hit) / any_value(n), 6) AS f1_micro_one_for_each FROM s JOIN n USING (run_id) GROUP BY run_id""",
    "recipient_words": r"""WITH m AS (SELECT delivery_id, regexp_extract(hdr_to, '^"?([\p{L}\p{N}_\-]+,?(?:\s[\p{L}\p{N}_\-]+)+)', 1) AS n, regexp_extract(hdr_to, '<?([\p{L}\p{N}_\-]+(?:\.?[\p{L}\p{N}_\-]+)*@[\p{L}\p{N}_\-]+(?:\.[-\p{L}\p{N}_]+)+)>?', 1) AS e FROM messages WHERE hdr_to IS NOT NULL),
w AS (SELECT delivery_id, list_concat(CASE WHEN n <> '' THEN list_transform(string_split_regex(n, '\s+'), lambda x: rtrim(x, ',')) ELSE [] END, CASE WHEN e <> '' THEN list_concat([split_part(e, '@', 1)], string_split(split_part(e, '@', 1), '.')) ELSE [] END) AS ws FROM m)
SELECT delivery_id, unnest(list_filter(list_distinct(ws), lambda x: length(x) > 0)) AS word FROM w""",
    "pseudonymized_mailboxes": rf"""WITH {_F}, d AS (SELECT list(DISTINCT domain ORDER BY domain) AS ds FROM block_domains),
b AS (SELECT mail_id, text_payloads, list_distinct(flatten(list_transform(ds, lambda x: regexp_extract_all(text_payloads, '[-a-zA-Z0-9_.]+@[-a-zA-Z0-9_.]*' || replace(replace(x, '.', '\.'), '-', '\-'))))) AS boxes FROM f CROSS JOIN d)
SELECT mail_id, list_reduce(list_prepend(text_payloads, boxes), lambda acc, m: replace(acc, m, 'u' || substr(md5('{anonymize.SALT}' || lower(m)), 1, 10) || '@example.org')) AS text FROM b""",
}

ORACLES["profile_report"] = f"""SELECT run_id, printf('%d members in %d clusters (%.3f each), %d in several; F1 all in one %.3f, one for each %.3f', n_members, n_clusters, avg_cluster_size, n_duplicates, f1_macro_all_in_one, f1_macro_one_for_each) AS line
FROM ({ORACLES["profile"]}) JOIN ({ORACLES["f1_baselines"]}) USING (run_id)"""
ORACLES["diff_report"] = f"""SELECT run_id, printf('tn=%d, fn=%d, tp=%d, fp=%d, n=%d; %d gold clusters, %d clusters', tn, fn, tp, fp, n, n_gold_clusters, n_clusters) AS line FROM ({ORACLES["diff_counts"]})
UNION ALL SELECT run_id, printf('Rand index %.6f', ri) FROM ({ORACLES["pair_metrics"]})
UNION ALL SELECT run_id, CASE status WHEN 'matched' THEN printf('%s matches %s (Jaccard %.3f)', gold_id, cluster_id, jaccard) WHEN 'missing' THEN 'no match for ' || gold_id ELSE 'new cluster ' || cluster_id END
FROM ({ORACLES["match_status"]}) LEFT JOIN ({ORACLES["overlap_jaccard"]}) USING (run_id, gold_id, cluster_id)"""
#: In these tables no node below the root reaches the threshold, so the root alone decides: equal rows, or one leaf.
ORACLES["cctree_loop"] = f"""WITH {_ENTROPY}, root AS (SELECT round(sum(entropy), 9) AS impurity FROM ent)
SELECT mail_id, min(mail_id) OVER () AS cluster_id FROM (SELECT DISTINCT mail_id FROM f) CROSS JOIN root WHERE impurity >= 14
UNION ALL SELECT mail_id, min(mail_id) OVER (PARTITION BY {', '.join(CAT)}) FROM f CROSS JOIN root WHERE impurity < 14"""
