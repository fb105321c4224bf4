"""python -m mailloom COMMAND ...: the library's jobs on folders of mail.

  split MAILBOX OUT              one .eml file per message of a mailbox, named by date and hash
  show IN                        the mails in IN: headers and parts, one line each
  tree DIR                       the files below a folder
  features IN OUT                the twelve features of the mails in IN, as Parquet
  anonymize IN OUT [LIST]        mails under pseudonyms; LIST holds domains, one a line; rejects go to OUT/_rejects
  cluster ALGORITHM IN OUT [P]   folders of links, one per cluster; P is the algorithm's parameter
  sweep IN GOLD OUT              every job of the sweep against the cluster folders in GOLD; links below OUT/<job>
  diff GOLD OTHER                two trees of cluster folders against each other
  duplicates DIR                 profile of a tree of cluster folders, and members of several clusters
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators import anonymize, compare
from mailloom.operators.features import extracted
from mailloom.operators.sweep import ALGORITHMS, SWEEP, clusterings
from mailloom.plans.storage import written
from mailloom.sources import mails as src


def mails_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mails, files): a file, or the .eml files of a folder."""
    files = src.read_eml(spark, path)
    return written(src.parsed(files.select("mail_id", "raw")), "mails"), files


def split(spark: SparkSession, mailbox: str, out: str) -> None:
    from mailloom.functions import mime

    rows = src.read_mbox(spark, mailbox).select("raw", mime.all_headers("raw").alias("h"))
    name = src.eml_file_name(F.col("h")["date"], F.col("h")["message-id"], F.col("h")["to"])
    # Hadoop's local file system can't read names with colons
    src.write_eml(rows.select(F.translate(name, ":", "-").alias("mail_id"), "raw"), os.path.join(out, os.path.basename(mailbox.rstrip("/"))))


def features(spark: SparkSession, path: str, out: str) -> None:
    extracted(mails_of(spark, path)[0]).write.mode("overwrite").parquet(out)


def anonymized(spark: SparkSession, path: str, out: str, block_list: str | None = None) -> None:
    domains = [r["domain"] for r in src.read_block_list(spark, block_list).collect()] if block_list else []
    mails, _ = mails_of(spark, path)
    src.write_eml(anonymize.anonymized(mails.filter("error IS NULL"), domains), out)
    src.write_rejects(mails, os.path.join(out, "_rejects"))


def _links(runs: DataFrame, files: DataFrame, out: str) -> None:
    paths = files.select("mail_id", F.regexp_replace("path", "^file:(//)?", "").alias("path"))
    src.export_links(runs.join(paths, F.col("member") == F.col("mail_id")).select("cluster_id", F.col("path").alias("member")), out)


def cluster(spark: SparkSession, algorithm: str, path: str, out: str, parameter: str | None = None) -> None:
    mails, files = mails_of(spark, path)
    job = (algorithm,) if parameter is None else (algorithm, float(parameter) if "." in parameter or algorithm.startswith("clope") else int(parameter))
    _links(clusterings(written(extracted(mails), "features"), {"job": job}), files, out)


def _folders(spark: SparkSession, path: str) -> DataFrame:
    return src.leaf_clusters(src.tree(spark, path))


def sweep_jobs(spark: SparkSession, path: str, gold: str, out: str) -> DataFrame:
    mails, files = mails_of(spark, path)
    runs = written(clusterings(written(extracted(mails), "features"), SWEEP), "runs")
    known = compare.removed(_folders(spark, gold), src.rejects(mails).select(F.col("mail_id").alias("member")))
    for job in SWEEP:
        _links(runs.filter(F.col("run_id") == job), files, os.path.join(out, job))
    return compare.metrics(compare.members(known).withColumnRenamed("cluster_id", "gold_id"), compare.members(runs, "run_id"))


def diff(spark: SparkSession, gold: str, other: str) -> DataFrame:
    g = compare.members(_folders(spark, gold)).withColumnRenamed("cluster_id", "gold_id")
    return compare.diff_report(g, compare.members(_folders(spark, other).withColumn("run_id", F.lit("other")), "run_id"))


def duplicates(spark: SparkSession, path: str) -> DataFrame:
    runs = compare.members(_folders(spark, path).withColumn("run_id", F.lit("tree")), "run_id")
    lines = compare.duplicate_members(runs).select("run_id", F.format_string("%s in %s", "member", F.array_join("clusters", ", ")).alias("line"))
    return compare.report(runs).unionByName(lines)


def show(spark: SparkSession, path: str) -> DataFrame:
    """(mail_id, line): error or headers, then a line per part."""
    mails, _ = mails_of(spark, path)
    heads = F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), F.coalesce(e.value, F.lit("-"))))
    parts = F.transform("payloads", lambda p: F.format_string("%s %s %s at %d to %d, %d characters", p.content_type, p.encoding, F.coalesce(p.charset, p.extension), p.start, p.end, F.length(p.content)))
    lines = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("rejected: "), "error"))).otherwise(F.concat(heads, parts))
    return mails.select("mail_id", F.explode(lines).alias("line")).orderBy("mail_id")


def listing(spark: SparkSession, path: str) -> DataFrame:
    return src.tree(spark, path).select("folder", "name").orderBy("folder", "name")


COMMANDS = {"show": show, "tree": listing, "split": split, "features": features, "anonymize": anonymized, "cluster": cluster, "sweep": sweep_jobs, "diff": diff, "duplicates": duplicates}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in COMMANDS or args[0] == "cluster" and (len(args) < 4 or args[1] not in ALGORITHMS):
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("mailloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    got = COMMANDS[args[0]](spark, *args[1:])
    if got is not None:
        print(*got.columns, sep="\t")
        for row in got.toLocalIterator():  # every row, a partition at a time
            print(*("" if v is None else v for v in row), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
