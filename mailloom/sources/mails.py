"""Mail files, mailboxes and lists as DataFrames, and their way back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import mime
from mailloom.plans.rank import numbered
from mailloom.plans.storage import single_machine


def read_eml(spark: SparkSession, path: str, glob: str | None = "*.eml", recursive: bool = False) -> DataFrame:
    """(path, mail_id, raw) of the files of a folder or of one file; not recursive unless asked for."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob and not path.rstrip("/").endswith(glob.lstrip("*")):
        r = r.option("pathGlobFilter", glob)
    # bytes that are no utf-8 become U+FFFD
    return r.load(path).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("mail_id"), mime.utf8("content").alias("raw"))


def parsed(raw: DataFrame) -> DataFrame:
    """mails(mail_id, ord, raw, headers, payloads, error) of (mail_id, raw).

    A duplicate mail_id keeps its greatest raw text. A message that can't be used keeps its row with
    error set, no payloads and empty headers. ord is the 0-based rank by mail_id.
    """
    first = raw.groupBy("mail_id").agg(F.max("raw").alias("raw"))
    ranked = numbered(first.withColumn("_all", F.lit(0)), ["_all"], ["mail_id"], "ord", ordered=True).drop("_all")
    ranked = ranked.withColumn("error", F.when(F.col("raw").isNull(), "no text").otherwise(mime.flaw("raw")))
    ok = F.col("error").isNull()
    return ranked.select("mail_id", "ord", "raw", F.when(ok, mime.headers("raw")).otherwise(F.create_map().cast("map<string,string>")).alias("headers"), F.when(ok, mime.payloads("raw")).otherwise(F.array().cast(mime.PAYLOADS)).alias("payloads"), "error")


def rejects(mails: DataFrame) -> DataFrame:
    """The error log: (mail_id, error)."""
    return mails.filter(F.col("error").isNotNull()).select("mail_id", "error").distinct()


def write_rejects(mails: DataFrame, path: str) -> None:
    """The error log as a table."""
    rejects(mails).write.mode("overwrite").parquet(path)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(mailbox, number, raw) of mailboxes; globs and folders are welcome.

    A message begins with a line ``From `` at the start of the mailbox or after a line break; ``>From`` quoting is undone.
    Mailboxes are read by byte ranges, so one of any size is spread over many tasks and no more than a message is held
    at a time. What stands before the first such line is no message.
    """
    records = spark.read.option("lineSep", "\nFrom ").text(path).select("value", F.col("_metadata.file_path").alias("mailbox"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    # only a mailbox's first record still has its own "From " line, or isn't a message
    opening = records.filter("_block = 0").groupBy("mailbox").agg(F.min("_place").alias("_first"))
    rows = records.join(opening, "mailbox").withColumn("_own", F.col("_place") == F.col("_first")).filter(~F.col("_own") | F.col("value").startswith("From "))
    body = F.when(F.instr("value", "\n") > 0, F.substr(F.col("value"), F.instr("value", "\n") + 1)).otherwise(F.lit(""))
    raw = F.regexp_replace(body, r"(?m)^>(>*From )", "$1")
    return numbered(rows.select("mailbox", "_block", "_place", raw.alias("raw")), ["mailbox"], ["_block", "_place"], "number", ordered=True).select("mailbox", F.col("number").cast("int").alias("number"), "raw")


def mail_hash(message_id: Column, to: Column) -> Column:
    """md5 over Message-ID and To; a missing header counts as the text ``None``."""
    return F.md5(F.concat(F.coalesce(message_id, F.lit("None")), F.coalesce(to, F.lit("None"))).cast("binary"))


#: The date form of file names, with the sender's wall clock as it is written.
WALL_CLOCK = r"^[A-Za-z]{3}, (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) [+-]\d{4}$"
MONTH_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"


def eml_file_name(date: Column, message_id: Column, to: Column) -> Column:
    """``YYYY-MM-DD-HH:MM:SS_<hash>.eml`` in the sender's wall clock; null without a date of that form."""
    d = F.regexp_replace(date, r" \(.+\)", "")
    part = lambda i: F.regexp_extract(d, WALL_CLOCK, i)
    month = F.lpad(((F.position(part(2), F.lit(MONTH_NAMES)) + 2) / 3).cast("int").cast("string"), 2, "0")
    return F.when(d.rlike(WALL_CLOCK), F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("-"), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("_"), mail_hash(message_id, to), F.lit(".eml")))


def _on_shared(spark: SparkSession, folder: str) -> None:
    """A plain path is a folder of the executor's own machine, which only a local master's executors share."""
    if "://" not in folder and not single_machine(spark):
        raise ValueError(f"{folder}: name the file system, as in hdfs:// or s3://, or file:// for a folder mounted everywhere")


def write_eml(mails: DataFrame, folder: str, name: str = "mail_id") -> None:
    """One file per mail in a folder of a file system that all executors reach; rows without name or text are passed over."""
    _on_shared(mails.sparkSession, folder)

    def put(rows) -> None:
        import posixpath

        from pyarrow.fs import FileSystem, LocalFileSystem

        fs, root = FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            if r[0] and r[1] is not None:
                with fs.open_output_stream(posixpath.join(root, posixpath.basename(r[0]))) as f:
                    f.write(r[1].encode("utf-8", "replace"))

    mails.select(name, "raw").foreachPartition(put)


def read_block_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain): trimmed lines of a list, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("domain")).filter(F.col("domain") != "").distinct()


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select("path", F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def leaf_clusters(files: DataFrame) -> DataFrame:
    """(cluster_id, member) of the folders without subfolders; files: (folder, name).

    Files beside subfolders are passed over; folders without files can't be seen.
    """
    folders = files.select("folder").distinct()
    above = folders.select(F.explode(F.expr("transform(sequence(1, greatest(1, size(split(folder, '/')) - 1)), i -> array_join(slice(split(folder, '/'), 1, i), '/'))")).alias("folder"), F.col("folder").alias("of")).filter(F.col("folder") != F.col("of")).select("folder").distinct()
    return files.join(above, "folder", "left_anti").select(F.col("folder").alias("cluster_id"), F.col("name").alias("member")).distinct()


def write_clusters(clusters: DataFrame, path: str) -> None:
    """One folder per cluster with its members."""
    clusters.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def export_links(clusters: DataFrame, folder: str) -> None:
    """Symbolic links <folder>/<cluster_id>/<base name> to the member files, in a folder that all executors share.

    Two members of a cluster with one base name are an error, before any link is made. Object stores have no links:
    ``write_clusters`` serves there.
    """
    _on_shared(clusters.sparkSession, folder)
    root = folder.removeprefix("file://")
    rows = clusters.select("cluster_id", "member").distinct()
    twice = rows.groupBy("cluster_id", F.regexp_extract("member", r"([^/]*)$", 1).alias("name")).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['name']} stands {twice['count']} times in cluster {twice['cluster_id']}")

    def put(rows) -> None:
        import os

        for r in rows:
            d = os.path.join(root, r[0].replace("/", "_"))
            os.makedirs(d, exist_ok=True)
            target = os.path.join(d, os.path.basename(r[1]))
            if not os.path.lexists(target):  # made before a task was run again
                os.symlink(r[1], target)

    rows.foreachPartition(put)
