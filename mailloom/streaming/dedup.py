"""Exactly one row of each message, over a stream of deliveries.

Each micro-batch is folded into a keyed store of the identifiers seen so far, cut into hash buckets:

- rows of the batch are pre-aggregated by key (map-side combined, so a key that holds most of the
  rows costs a task no more than any other) and resolved against the live state and, late arrivals, the
  archive of expired keys, of the touched buckets only;
- the state is a log: a batch adds the keys it touched to their buckets, nothing else is written. A bucket is
  rewritten only when its log has grown to the size of its base, so a row is rewritten a number of
  times that grows with the logarithm of the state; then keys whose last row lies behind the watermark
  (latest event time less the horizon) move to the bucket's archive, which is kept the same way;
- everything of batch N lies under paths that N alone determines, and one small manifest says what is
  valid after it. All is written before the stream commits N to its checkpoint; after a failure N
  runs again from the same offsets and manifest N-1 and overwrites it, so output and state advance together.

A row displaced later by an earlier copy is emitted then, so the union of all outputs is exactly the
set of surplus rows, whatever the order of arrival.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.plans.storage import exists, is_file, scratch

BEST = T.StructType([T.StructField("undated", T.BooleanType()), T.StructField("at", T.TimestampType()), T.StructField("id", T.LongType())])
STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("best", BEST), T.StructField("last_seen", T.TimestampType())])
BUCKETS = 16


class SeenStore:
    """State, archive and surplus rows below ``root``; ``fold`` is a foreachBatch function.

    The manifest of a batch: ``mark``, the latest event time in microseconds; per bucket ``live`` and
    ``archive``, each a list of [path, rows], the base first and its log after it.
    """

    def __init__(self, spark: SparkSession, root: str, horizon: str = "30 days", buckets: int = BUCKETS):
        self.spark, self.root, self.horizon, self.buckets = spark, root, horizon, buckets

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, batch: int) -> dict:
        """What is valid after a batch; batches follow each other without gaps."""
        if batch < 0:
            return {"mark": None, "live": {}, "archive": {}}
        p, fs = self._file(f"{self.root}/manifest/{batch}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, batch: int, found: dict) -> None:
        p, fs = self._file(f"{self.root}/manifest/{batch}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()

    def _read(self, lists: list) -> DataFrame:
        paths = [path for one in lists for path, _ in one]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def _write(self, df: DataFrame, kind: str, n: int) -> dict[str, list]:
        """bucket -> [path, rows] of df (bucket, STATE...), written under batch n, sorted by key."""
        path = f"{self.root}/{kind}/batch={n}"
        df.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            raise RuntimeError(f"{path} is incomplete")
        names = {str(b): f"{path}/bucket={b}" for b in range(self.buckets)}
        there = {b: p for b, p in names.items() if exists(self.spark, p)}
        if not there:
            return {}
        sizes = self.spark.read.schema("key string, bucket int").parquet(path).groupBy("bucket").count().collect()  # a row a bucket
        return {str(r["bucket"]): [there[str(r["bucket"])], r["count"]] for r in sizes}

    def fold(self, rows: DataFrame, batch: int) -> None:
        """rows: key, id, at. Rows with a null key are no copies of anything and pass by."""
        n = int(batch)
        was = self.manifest(n - 1)
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        rows = rows.filter(F.col("key").isNotNull()).select("key", F.col("at").isNull().alias("undated"), "at", "id").persist()
        try:
            touched = rows.groupBy("key").agg(F.min(F.struct("undated", "at", "id")).alias("new"), F.max("at").alias("seen"))
            # buckets that the batch doesn't touch aren't read
            used = [str(r["b"]) for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` rows
            earlier = self._read([was[kind].get(b, []) for kind in ("live", "archive") for b in used])
            before = earlier.groupBy("key").agg(F.min("best").alias("old"), F.max("last_seen").alias("was"))
            path = f"{self.root}/resolved/batch={n}"
            (touched.join(before, "key", "left")
                .select("key", "old", F.when(F.col("old").isNotNull() & (F.col("old") < F.col("new")), F.col("old")).otherwise(F.col("new")).alias("best"), F.greatest("seen", "was").alias("last_seen"), "seen")
                .write.mode("overwrite").parquet(path))
            resolved = self.spark.read.parquet(path)
            latest = resolved.agg(F.max(F.unix_micros("seen"))).first()[0]
            mark = max((x for x in (was["mark"], latest) if x is not None), default=None)
            now = {"mark": mark, "live": {b: list(v) for b, v in was["live"].items()}, "archive": {b: list(v) for b, v in was["archive"].items()}}
            for b, entry in self._write(resolved.select(bucket.alias("bucket"), "key", "best", "last_seen"), "log", n).items():
                now["live"].setdefault(b, []).append(entry)
            self._compact(now, n)
            kept = resolved.select(F.col("best.id").alias("id"))
            gone = resolved.filter(F.col("old").isNotNull() & (F.col("old.id") != F.col("best.id"))).select(F.col("old.id").alias("id"))
            rows.select("id").join(kept, "id", "left_anti").unionByName(gone).write.mode("overwrite").parquet(f"{self.root}/surplus/batch={n}")
            self._put(n, now)
        finally:
            rows.unpersist()

    def _compact(self, now: dict, n: int) -> None:
        """Rewrites the buckets whose log is as large as their base: live keys to a new base, expired ones to the archive."""
        full = [b for b, v in now["live"].items() if len(v) > 1 and sum(x[1] for x in v[1:]) >= v[0][1]]
        if full:
            bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")
            # of a key the log's rows only improve, so the least best and the latest sight are its state
            one = self._read([now["live"][b] for b in full]).groupBy("key").agg(F.min("best").alias("best"), F.max("last_seen").alias("last_seen"))
            limit = F.timestamp_micros(F.lit(now["mark"])) - F.expr(f"INTERVAL {self.horizon}")
            alive = F.coalesce(F.col("last_seen") >= limit, F.lit(now["mark"] is None))
            live = self._write(one.filter(alive).select(bucket, "key", "best", "last_seen"), "base", n)
            expired = self._write(one.filter(~alive).select(bucket, "key", "best", "last_seen"), "expired", n)
            for b in full:
                now["live"][b] = [live[b]] if b in live else []
                if b in expired:
                    now["archive"].setdefault(b, []).append(expired[b])
        full = [b for b, v in now["archive"].items() if len(v) > 1 and sum(x[1] for x in v[1:]) >= v[0][1]]
        if full:
            one = self._read([now["archive"][b] for b in full]).groupBy("key").agg(F.min("best").alias("best"), F.max("last_seen").alias("last_seen"))
            bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")
            merged = self._write(one.select(bucket, "key", "best", "last_seen"), "archive", n)
            for b in full:
                now["archive"][b] = [merged[b]]

    def surplus(self) -> DataFrame:
        """Ids of the surplus rows so far, each once."""
        if not exists(self.spark, f"{self.root}/surplus"):
            return self.spark.createDataFrame([], "id bigint")
        return self.spark.read.schema("id bigint").parquet(f"{self.root}/surplus").select("id").distinct()


def surplus_rows(stream: DataFrame, root: str | None = None, horizon: str = "30 days") -> DataFrame:
    """Runs ``stream`` (key, id, at; from readStream) to its present end; returns ids of surplus rows.

    Of the rows of a key the one with the least (at, id) stays; undated rows come last. Given the same
    ``root`` again, the stream goes on where it ended.
    """
    spark = stream.sparkSession
    root = root or scratch(spark, "seen")
    store = SeenStore(spark, root, horizon)
    q = stream.writeStream.foreachBatch(store.fold).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.surplus()


def delivery_stream(spark: SparkSession, path: str, waves: int = 2) -> DataFrame:
    """messages as a stream of (key, id, at): Message-ID and the set of To addresses identify a mail.

    A folder of files is streamed in ``waves`` micro-batches. A single file is a finished log: its rows go through an
    inbox in the shared folder first, in the order of their batches, so that they stream, too.
    """
    from mailloom.operators.addresses import address_set, message_key

    def keyed(rows: DataFrame) -> DataFrame:
        mid = message_key(F.col("hdr_message_id"))
        key = F.when(mid.isNotNull(), F.concat(F.sha2(mid, 256), F.lit(" "), F.sha2(F.concat_ws("\n", address_set(F.col("hdr_to"))), 256)))
        return rows.select(key.alias("key"), F.col("delivery_id").alias("id"), F.col("received_at").alias("at"))

    rows = spark.read.parquet(path)
    if is_file(spark, path):  # a stream reads folders
        inbox = scratch(spark, "inbox")
        order = "batch_id" if "batch_id" in rows.columns else "received_at"
        keyed(rows.repartitionByRange(waves, order)).write.parquet(inbox)
        return spark.readStream.schema("key string, id bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(inbox)
    per = max(1, -(-len(rows.inputFiles()) // waves))
    return keyed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per).parquet(path))
