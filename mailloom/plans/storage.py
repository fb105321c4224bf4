"""Where plans keep what they cut off or write between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single_machine(spark: SparkSession) -> bool:
    """Whether executors run in the driver's process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only on a single machine (a local master)
    may it be unset: a local folder is made and set then. On a cluster that would scatter tables over
    the executors' disks, so it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not got:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = at.get() if at.isDefined() else ""
    if not got:
        if not single_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="mailloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the application ends."""
    own = f"{shared_dir(spark)}/mailloom/{spark.sparkContext.applicationId}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table that ``written`` made for df; what was derived from it must have been written or collected."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    own = f"{shared_dir(df.sparkSession)}/mailloom/{df.sparkSession.sparkContext.applicationId}/".split(":", 1)[-1].lstrip("/")
    for p in paths:
        if p.split(":", 1)[-1].lstrip("/").startswith(own):
            remove(df.sparkSession, p)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Bytes of input files per task before Python or wide expressions; compressed columns grow several times in memory.
TASK_BYTES = 16 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of the input as the optimizer knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # leaves of unknown size say the greatest there is


def partitions_for(df: DataFrame) -> int:
    """Tasks for a stage over df: as many as its input files ask for, two a core at least."""
    return max(2 * cores(df.sparkSession), -(-input_bytes(df) // TASK_BYTES))


def scan_splits(df: DataFrame) -> int:
    """Tasks that a scan of df's files gets, by the scan's own rule; 0 if df reads no files."""
    spark = df.sparkSession
    n = len(df.inputFiles())
    if not n:
        return 0
    known, opening = input_bytes(df), 4 << 20
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    total = known + n * opening
    split = min(most, max(opening, total // cores(spark)))
    # small files aren't split: their row groups are
    return min(-(-total // split), max(n, known // (32 << 20)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Work for all cores before Python or wide expressions.

    Without keys: a scan that already gives every core a task is left alone, as a shuffle of all texts
    costs more than it evens out; only smaller inputs are repartitioned.
    """
    if keys:
        return df.repartition(partitions_for(df), *keys)
    return df if scan_splits(df) >= cores(df.sparkSession) else df.repartition(partitions_for(df))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()
