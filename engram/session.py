"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of frames that went out of scope are removed by the driver
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # sessions of one key are merged on the map side before they meet
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # needed by transformWithStateInPandas
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "engram", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; cluster settings (memory, partitions) stay with the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="engram-ckpt-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each action inside go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so lost executors never force a different result."""
    shared_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder and read back: as `materialise`, and Spark knows the size for what follows."""
    path = scratch_path(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of `scratch_path` whose rows are needed no more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


ROWS_PER_TASK = 100_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for heavy row work: all cores, with about `ROWS_PER_TASK` rows a task at most."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, math.ceil(rows / ROWS_PER_TASK / cores))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy row work, with tasks of about `ROWS_PER_TASK` rows at most, when the input has fewer splits
    (files of short rows, whose splits hold millions of them).

    Where the splits are that many already, nothing is moved.
    """
    tasks = tasks_for(df.sparkSession, df.count())
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
