"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs for right results, whatever the cluster size.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings that keep plans adaptive at any size: partition counts, skewed
# partitions and join sides are decided from measured shuffle sizes.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "fiscalis", cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    for key, value in {**RESULT_CONF, **PLAN_CONF}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    Only a local master may fall back to a temporary folder: there the driver
    and the executors are one process on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = os.environ.get("FISCALIS_LOCAL_SCRATCH") or tempfile.mkdtemp(prefix="fiscalis-")
    os.environ["FISCALIS_LOCAL_SCRATCH"] = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Once a table is written, what its job shuffled is of no use any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Rows that a task passes to Python at once. Whole documents are passed, and the JVM and Python both hold them.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's tasks pass at most BATCH_ROWS rows to Python at once; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


# Paths of the tables written within each call of `settled` that is at work.
MADE: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a written path removed when the session's process ends."""
    files, target = _path(spark, path)
    files.deleteOnExit(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written path now."""
    files, target = _path(spark, path)
    files.delete(target, True)


def save(spark: SparkSession, writer, path: str) -> None:
    """Write to a path of the shared folder. The files of the job's shuffles go when it has ended,
    the table when the session's process ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    remove_at_end(spark, path)


def cut(spark: SparkSession, df, name: str):
    """Write `df` to the shared folder and read it back, so that later stages
    start from files that outlive any executor."""
    path = scratch_path(spark, name)
    save(spark, df.write, path)
    if MADE:
        MADE[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that `build` makes, cut. The tables that `build` cut on the way are removed then, for nothing reads them any more:
    only the returned table may leave `build`."""
    MADE.append([])
    try:
        df = build()
    finally:
        made = MADE.pop()
    out = cut(spark, df, name)
    for path in made:
        remove(spark, path)
    return out
