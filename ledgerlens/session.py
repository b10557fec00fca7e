"""SparkSession defaults shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings the operators rely on: UTC time zone (log timestamps are UTC),
# ANSI arithmetic (division by zero is handled explicitly by safe_ratio), AQE for
# runtime coalescing and skew-join splitting. Without the capture of call sites (a debugging aid)
# an expression takes one call to the JVM in place of several, which halves the time to build a wide plan.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_open_blocks: list[list[str]] = []          # paths written inside each open scratch_tables block


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerlens") -> SparkSession:
    """Return (or create) the session with the library defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Unset, a folder is made only for a ``local`` master, whose driver is its only executor; on a
    cluster a driver-local folder would be invisible to the executors, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A path (or URI) under the shared checkpoint folder, never a machine-local one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage
    (survives executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, name: str = "table", scratch: bool = True) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Like ``checkpointed`` it cuts the lineage and survives lost executors; the table is columnar,
    so later uses read only the columns they need and the planner knows its size. Inside
    ``scratch_tables`` a ``scratch`` table is deleted at the end of the block.
    """
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    if scratch and _open_blocks:
        _open_blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """A block whose materialised tables are deleted when it ends. What it leaves must be written before
    (``materialised(..., scratch=False)``), not a frame that still reads them."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: its cleaner acts when the
    driver's garbage is collected, which a driver with little garbage does only every half hour."""
    spark.sparkContext._jvm.System.gc()


def ensure_session_defaults(spark: SparkSession) -> None:
    """Pin the settings the queries' semantics depend on (log timestamps are UTC wall-clock)
    on a session created elsewhere, and make sure the checkpoint folder is known."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
