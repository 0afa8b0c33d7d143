"""Session helpers: a local session for tests, and the ways a plan is cut or sized."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound, in bytes, of anything this package ships to every task.
BROADCAST_LIMIT = 256 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quantaloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # no call-site capture for every column expression built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable shared storage and drop its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session without
    that setting (a test) gets a temporary folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one for local sessions that name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quantaloom-")


def fits_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> bool:
    """True when at most ``limit`` bytes would be shipped."""
    return df.count() <= max(limit // max(bytes_per_row, 1), 1)


def broadcast_if_small(
    df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT, hold: bool = True
) -> DataFrame:
    """Hint a broadcast for a side of proven size; otherwise leave the join to Catalyst.

    The side is materialised first, so that counting it does not compute it again; ``hold=False`` is for
    a side that is cheap to compute twice.
    """
    held = cut(df) if hold else df
    return F.broadcast(held) if fits_broadcast(held, bytes_per_row, limit) else held
