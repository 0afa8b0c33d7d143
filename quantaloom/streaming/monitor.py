"""A windowed monitor of code collisions over a stream of encoded items.

Three event-time states follow each other: records that are delivered again within the watermark's delay count once;
rows are counted per window and path, so a window's state holds one number per distinct path; and these counts are
folded to one row per window. A window is final, and comes out once, when the watermark has passed its end. Rows later
than the delay are left out, which is what bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _collisions(paths: DataFrame) -> DataFrame:
    """Per window: rows, distinct paths, rows whose path an earlier row has, their share, and the largest bucket."""
    rows, unique = F.sum("n"), F.count("*")
    found = paths.groupBy("window").agg(
        rows.alias("rows"),
        unique.alias("unique_paths"),
        (rows - unique).alias("collisions"),
        ((rows - unique) / rows).alias("collision_rate"),
        F.max("n").alias("largest_bucket"),
    )
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *found.columns[1:])


def collision_windows(
    items: DataFrame,
    key: str = "idx",
    ts: str = "ts",
    path: Column | str = "codes",
    width: str = "1 hour",
    delay: str = "2 hours",
    slide: str | None = None,
) -> DataFrame:
    """Collisions per window of event time; ``items`` is a stream or, for a backfill, a table.

    ``path`` is the list of codes, or an expression for it. Rows without a time or a path are left out. A record is
    known by ``key``; a stream takes deliveries of one record as one if they lie within ``delay`` of each other, a
    table all of them. A table gives the windows that a stream of the same rows ends with once it has closed them.
    """
    path = F.col(path) if isinstance(path, str) else path
    rows = items.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), path.alias("path"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("path").isNotNull())
    if items.isStreaming:
        once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])
    else:
        first = F.min(F.struct("ts", "path")).alias("first")
        once = rows.groupBy("key").agg(first).select("key", "first.ts", "first.path")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _collisions(once.groupBy(window.alias("window"), "path").agg(F.count("*").alias("n")))
