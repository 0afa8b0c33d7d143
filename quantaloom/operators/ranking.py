"""Exact numbering and per-group selection that never gather a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.session import broadcast_if_small, cut


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank by ``order`` inside each ``keys`` group; ``order`` must be total within a group.

    Rows are range-partitioned by key and order together, so a hot key spreads over many partitions.
    A rank is the position inside the partition plus the rows of the same key in earlier partitions.
    """
    by = [F.col(k).asc() for k in keys] + list(order)
    placed = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__pos"))
    )
    runs = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__pos").alias("__start"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias("__k_" + k) for k in keys],
        F.col("__part").alias("__p"),
        "__start",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    match = [F.col(k).eqNullSafe(F.col("__k_" + k)) for k in keys] + [F.col("__part") == F.col("__p")]
    joined = placed.join(broadcast_if_small(runs, 64 + 32 * len(keys), hold=False), reduce(lambda a, b: a & b, match))
    rank = F.col("__before") + F.col("__pos") - F.col("__start") + 1
    return joined.select(*df.columns, rank.cast("bigint").alias(name))


def with_row_idx(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Dense 0-based row numbers in a given total order."""
    ranked = rank_within(df, [], order, name)
    return ranked.withColumn(name, F.col(name) - 1)


# Task slots from which a per-group limit is merged in two steps, and the groups of the first step.
WIDE_CLUSTER, MERGE_GROUPS = 256, 256


def first_rows(
    df: DataFrame, keys: list[str], n: int, order: list[Column], name: str = "rn", merge_groups: int | None = None
) -> DataFrame:
    """First ``n`` rows of each group; ``order`` must be total within a group.

    Catalyst turns the bound on the row number into a limit per group before the shuffle, so at most
    ``n`` rows of a group leave each input partition. With very many input partitions even those are too
    many for one task per hot group: they are first cut to ``n`` per group of input partitions. For ``n``
    beyond the limit Catalyst supports, the exact ranks of ``rank_within`` are used.
    """
    spark = df.sparkSession
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return rank_within(df, keys, order, name).where(F.col(name) <= n)
    if merge_groups is None:
        merge_groups = MERGE_GROUPS if spark.sparkContext.defaultParallelism >= WIDE_CLUSTER else 1

    def limited(rows: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)

    if merge_groups > 1:
        # every input partition falls in one merge group, so the limit before the shuffle still bites
        grouped = df.withColumn("__merge", F.spark_partition_id() % merge_groups)
        df = limited(grouped, [*keys, "__merge"]).drop("__merge", name)
    return limited(df, keys)


def slice_rows(df: DataFrame, start: int, end: int | None = None, idx: str = "idx") -> DataFrame:
    """Rows ``[start, end)`` by row number; the range reaches the Parquet scan as a pushed filter."""
    out = df.where(F.col(idx) >= start)
    return out if end is None else out.where(F.col(idx) < end)
