"""Writers for codes, metrics and codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.operators.records import overlay


# The fields a code record adds to an item's own.
CODE_FIELDS = ["idx", "indices", "tokens", "sid", "sid_subspace1", "sid_subspace2", "saletype", "publish_year"]


def indices_json(df: DataFrame, precedence: str = "new", keep: list[str] = ()) -> DataFrame:
    """``idx, value``: one JSON record per row, the item's own fields with the code fields laid over them."""
    fields = {n: F.col(n) for n in CODE_FIELDS if n in df.columns}
    return df.select("idx", overlay(F.col("rec"), fields, precedence).alias("value"), *keep)


def write_indices(df: DataFrame, path: str, precedence: str = "new", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """UTF-8 JSON lines, sorted by row number inside each file."""
    keep = partition_by or []
    lines = indices_json(df, precedence, keep)
    out = lines.sortWithinPartitions(*keep, "idx").select("value", *keep)
    writer = out.write.mode(mode)
    (writer.partitionBy(*keep) if keep else writer).text(path)


def write_metrics(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Metrics as JSON lines, optionally as a run/strategy tree."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def with_placeholder(codebook: DataFrame) -> DataFrame:
    """The learned levels plus one zero level standing for the packed metadata code.

    The placeholder has as many codes as the first level, of the same length.
    """
    last = codebook.agg(F.max("level").alias("last")).withColumn("__one", F.lit(1))
    first = codebook.where(F.col("level") == 1).withColumn("__one", F.lit(1)).join(F.broadcast(last), "__one")
    zero = F.transform("centroid", lambda _: F.lit(0.0))
    added = first.select((F.col("last") + 1).cast("int").alias("level"), "code", zero.alias("centroid"))
    return codebook.select("level", "code", "centroid").unionByName(added)


def write_codebook(codebook: DataFrame, path: str, include_hardcode: bool = False, mode: str = "error") -> None:
    out = with_placeholder(codebook) if include_hardcode else codebook
    out.write.mode(mode).parquet(path)
