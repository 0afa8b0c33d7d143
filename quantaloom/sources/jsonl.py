"""JSON-lines input with exact line numbers across splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaloom.session import broadcast_if_small


SPLIT = ["shard", "file", "block"]


def _scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the file split they come from; a missing shard is an error."""
    shards = [paths] if isinstance(paths, str) else list(paths)
    if not shards:
        raise ValueError("no shards given")
    rows = None
    for i, path in enumerate(shards):
        one = spark.read.text(path).select(
            F.lit(i).alias("shard"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _offsets(rows: DataFrame, pos: str) -> DataFrame:
    """Per file split, what turns the running ``pos`` of its rows into a number over all splits.

    The rows of a split follow each other in one partition, so their positions are consecutive.
    """
    splits = rows.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.min(pos).alias("start"))
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(*SPLIT, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias(f"{pos}_offset"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``line, value`` over all shards, numbered 0, 1, … in shard order.

    A line's number is the count of lines in earlier file splits plus its place in its own split, so the
    text itself is never shuffled: only one small row per split is.
    """
    rows = _scan(spark, paths).withColumn("pos", F.monotonically_increasing_id())
    joined = rows.join(broadcast_if_small(_offsets(rows, "pos"), 512), SPLIT)
    return joined.select((F.col("pos") + F.col("pos_offset")).alias("line"), "value")


def read_jsonl(spark: SparkSession, paths: str | list[str], mode: str = "strict", dense: bool = False) -> DataFrame:
    """``line, raw, rec`` of the non-blank lines.

    ``strict`` fails with the line number where a malformed record is read; ``drop`` leaves such lines out; ``keep``
    gives them a null record (see ``scan_stats``). ``dense`` adds ``idx`` numbering the rows kept, again
    from counts per split and without moving a row.
    """
    if mode not in ("strict", "drop", "keep"):
        raise ValueError(f"unknown mode {mode!r}")
    # parsed beside the position: no filter moves below a position, so a line is parsed once
    rows = _scan(spark, paths).select(
        "*", F.monotonically_increasing_id().alias("pos"), F.try_parse_json("value").alias("rec")
    )
    kept = rows.where(F.trim("value") != "")
    if mode == "drop":
        kept = kept.where(F.col("rec").isNotNull())
    # counted again after the filter: consecutive over the rows kept of each split
    kept = kept.withColumn("kept", F.monotonically_increasing_id())
    offsets = _offsets(rows, "pos")
    if dense:
        offsets = offsets.join(_offsets(kept, "kept"), SPLIT, "left")
    joined = kept.join(broadcast_if_small(offsets, 512), SPLIT)
    line = F.col("pos") + F.col("pos_offset")
    rec = F.col("rec")
    if mode == "strict":
        message = F.concat(F.lit("malformed JSON at line "), (line + 1).cast("string"))
        rec = F.coalesce(rec, F.raise_error(message).cast("variant"))
    idx = [(F.col("kept") + F.col("kept_offset")).alias("idx")] if dense else []
    return joined.select(*idx, line.alias("line"), F.trim("value").alias("raw"), rec.alias("rec"))


def scan_stats(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``total, bad_json`` of JSON text rows; blank rows count in neither."""
    rows = df.where(F.trim(F.col(raw)) != "")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.try_parse_json(raw).isNull()).alias("bad_json"))
