"""Joins that replace positional file alignment by an explicit row number, and keyed patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quantaloom.functions.codes import replace_level
from quantaloom.operators.ranking import with_row_idx


def attach(a: DataFrame, b: DataFrame, on: str = "idx", strict: bool = False) -> DataFrame:
    """One-to-one join on the row number.

    Lenient stops at the shorter side; strict fails the job when a row has no partner.
    """
    if not strict:
        return a.join(b, on)
    left = a.withColumn("__a", F.lit(True))
    right = b.withColumn("__b", F.lit(True))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    key = F.when(both, F.col(on)).otherwise(
        F.raise_error(F.concat(F.lit("no partner for row "), F.col(on).cast("string")))
    )
    joined = left.join(right, on, "full")
    # the check is a filter: it holds even when a later select drops every column
    return joined.where(key.isNotNull()).drop("__a", "__b")


def concat_domains(a: DataFrame, b: DataFrame, order: str = "idx", names: tuple[str, str] | None = None) -> DataFrame:
    """Stack two sources; the second continues the row numbers of the first.

    Both carry a dense 0-based ``order`` column, so only the length of the first is needed.
    """
    offset = a.count()
    second = b.withColumn(order, F.col(order) + F.lit(offset))
    if names:
        a, second = a.withColumn("domain", F.lit(names[0])), second.withColumn("domain", F.lit(names[1]))
    return a.unionByName(second, allowMissingColumns=True)


def overwrite(
    target: DataFrame,
    source: DataFrame,
    cols: list[str],
    present: dict[str, Column] | None = None,
    on: str = "idx",
    seen: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replace columns of the target by those of the same row in the source, where the source has them.

    ``present`` gives, per column, whether the source row has the field at all (a present null does
    overwrite); by default every non-null value is present. Returns the rows and one row of counters.

    The counters are a frame of their own, which joins again when it is run. With ``seen`` the job that writes the
    rows fills them in as well, from one join; read them from it once all rows have been written.
    """
    present = present or {}
    held = source.select(
        on,
        *[F.col(c).alias("__new_" + c) for c in cols],
        *[present.get(c, F.col(c).isNotNull()).alias("__has_" + c) for c in cols],
    )
    joined = attach(target, held, on, strict=True)
    changed = [
        F.count_if(F.col("__has_" + c) & ~F.col(c).eqNullSafe(F.col("__new_" + c))).alias("changed_" + c) for c in cols
    ]
    missing = [F.count_if(~F.col("__has_" + c)).alias("missing_" + c) for c in cols]
    counters = [F.count(F.lit(1)).alias("processed"), *changed, *missing]
    stats = joined.agg(*counters)
    joined = joined if seen is None else joined.observe(seen, *counters)
    merged = {c: F.when(F.col("__has_" + c), F.col("__new_" + c)).otherwise(F.col(c)) for c in cols}
    return joined.select(*[merged[c].alias(c) if c in merged else c for c in target.columns]), stats


def inject_meta_json(base: DataFrame, meta: DataFrame, fallback: str = "nested_meta_json", on: str = "idx") -> DataFrame:
    """Attach ``meta_json`` of the same row, or its nested copy where the top-level one is null."""
    picked = meta.select(on, F.coalesce("meta_json", fallback).alias("meta_json"))
    return attach(base.drop("meta_json"), picked, on, strict=True)


KEYS = ["idx", "id", "domain"]


def _typed_keys(df: DataFrame) -> DataFrame:
    """``__idx, __id`` as BIGINT and ``__good`` when all three keys are usable and five codes exist."""
    idx, item = [F.coalesce(F.col(k).cast("string").try_cast("bigint"), F.lit(-1)) for k in ("idx", "id")]
    out = df.select("*", idx.alias("__idx"), item.alias("__id"))
    good = (F.col("__idx") >= 0) & (F.col("__id") >= 0) & F.col("domain").isNotNull() & (F.size("indices") >= 5)
    out = out.withColumn("__good", F.coalesce(good, F.lit(False)))
    # rows without usable keys match nothing: distinct negative numbers keep them from meeting in one task
    spread = F.when(F.col("__good"), F.col("__idx")).otherwise(-1 - F.monotonically_increasing_id())
    return out.withColumn("__idx", spread)


def patch_layer5(
    target: DataFrame, source: DataFrame, order: str = "line", seen: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Take the fifth code from the source row of the same (idx, id, domain); its last line wins.

    Rows without usable keys or without a match stay as they are. Returns the rows and the counters; ``seen`` takes
    the counters from the job that writes the rows, as in ``overwrite``.
    """
    # copies of one key collapse in a max-by aggregate, with partial results before the shuffle
    latest = (
        _typed_keys(source)
        .where("__good")
        .groupBy("__idx", "__id", F.col("domain").alias("__domain"))
        .agg(F.max_by(F.get("indices", F.lit(4)), order).alias("__code"))
    )
    typed = _typed_keys(target)
    match = (
        F.col("__good")
        & (typed["__idx"] == latest["__idx"])
        & (typed["__id"] == latest["__id"])
        & (F.col("domain") == F.col("__domain"))
    )
    joined = typed.join(latest, match, "left").drop(latest["__idx"], latest["__id"])
    hit = F.col("__code").isNotNull()
    old = F.get("indices", F.lit(4))
    counters = [
        F.count(F.lit(1)).alias("target_total"),
        F.count_if(~F.col("__good")).alias("target_bad"),
        F.count_if(F.col("__good") & ~hit).alias("target_missing"),
        F.count_if(hit & (old != F.col("__code"))).alias("target_changed"),
    ]
    stats = joined.agg(*counters)
    joined = joined if seen is None else joined.observe(seen, *counters)
    indices = F.when(hit, replace_level(F.col("indices"), 5, F.col("__code"))).otherwise(F.col("indices"))
    columns = {"indices": indices}
    if "tokens" in target.columns:
        token = F.concat(F.lit("<e_"), F.col("__code").cast("string"), F.lit(">"))
        columns["tokens"] = F.when(hit, replace_level(F.col("tokens"), 5, token)).otherwise(F.col("tokens"))
    return joined.select(*[columns[c].alias(c) if c in columns else c for c in target.columns]), stats


def inject_codes(items: DataFrame, codes: DataFrame, levels: int | None = None) -> DataFrame:
    """Items with the codes of their row as ``sid``; fails unless rows match one to one."""
    picked = codes.select("idx", F.col("codes").alias("sid"))
    joined = attach(items.drop("sid"), picked, strict=True)
    if levels is None:
        return joined
    message = F.concat(F.lit(f"expected {levels} codes at row "), F.col("idx").cast("string"))
    return joined.withColumn("sid", F.when(F.size("sid") == levels, F.col("sid")).otherwise(F.raise_error(message)))


def check_alignment(a: DataFrame, b: DataFrame, full: bool = False) -> DataFrame:
    """Rows whose ``id`` differs between two row-numbered inputs; empty when they are aligned.

    Checks the first, middle and last row of ``a``, or every row with ``full``.
    """
    left = a.select("idx", F.col("id").cast("string").alias("id"))
    if not full:
        n = a.count()
        left = left.where(F.col("idx").isin(0, n // 2, max(n - 1, 0)))
    right = b.select("idx", F.col("id").cast("string").alias("other_id"))
    joined = left.join(right, "idx", "full" if full else "left")
    return joined.where(~F.col("id").eqNullSafe(F.col("other_id")))


def align_offset(codes: DataFrame, vectors: DataFrame, offset: int = 0, renumber: bool = False) -> DataFrame:
    """Codes joined to the vectors that start ``offset`` rows into a longer matrix.

    ``renumber`` first numbers the selected codes 0, 1, … in their own order, as after a domain filter.
    """
    if renumber:
        kept = codes.withColumnRenamed("idx", "source_idx")
        codes = with_row_idx(kept, [F.col("source_idx")])
    shifted = codes.withColumn("__row", F.col("idx") + F.lit(offset))
    rows = vectors.select(F.col("idx").alias("__row"), *[c for c in vectors.columns if c != "idx"])
    joined = shifted.join(rows.withColumn("__has", F.lit(True)), "__row", "left")
    message = F.concat(F.lit("no vector for row "), F.col("__row").cast("string"))
    covered = F.when(F.col("__has"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.where(covered).drop("__row", "__has")


def keep_in(df: DataFrame, keys: DataFrame, on: str = "idx") -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")
