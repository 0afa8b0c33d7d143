"""Seeded samples, exact vector dedup and row assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.vectors import finite


FEW_KEYS = 4096


def draw_key(idx: str, seed: int) -> Column:
    """Uniform 128-bit key of a row, the same on every run and every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")).cast("binary"))


def sample_rows(df: DataFrame, n: int, seed: int = 0, idx: str = "idx") -> DataFrame:
    """At most ``n`` rows without replacement: those with the smallest draw keys.

    Only the n-th smallest key is searched for: counts by the next four digits of the key (at most 65,536)
    narrow it down until few keys share its prefix. The sample is then a plain filter: no row moves, and no
    more than ``FEW_KEYS`` keys are gathered in one task.
    """
    total = df.count()
    if n <= 0 or total <= n:
        return df.limit(0) if n <= 0 else df
    keys = df.select(F.struct(draw_key(idx, seed).alias("draw"), F.col(idx).alias("idx")).alias("k"))
    left, here, prefix = n, total, ""
    while here > FEW_KEYS and len(prefix) < 32:
        digits = F.substring("k.draw", len(prefix) + 1, 4).alias("digits")
        counts = keys.groupBy(digits).agg(F.count("*").alias("n")).collect()
        for digits, here in sorted((r["digits"], r["n"]) for r in counts):
            if here >= left:
                break
            left -= here
        prefix += digits
        keys = keys.where(F.col("k.draw").startswith(prefix))
    # more than FEW_KEYS keys with one draw value would be rows that share a number
    last = keys.orderBy("k").limit(left).agg(F.max("k").alias("k")).head()["k"]
    draw = draw_key(idx, seed)
    return df.where((draw < last["draw"]) | ((draw == last["draw"]) & (F.col(idx) <= F.lit(last["idx"]))))


def balanced_sample(
    df: DataFrame,
    domains: tuple[str, str] = ("station", "video"),
    per_domain: int | None = None,
    seed: int = 0,
    idx: str = "idx",
    domain: str = "domain",
) -> DataFrame:
    """Equal numbers of rows from two domains: as many as the smaller one has, or ``per_domain`` if that is less."""
    counts = {r[0]: r[1] for r in df.where(F.col(domain).isin(*domains)).groupBy(domain).count().collect()}
    take = min(counts.get(d, 0) for d in domains)
    take = take if per_domain is None else min(take, per_domain)
    if take <= 0:
        raise ValueError(f"not enough rows for a balanced sample: {counts}")
    a, b = [sample_rows(df.where(F.col(domain) == d), take, seed, idx) for d in domains]
    return a.unionByName(b)


def finite_rows(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.where(finite(F.col(vector)))


def dedup_vectors(df: DataFrame, vector: str = "embedding", idx: str = "idx") -> DataFrame:
    """One row per distinct vector: the first in record order.

    Two hashes lead the grouping key, so that sorting compares two numbers and meets whole vectors only where both
    agree. Equal rows are merged before the shuffle; a vector that many rows share is no hot key.
    """
    digest = [F.xxhash64(vector).alias("__a"), F.xxhash64(F.lit(1), vector).alias("__b")]
    return df.groupBy(*digest, vector).agg(F.min(idx).alias(idx)).select(idx, vector)


def row_gap(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row ``n, other_n``; the job fails when the counts differ."""
    a = df.agg(F.count("*").alias("n"))
    b = other.agg(F.count("*").alias("other_n"))
    message = F.concat(F.lit("row counts differ: "), F.col("n").cast("string"), F.lit(" and "), F.col("other_n").cast("string"))
    checked = F.when(F.col("n") == F.col("other_n"), F.col("n")).otherwise(F.raise_error(message))
    one = a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one")
    return one.select(checked.alias("n"), "other_n")


def assert_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` itself once both row counts are known to agree."""
    n, m = df.count(), other.count()
    if n != m:
        raise ValueError(f"row counts differ: {n} and {m}")
    return df
