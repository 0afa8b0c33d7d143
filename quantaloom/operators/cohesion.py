"""Within-bucket cosine similarity without forming pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.fields import MISSING_DOMAIN
from quantaloom.functions.vectors import sq_norm
from quantaloom.operators.metrics import OVERALL, _level_of, level_columns, scope_columns
from quantaloom.operators.sums import component_sums, dimension, flat_norm, in_chunks


def _prepared(df: DataFrame, vector: str, dim: int, by: str | None, levels: int | None):
    """One row per vector chunk with the vector's length, and the names of the level columns."""
    wide, names = level_columns(df, levels)
    scope = [F.coalesce(F.col(by).cast("string"), F.lit(MISSING_DOMAIN)).alias(by)] if by else []
    rows = wide.select(*scope, *names, F.col(vector).alias("__v"), flat_norm(vector, dim).alias("__norm"))
    zero = F.col("__norm") == 0
    rows = rows.select(
        *[c for c in rows.columns if c != "__norm"],
        F.when(zero, F.lit(1.0)).otherwise(F.col("__norm")).alias("__len"),
        (~zero).cast("long").alias("__nonzero"),
    )
    chunked, width = in_chunks(rows, "__v", dim)
    return chunked.drop("__v"), names, width


def _sums(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    return rows.groupBy(*keys, "__chunk").agg(
        component_sums("__piece", width, "__len").alias("vec_sum"),
        F.count("*").alias("n"),
        F.sum("__nonzero").alias("nonzero"),
    )


def _means(buckets: DataFrame, scope: list[str], names: list[str], one_chunk: bool) -> DataFrame:
    """Mean pairwise cosine per bucket: the squared length of the summed unit vectors, less the self pairs.

    The squared length is itself a sum over chunks of the vector.
    """
    sq = sq_norm(F.col("vec_sum"))
    if one_chunk:
        whole = buckets.select(*scope, "level", "n", "nonzero", sq.alias("sq"))
    else:
        whole = buckets.groupBy(*scope, "level", *names).agg(
            F.max("n").alias("n"), F.max("nonzero").alias("nonzero"), F.sum(sq).alias("sq")
        )
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    sim = (F.col("sq") - F.col("nonzero")) / (n * (n - 1))
    several = n > 1
    scored = whole.select(*scope, "level", F.when(several, pairs).alias("pairs"), F.when(several, sim).alias("sim"))
    zero = F.lit(0.0)
    return scored.groupBy(*scope, "level").agg(
        F.count("pairs").alias("bucket_count"),
        F.coalesce(F.sum("pairs"), zero).cast("bigint").alias("pairs"),
        F.coalesce(F.sum(F.col("sim") * F.col("pairs")) / F.sum("pairs"), zero).alias("weighted_sim"),
        F.coalesce(F.avg("sim"), zero).alias("unweighted_sim"),
    )


def bucket_cosine(
    df: DataFrame,
    max_level: int | None = None,
    exclude_last: bool = False,
    by: str | None = None,
    vector: str = "embedding",
    dim: int | None = None,
    levels: int | None = None,
) -> DataFrame:
    """Pair-weighted and plain mean of within-bucket cosine per prefix level.

    Every row counts. A level whose buckets all hold one row has no pairs and similarity 0.
    """
    dim = dim or dimension(df, vector)
    rows, names, width = _prepared(df, vector, dim, by, levels)
    last = len(names) - (1 if exclude_last else 0)
    last = max(min(last, max_level) if max_level is not None else last, 0)
    names = names[:last]
    if not names:
        raise ValueError("no level is left to score")
    scope = scope_columns(by)
    group = [by] if by else []
    # sums per path are the last level already; shorter prefixes add those up, so a hot one is small by then
    paths = _sums(rows, [*group, *names], width)
    named = [F.lit(by).alias("scope"), F.col(by)] if by else []
    whole = paths.select(*named, F.lit(last).alias("level"), *names, "vec_sum", "n", "nonzero")
    prefixes = [[*names[: i + 1], "__chunk"] for i in range(last)]
    sets = [group + p for p in prefixes[:-1]] + (prefixes if by else [])
    if not sets:
        return _means(whole, scope, names, dim <= width)
    merged = paths.groupingSets(sets, *group, "__chunk", *names).agg(
        component_sums("vec_sum", width).alias("vec_sum"),
        F.sum("n").alias("n"),
        F.sum("nonzero").alias("nonzero"),
        _level_of(names).alias("level"),
        F.shiftright(F.grouping_id(), last + 1).alias("__all"),
    )
    named = [F.when(F.col("__all") == 1, OVERALL).otherwise(by).alias("scope"), F.col(by)] if by else []
    buckets = whole.unionByName(merged.select(*named, "level", *names, "vec_sum", "n", "nonzero"))
    return _means(buckets, scope, names, dim <= width)
