"""Element-wise sums of vectors as ordinary hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.vectors import sq_norm

# Components summed side by side in one aggregate; longer vectors are summed in chunks of this width, which
# stays below the number of fields (100) up to which Spark compiles an aggregate.
CHUNK = 64


def dimension(df: DataFrame, vector: str = "embedding") -> int:
    """Length of the vectors, read from one row."""
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).head()
    if row is None:
        raise ValueError("no vectors")
    return row[0]


def component_sums(vector: str, width: int, divisor: str | None = None) -> Column:
    """Array of one sum per component: one double buffer each, with partial sums before the shuffle."""
    over = f" / `{divisor}`" if divisor else ""
    one = "coalesce(sum(cast(get(`{v}`, {i}) AS DOUBLE){over}), 0.0D)"
    return F.expr("array(" + ", ".join(one.format(v=vector, i=i, over=over) for i in range(width)) + ")")


def flat_norm(vector: str, dim: int) -> Column:
    """Euclidean length of a vector.

    Written out per component where that is short enough to stay in generated code, which a lambda leaves.
    """
    if dim > CHUNK:
        return F.sqrt(sq_norm(F.col(vector)))

    def total(lo: int, hi: int) -> str:
        if hi - lo == 1:
            x = f"cast(get(`{vector}`, {lo}) AS DOUBLE)"
            return f"{x} * {x}"
        mid = (lo + hi) // 2
        return f"({total(lo, mid)} + {total(mid, hi)})"

    return F.expr(f"sqrt({total(0, dim)})")


def in_chunks(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, int]:
    """One row per vector chunk, as ``__chunk, __piece``; a short vector is its own only chunk."""
    if dim <= CHUNK:
        return df.select("*", F.lit(0).alias("__chunk"), F.col(vector).alias("__piece")), dim
    pieces = F.array(*[F.slice(vector, c * CHUNK + 1, CHUNK) for c in range(-(-dim // CHUNK))])
    return df.select("*", F.posexplode(pieces).alias("__chunk", "__piece")), CHUNK


def vector_sum(
    df: DataFrame,
    keys: list[str],
    vector: str,
    dim: int,
    aggs: list[tuple[str, Column]] = (),
    divisor: str | None = None,
    name: str = "vec_sum",
) -> DataFrame:
    """Sum a vector column per key, with further aggregates alongside.

    The sums stay in the JVM and are combined before the shuffle, so a hot key sends one row per task.
    Vectors wider than ``CHUNK`` are cut into chunk rows first.
    """
    side = [a.alias(n) for n, a in aggs]
    names = [n for n, _ in aggs]
    if dim <= CHUNK:
        return df.groupBy(*keys).agg(component_sums(vector, dim, divisor).alias(name), *side)

    long, width = in_chunks(df, vector, dim)
    part = long.groupBy(*keys, "__chunk").agg(component_sums("__piece", width, divisor).alias("__v"), *side)
    packed = part.select(*keys, F.struct("__chunk", F.col("__v").alias("v")).alias("__c"), *names)
    whole = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list("__c")), lambda c: c["v"])), 1, dim)
    # every chunk group has seen each row once, so any of them carries the right side aggregates
    return packed.groupBy(*keys).agg(whole.alias(name), *[F.max(n).alias(n) for n in names])
