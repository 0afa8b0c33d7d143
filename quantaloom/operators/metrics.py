"""Collision, coverage and bucket metrics of a code matrix, overall and per domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions.codes import require_levels
from quantaloom.functions.fields import MISSING_DOMAIN

# Smallest assumed codebook of the first levels, and the sizes of a full configuration.
MIN_LEADING_SIZE, LEADING_LEVELS = 1024, 4
FULL_SIZES = [1024, 1024, 1024, 1024, 512]

OVERALL = "overall"


def level_columns(df: DataFrame, levels: int | None = None, codes: str = "codes") -> tuple[DataFrame, list[str]]:
    """Codes as one INT column per level, from an array column or from columns ``c1, c2, …``."""
    if codes in df.columns:
        if levels is None:
            row = df.where(F.col(codes).isNotNull()).select(F.size(codes)).head()
            if row is None:
                raise ValueError("no row tells how many codes there are: pass levels")
            levels = row[0]
        checked = [require_levels(F.col(codes), levels)] + [F.col(codes)] * (levels - 1)
        cols = [F.coalesce(F.get(checked[i], F.lit(i)).cast("int"), F.lit(-1)) for i in range(levels)]
        rest = [c for c in df.columns if c != codes]
    else:
        present = []
        while f"c{len(present) + 1}" in df.columns:
            present.append(f"c{len(present) + 1}")
        levels = levels or len(present)
        cols = [F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in present[:levels]]
        rest = [c for c in df.columns if c not in present]
    names = [f"c{i + 1}" for i in range(levels)]
    return df.select(*rest, *[c.alias(n) for c, n in zip(cols, names)]), names


def scope_columns(by: str | None) -> list[str]:
    return ["scope", by] if by else []


def _level_of(names: list[str]) -> Column:
    mask = F.grouping_id().bitwiseAND((1 << len(names)) - 1)
    return (F.lit(len(names)) - F.bit_count(mask)).cast("int")


def prefix_buckets(
    df: DataFrame,
    levels: int | None = None,
    by: str | None = None,
    overall: bool = True,
    idx: str | None = None,
) -> DataFrame:
    """Size of every prefix bucket at every level: ``[scope, by,] level, c1…cL, n[, first_idx]``.

    Rows are counted per full path first, with partial counts before the shuffle. Those counts are the
    last level already; only the shorter prefixes (and the overall paths, with ``by``) are grouped
    again, from distinct paths instead of rows.
    """
    wide, names = level_columns(df, levels)
    extra = [F.min(idx).alias("first_idx")] if idx else []
    keys = ([F.coalesce(F.col(by).cast("string"), F.lit(MISSING_DOMAIN)).alias(by)] if by else []) + [
        F.col(n) for n in names
    ]
    paths = wide.groupBy(*keys).agg(F.count("*").alias("n"), *extra)
    out = ["n"] + (["first_idx"] if idx else [])
    # a grouped-out column is null on its own, so overall rows are told apart by their scope
    scope = [F.lit(by).alias("scope"), F.col(by)] if by else []
    whole = paths.select(*scope, F.lit(len(names)).alias("level"), *names, *out)
    prefixes = [names[: i + 1] for i in range(len(names))]
    sets = [[by] + p for p in prefixes[:-1]] + (prefixes if overall else []) if by else prefixes[:-1]
    if not sets:
        return whole
    columns = ([by] if by else []) + names
    grouped = paths.groupingSets(sets, *columns).agg(
        F.sum("n").cast("bigint").alias("n"),
        *([F.min("first_idx").alias("first_idx")] if idx else []),
        _level_of(names).alias("level"),
        F.shiftright(F.grouping_id(), len(names)).alias("__all"),
    )
    scope = [F.when(F.col("__all") == 1, OVERALL).otherwise(by).alias("scope"), F.col(by)] if by else []
    return whole.unionByName(grouped.select(*scope, "level", *names, *out))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there is nothing to divide."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def level_metrics(
    df: DataFrame,
    sizes: list[int] | None = None,
    by: str | None = None,
    levels: int | None = None,
    overall: bool = True,
) -> DataFrame:
    """Core metrics and bucket statistics, one row per level (and group).

    Without any row there are rows of zeros for the ``levels`` given. ``sizes`` lists known codebook sizes; missing ones are the largest code plus one, and without any
    list the first four levels count at least 1024 codes.
    """
    buckets = prefix_buckets(df, levels, by, overall)
    names = [c for c in buckets.columns if c.startswith("c") and c[1:].isdigit()]
    scope = scope_columns(by)
    # level l leaves c(l+1)… null, so the last non-null column is the code of that level
    own = F.coalesce(*[F.col(n) for n in reversed(names)])
    histogram = buckets.groupBy(*scope, "level", "n").agg(F.count("*").alias("freq"), F.max(own).alias("top"))
    stats = histogram.groupBy(*scope, "level").agg(
        F.sum("freq").cast("bigint").alias("bucket_count"),
        F.sum(F.col("n") * F.col("freq")).cast("bigint").alias("rows"),
        F.percentile("n", [0.25, 0.5, 0.75], F.col("freq")).alias("q"),
        F.max("n").cast("bigint").alias("max"),
        F.greatest(F.max("top"), F.lit(0)).alias("top"),
    )
    inferred = (F.col("top") + 1).cast("bigint")
    if sizes:
        known = F.get(F.array(*[F.lit(int(s)).cast("bigint") for s in sizes]), F.col("level") - 1)
        size = F.coalesce(known, inferred)
    else:
        floor = F.greatest(inferred, F.lit(MIN_LEADING_SIZE).cast("bigint"))
        size = F.when(F.col("level") <= LEADING_LEVELS, floor).otherwise(inferred)
    if not by and levels:
        # levels of an empty input have rows too, with zeros
        every = df.sparkSession.range(1, levels + 1).select(F.col("id").cast("int").alias("level"))
        stats = every.join(stats, "level", "left").na.fill(0, ["bucket_count", "rows", "max", "top"])
    stats = stats.withColumn("codebook_size", size)
    group = Window.partitionBy(*scope)
    running = group.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stats = stats.withColumn("__capacity", F.product(F.col("codebook_size").cast("double")).over(running))
    stats = stats.withColumn("unique_paths", F.max("bucket_count").over(group))
    n, used, unique = F.col("rows"), F.col("bucket_count"), F.col("unique_paths")
    return stats.select(
        *scope,
        "level",
        n.alias("n"),
        "unique_paths",
        _ratio(n - unique, n).alias("collision_rate"),
        _ratio(unique, n).alias("icr"),
        _ratio(used, n).alias("coverage"),
        "codebook_size",
        (used / F.col("__capacity")).alias("capacity_use"),
        "bucket_count",
        _ratio(n, used).alias("mean"),
        *[F.coalesce(F.get("q", F.lit(i)), F.lit(0.0)).alias(name) for i, name in ((1, "median"), (0, "p25"), (2, "p75"))],
        "max",
    )


CORE = ["level", "n", "unique_paths", "collision_rate", "icr", "coverage", "codebook_size", "capacity_use"]
STATS = ["level", "bucket_count", "mean", "median", "p25", "p75", "max"]


def core_metrics(df: DataFrame, sizes: list[int] | None = None, by: str | None = None, **kw) -> DataFrame:
    return level_metrics(df, sizes, by, **kw).select(*scope_columns(by), *CORE)


def bucket_stats(df: DataFrame, by: str | None = None, **kw) -> DataFrame:
    return level_metrics(df, None, by, **kw).select(*scope_columns(by), *STATS)


def codebook_sizes(df: DataFrame, sizes: list[int] | None = None, levels: int | None = None) -> DataFrame:
    return level_metrics(df, sizes, levels=levels).select("level", "codebook_size")


def summarize(
    df: DataFrame,
    views: tuple[int, ...] = (4, 5),
    sizes: list[int] | None = None,
    by: str | None = None,
    cosine: DataFrame | None = None,
) -> DataFrame:
    """Metrics of several leading-level views from one pass over the codes.

    Prefix metrics of a level are the same in every view that has it; only the full-path columns
    depend on the view. ``cosine`` adds within-bucket similarity where its level is covered.
    """
    full = level_metrics(df, sizes, by)
    scope = scope_columns(by)
    viewed = full.select("*", F.explode(F.array(*[F.lit(v) for v in views])).alias("view"))
    viewed = viewed.where(F.col("level") <= F.col("view"))
    unique = F.max("bucket_count").over(Window.partitionBy(*scope, "view"))
    out = viewed.withColumn("unique_paths", unique)
    out = out.withColumn("collision_rate", (F.col("n") - F.col("unique_paths")) / F.col("n"))
    out = out.withColumn("icr", F.col("unique_paths") / F.col("n"))
    if cosine is not None:
        sims = cosine.select(*[F.col(c).alias("__" + c) for c in [*scope, "level"]], "weighted_sim", "unweighted_sim")
        same = F.lit(True)
        for c in [*scope, "level"]:
            same = same & F.col(c).eqNullSafe(F.col("__" + c))
        out = out.join(sims, same, "left").drop(*["__" + c for c in [*scope, "level"]])
    first = ["view", *scope, "level"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def domain_metrics(df: DataFrame, domain: str = "domain", sizes: list[int] | None = None) -> DataFrame:
    """Every metric for all rows and for each domain, from one pass."""
    return level_metrics(df, sizes, by=domain)


def _levels_or_none(df: DataFrame) -> int | None:
    """One level for an empty array column, whose rows can't tell."""
    return 1 if "codes" in df.columns and df.where(F.col("codes").isNotNull()).isEmpty() else None


def collision_rate(df: DataFrame, levels: int | None = None) -> DataFrame:
    """One row ``n, unique_paths, collision_rate``; an empty input has collision rate 1."""
    wide, names = level_columns(df, levels if levels is not None else _levels_or_none(df))
    paths = wide.groupBy(*names).agg(F.count("*").alias("n"))
    one = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.count("*").alias("unique_paths"))
    rate = F.when(F.col("n") == 0, F.lit(1.0)).otherwise((F.col("n") - F.col("unique_paths")) / F.col("n"))
    return one.select("n", "unique_paths", rate.alias("collision_rate"))


def code_counts(df: DataFrame, levels: int | None = None) -> DataFrame:
    """Rows per code of each level taken alone: ``level, code, n``."""
    wide, names = level_columns(df, levels)
    sets = [[n] for n in names]
    own = F.coalesce(*[F.col(n) for n in names])
    mask = F.grouping_id()
    # exactly one column is kept per set: its position is that of the only cleared bit
    level = F.coalesce(*[F.when(mask.bitwiseAND(1 << (len(names) - 1 - i)) == 0, F.lit(i + 1)) for i in range(len(names))])
    grouped = wide.select(*names).groupingSets(sets, *names).agg(F.count("*").alias("n"), level.alias("level"))
    return grouped.select("level", own.alias("code"), "n")


def marginal_metrics(df: DataFrame, levels: int | None = None) -> DataFrame:
    """Usage of each level taken alone, with the codebook size read off the largest code."""
    counts = code_counts(df, levels)
    histogram = counts.groupBy("level", "n").agg(F.count("*").alias("freq"), F.max("code").alias("top"))
    stats = histogram.groupBy("level").agg(
        F.sum("freq").cast("bigint").alias("active"),
        F.sum(F.col("n") * F.col("freq")).cast("bigint").alias("rows"),
        F.percentile("n", [0.25, 0.5, 0.75], F.col("freq")).alias("q"),
        F.max("n").cast("bigint").alias("max"),
        (F.max("top") + 1).cast("bigint").alias("codebook_size"),
    )
    return stats.select(
        "level",
        "active",
        (F.col("rows") / F.col("active")).alias("mean"),
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(0)).alias("p25"),
        F.get("q", F.lit(2)).alias("p75"),
        "max",
        "codebook_size",
        (F.col("active") / F.col("codebook_size")).alias("capacity_use"),
    )


def layer_usage(
    baseline: DataFrame,
    candidate: DataFrame,
    baseline_sizes: list[int] | None = None,
    candidate_sizes: list[int] | None = None,
) -> DataFrame:
    """Active codes, utilisation and largest code count per level, side by side."""

    def one(df: DataFrame, sizes: list[int], tag: str) -> DataFrame:
        usage = code_counts(df).groupBy("level").agg(
            F.count("*").alias("active_" + tag), F.max("n").cast("bigint").alias("max_count_" + tag)
        )
        size = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("level") - 1)
        return usage.withColumn("utilization_" + tag, F.col("active_" + tag) / size)

    a = one(baseline, baseline_sizes or FULL_SIZES, "baseline")
    b = one(candidate, candidate_sizes or FULL_SIZES, "candidate")
    return a.join(b, "level", "full")


def compare(runs: dict[str, DataFrame], sizes: list[int] | None = None, label: str = "system") -> DataFrame:
    """Metrics of several runs under one protocol, stacked with the run name."""
    out = None
    for name, df in runs.items():
        one = level_metrics(df, sizes).select(F.lit(name).alias(label), "*")
        out = one if out is None else out.unionByName(one)
    return out


def compare_wide(runs: dict[str, DataFrame], metric: str, sizes: list[int] | None = None) -> DataFrame:
    """One metric per level with a column per run."""
    return compare(runs, sizes).groupBy("level").pivot("system", list(runs)).agg(F.first(metric))


def before_after(before: DataFrame, after: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    return compare({"before_balance": before, "after_balance": after}, sizes, label="stage")


def best_runs(runs: DataFrame, save_limit: int = 3) -> DataFrame:
    """Which runs to keep: the best by collision and by loss, the ``save_limit`` lowest collisions and the
    ``save_limit`` newest epochs; the older run wins a tie.

    ``runs`` has ``run, epoch, collision_rate, loss``.
    """
    best = runs.agg(
        F.min_by("run", F.struct("collision_rate", "epoch")).alias("best_collision"),
        F.min_by("run", F.struct("loss", "epoch")).alias("best_loss"),
    )
    picked = best.select(F.explode(F.array(
        F.struct(F.lit("best_collision").alias("reason"), F.col("best_collision").alias("run")),
        F.struct(F.lit("best_loss").alias("reason"), F.col("best_loss").alias("run")),
    )).alias("x")).select("x.reason", "x.run")
    newest = runs.orderBy(F.col("epoch").desc(), "run").limit(save_limit).select(F.lit("newest").alias("reason"), "run")
    lowest = runs.orderBy("collision_rate", "epoch", "run").limit(save_limit)
    return picked.unionByName(newest).unionByName(lowest.select(F.lit("lowest_collision").alias("reason"), "run"))


def metrics_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """``(ids…, metric, value)`` rows of a metrics frame."""
    values = [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(ids, values, "metric", "value")
