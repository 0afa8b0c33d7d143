"""What the items of a prefix bucket have in common: distributions, purity, tag overlap, samples."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions.fields import get_path
from quantaloom.functions.text import clean_values, let, scalar_or_missing, split_values
from quantaloom.operators.metrics import level_columns, prefix_buckets
from quantaloom.operators.ranking import first_rows
from quantaloom.session import broadcast_if_small, cut

# Bucket limits of the historical protocol and of its report.
SAMPLE_TITLES, SAMPLE_ROWS, TITLE_CHARS, TEXT_CHARS = 3, 5, 55, 160
# Tags of a set up to which its subsets are counted.
SUBSET_TAGS = 10


def _most(counts: DataFrame, top: int) -> DataFrame:
    """The most frequent values; ties go to the value seen first."""
    return counts.select("value", "n", "first_idx").orderBy(F.col("n").desc(), F.col("first_idx")).limit(top)


def _totals() -> list[Column]:
    """Totals over counts by ``ok`` and ``value``."""

    def rows(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("bigint")

    return [
        rows(F.col("ok")).alias("total"),
        rows(~F.col("ok")).alias("bad_json"),
        rows(F.col("ok") & F.col("value").isNull()).alias("missing"),
    ]


def _with_ratio(top: DataFrame, stats: DataFrame) -> DataFrame:
    # historical ratio: the bad lines are taken off a total that never held them
    denominator = F.greatest(F.col("total") - F.col("bad_json"), F.lit(1))
    one_row = stats.select(denominator.alias("__denominator"), F.lit(1).alias("__one"))
    joined = top.withColumn("__one", F.lit(1)).join(F.broadcast(one_row), "__one")
    return joined.select("value", "n", "first_idx", (F.col("n") / F.col("__denominator")).alias("ratio"))


def value_distribution(
    df: DataFrame, path: str, top: int = 127, raw: str = "raw", idx: str = "idx"
) -> tuple[DataFrame, DataFrame]:
    """Distribution of one field of JSON text rows; blank rows are skipped, malformed ones counted.

    Returns the ``top`` values with counts and ratios, and one row of totals.
    """
    rows = df.where(F.trim(F.col(raw)) != "").select(F.col(idx).alias("idx"), F.try_parse_json(raw).alias("v"))
    good = rows.select("idx", F.col("v").isNotNull().alias("ok"), F.trim(get_path(F.col("v"), path)).alias("value"))
    # read and parsed once: values, totals and the number of values all come from these counts
    counts = cut(good.groupBy("ok", "value").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")))
    stats = counts.agg(
        *_totals(),
        F.count("value").alias("unique"),
    ).select("total", "missing", "bad_json", "unique")
    return _with_ratio(_most(counts.where(F.col("value").isNotNull()), top), stats), stats


SALE_PATHS = [
    "meta.saletype",
    "meta.sale_type",
    "meta.pay_type",
    "meta.paytype",
    "saletype",
    "sale_type",
    "pay_type",
    "paytype",
    "meta_json.saletype",
]


def _sale_value(text: Column) -> Column:
    """FREE and PAY in capitals, digits without leading zeros, anything else as it is."""
    digits = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint").cast("string"))
    return F.when(F.upper(text).isin("FREE", "PAY"), F.upper(text)).otherwise(F.coalesce(digits, text))


def first_path_distribution(
    df: DataFrame, paths: list[str] | None = None, top: int = 127, raw: str = "raw", idx: str = "idx"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distribution of the first non-null of several paths, with FREE/PAY and digits normalised.

    Returns the values, how often each path supplied them, and one row of totals.
    """
    paths = paths or SALE_PATHS
    rows = df.where(F.trim(F.col(raw)) != "").select(F.col(idx).alias("idx"), F.try_parse_json(raw).alias("v"))
    tried = F.array(*[F.struct(get_path(F.col("v"), p).alias("value"), F.lit(p).alias("path")) for p in paths])
    found = F.try_element_at(F.filter(tried, lambda x: x["value"].isNotNull()), F.lit(1))
    normal = let(found, lambda x: F.struct(_sale_value(F.trim(x["value"])).alias("value"), x["path"].alias("path")))
    picked = rows.select("idx", F.col("v").isNotNull().alias("ok"), normal.alias("pick"))
    flat = picked.select("idx", "ok", F.col("pick.value").alias("value"), F.col("pick.path").alias("path"))
    counts = cut(flat.groupBy("ok", "value", "path").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")))
    stats = counts.agg(*_totals())
    kept = counts.where(F.col("value").isNotNull())

    def by(column: str, most: int) -> DataFrame:
        grouped = kept.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"), F.min("first_idx").alias("first_idx"))
        return _with_ratio(_most(grouped, most), stats)

    return by("value", top), by("path", len(paths)), stats


def _bucketed(df: DataFrame, level: int) -> tuple[DataFrame, list[str]]:
    wide, names = level_columns(df)
    return wide, names[:level]


def top_buckets(df: DataFrame, k: int, level: int | None = None, idx: str = "idx") -> DataFrame:
    """The ``k`` largest buckets of each level (or one level); ties go to the bucket seen first."""
    buckets = prefix_buckets(df, idx=idx)
    if level is not None:
        buckets = buckets.where(F.col("level") == level)
    return first_rows(buckets, ["level"], k, [F.col("n").desc(), F.col("first_idx")], name="rank")


def in_top_buckets(df: DataFrame, k: int, level: int, idx: str = "idx") -> DataFrame:
    """Rows of the ``k`` largest buckets of a level."""
    wide, names = _bucketed(df, level)
    top = top_buckets(df, k, level, idx).select(*names)
    return wide.join(F.broadcast(top) if k <= 10_000 else top, names, "left_semi")


def purity(df: DataFrame, level: int, fields: list[str]) -> DataFrame:
    """Share of the most common first value of each field in each bucket; a missing value counts as one.

    Values are counted per (bucket, value) before any bucket is looked at, so bucket size does not matter.
    """
    wide, names = _bucketed(df, level)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), scalar_or_missing(F.col(f)).alias("value")) for f in fields])
    long = wide.select(*names, F.explode(pairs).alias("p")).select(*names, "p.field", "p.value")
    counts = long.groupBy(*names, "field", "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*names, "field").agg(
        F.sum("n").cast("bigint").alias("n"), (F.max("n") / F.sum("n")).alias("purity")
    )


def _tagged(field: str, v: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), v.alias("value"))


def field_top(df: DataFrame, level: int, fields: list[str], k: int = 5, idx: str = "idx", multi: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` most common values of each field per bucket; fields in ``multi`` count every value."""
    wide, names = _bucketed(df, level)
    pairs = []
    for f in fields:
        values = split_values(F.col(f)) if f in multi else F.array(scalar_or_missing(F.col(f)))
        pairs.append(F.transform(values, partial(_tagged, f)))
    long = wide.select(*names, F.col(idx).alias("idx"), F.explode(F.concat(*pairs)).alias("p"))
    counts = long.groupBy(*names, F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx")
    )
    return first_rows(counts, [*names, "field"], k, [F.col("n").desc(), F.col("first_idx"), F.col("value")], "rank")


def bucket_samples(
    df: DataFrame,
    level: int,
    title: Column,
    k: int = SAMPLE_TITLES,
    chars: int = TITLE_CHARS,
    idx: str = "idx",
) -> DataFrame:
    """First ``k`` titles of each bucket in record order, shortened and free of table marks."""
    wide, names = _bucketed(df, level)
    shown = F.left(F.regexp_replace(F.replace(title, F.lit("|"), F.lit("/")), "\n", " "), F.lit(chars))
    rows = first_rows(wide.select(*names, F.col(idx).alias("idx"), shown.alias("title")), names, k, [F.col("idx")])
    return rows.select(*names, "rn", "idx", "title")


def _sets(df: DataFrame, level: int, field: str, idx: str, is_array: bool) -> tuple[DataFrame, list[str]]:
    wide, names = _bucketed(df, level)
    values = clean_values(F.col(field)) if is_array else split_values(F.col(field))
    rows = wide.select(*names, F.col(idx).alias("idx"), F.array_sort(F.array_distinct(values)).alias("tags"))
    return rows.where(F.size("tags") > 0), names


def _subsets(tags: Column) -> Column:
    """All non-empty subsets of a short array, in its order."""
    numbers = F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(tags)) - 1"))
    return F.transform(numbers, lambda m: F.filter(tags, lambda _, i: F.getbit(m, i) == 1))


def _shared_subsets(weighted: DataFrame, names: list[str]) -> DataFrame:
    """Per bucket, the sum of Jaccard values over all pairs of sets: ``score``.

    Two sets of s tags together, i of them in common, have the value i / (s - i). That is the sum of
    j! / ((s - 1)(s - 2)...(s - j)) over the subsets that both contain, j being a subset's size, so it is
    enough to count, for every subset, the sets of each size that contain it. All terms are positive.
    """
    each = weighted.select(*names, F.explode(_subsets(F.col("tags"))).alias("part"), F.size("tags").alias("size"), "w")
    counts = each.groupBy(*names, "part", "size").agg(F.sum("w").cast("double").alias("n"))
    held = counts.groupBy(*names, "part").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("by"))

    def term(s: Column) -> Column:
        factors = F.sequence(F.lit(1), F.size("part"))
        return F.aggregate(factors, F.lit(1.0), lambda acc, j: acc * j / (s - j))

    def pairs(a: Column) -> Column:
        same = a["n"] * (a["n"] - 1) / 2 * term(a["size"] * 2)
        larger = F.filter("by", lambda b: b["size"] > a["size"])
        return F.aggregate(larger, same, lambda acc, b: acc + a["n"] * b["n"] * term(a["size"] + b["size"]))

    score = F.aggregate("by", F.lit(0.0), lambda acc, a: acc + pairs(a))
    return held.select(*names, score.alias("score"))


def _shared_tags(weighted: DataFrame, names: list[str], most: int) -> DataFrame:
    """The same sum over the pairs with at least one set of more than ``most`` tags, from inverted lists of tags."""
    rows = weighted.withColumn("id", F.xxhash64("tags")).select(*names, "id", "tags", "w", F.size("tags").alias("size"))
    listed = rows.select(*names, "id", "w", "size", F.explode("tags").alias("tag"))
    wide = listed.where(F.col("size") > most).select(*names, "tag", *[F.col(c).alias(f"wide_{c}") for c in ("id", "w", "size")])
    # a pair of wide sets is counted from one side
    once = (F.col("size") <= most) | (F.col("id") < F.col("wide_id"))
    met = listed.join(wide, [*names, "tag"]).where(once)
    common = met.groupBy(*names, "id", "wide_id", "w", "wide_w", "size", "wide_size").agg(F.count("*").alias("i"))
    value = F.col("w") * F.col("wide_w") * F.col("i") / (F.col("size") + F.col("wide_size") - F.col("i"))
    own = rows.where(F.col("size") > most).select(*names, (F.col("w") * (F.col("w") - 1) / 2).alias("score"))
    return common.select(*names, value.alias("score")).unionByName(own)


def jaccard(
    df: DataFrame, level: int, field: str, idx: str = "idx", is_array: bool = False, most: int = SUBSET_TAGS
) -> DataFrame:
    """Mean pairwise Jaccard of the non-empty tag sets in each bucket: ``c1…, sets, pairs, jaccard``.

    Every pair counts and none is formed: pairs without a common tag add nothing, and the others are summed over
    the subsets of tags that they share, at a cost in proportion to the rows. Only a set of more than ``most``
    tags, whose subsets would be too many, is compared with the sets that its tags' inverted lists hold.
    """
    rows, names = _sets(df, level, field, idx, is_array)
    weighted = cut(rows.groupBy(*names, "tags").agg(F.count("*").alias("w")))
    totals = weighted.groupBy(*names).agg(F.sum("w").cast("bigint").alias("sets")).where("sets > 1")
    scored = _shared_subsets(weighted.where(F.size("tags") <= most), names)
    if not weighted.where(F.size("tags") > most).isEmpty():
        scored = scored.unionByName(_shared_tags(weighted, names, most))
    sums = scored.groupBy(*names).agg(F.sum("score").alias("score"))
    match = reduce(lambda x, y: x & y, [totals[n] == sums[n] for n in names])
    pairs = F.col("sets") * (F.col("sets") - 1) / 2
    joined = totals.join(sums, match).select(*[totals[n] for n in names], "sets", "score")
    return joined.select(*names, "sets", pairs.cast("bigint").alias("pairs"), (F.col("score") / pairs).alias("jaccard"))


def packed_usage(df: DataFrame, code: str = "packed") -> DataFrame:
    """Rows and distinct packed codes."""
    counts = df.groupBy(code).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.count(code).alias("unique_hardcode"))
