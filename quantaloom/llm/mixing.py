"""Mixing sources to target weights under a token budget, over a tree domain - language - source.

Budgets go down the tree: at every node they are divided among the children by weight, no child getting more than
its subtree can give (its tokens times ``max_epochs``). What a child can't take goes to its siblings, again by
weight; since a node never gets more than its own subtree holds, a shortage reaches another branch only when all
siblings are used up. The division has a closed form: sort siblings by capacity over weight; those whose ratio
lies below the level that the rest would share are filled, the others share the remainder. Windows over the few
rows of the tree compute it, in whole tokens, rounding down.

Each leaf then reads its documents epoch by epoch. Every epoch has its own seeded order; whole epochs are taken as
they are, and the last one as a prefix: the documents, in that order, whose tokens end within the budget. The
prefix is found from token sums of ``BINS`` ranges of the order key, and only the range that holds the cut is
sorted, so that a leaf with a third of all rows is never gathered or sorted in one task.

Defined results: null or empty texts have no tokens and ride along in the order; null domain, language or source
is a value of its own; siblings without a weight, or with weight 0, get nothing, and equal weights share equally;
repeated rows each count, and an epoch's prefix takes them together or not at all; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.llm.common import fresh
from quantaloom.session import cut as checkpointed

TOKEN = r"[^\x20\x09-\x0D]+"
WIDE = "decimal(38,0)"
BINS = 1 << 16


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _share(level: DataFrame, parent: list[str]) -> DataFrame:
    """Divide ``given`` of each parent among its rows by ``weight``, none above ``capacity``; adds ``budget``."""
    ratio = F.col("capacity") / F.col("weight")
    before = Window.partitionBy(*parent).orderBy(ratio, *[c for c in level.columns if c.startswith("key_")])
    done = before.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(WIDE)
    live = level.where(F.col("weight") > 0)
    total = F.sum("weight").over(Window.partitionBy(*parent))
    live = live.select(
        "*",
        (F.col("given") - F.coalesce(F.sum("capacity").over(done), zero)).alias("rest"),
        (total - F.coalesce(F.sum("weight").over(done), zero)).alias("open"),
    )
    live = live.withColumn("full", F.col("capacity") * F.col("open") <= F.col("rest") * F.col("weight"))
    # the level that unfilled children share: taken at the first of them in the order
    first = F.min(F.when(~F.col("full"), F.struct(ratio.alias("r"), *[c for c in level.columns if c.startswith("key_")], "rest", "open")))
    live = live.withColumn("at", first.over(Window.partitionBy(*parent)))
    part = F.expr("cast(rest_ * weight div open_ AS decimal(38,0))")
    live = live.withColumn("rest_", F.col("at.rest")).withColumn("open_", F.col("at.open"))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))
    return live.withColumn("budget", F.greatest(budget, zero)).drop("rest", "open", "full", "at", "rest_", "open_")


def budgets(leaves: DataFrame, weights: list[DataFrame], budget: int, max_epochs: int) -> DataFrame:
    """Tokens for each leaf (key_0, key_1, key_2, tokens): the same rows with ``budget``.

    ``weights`` has a frame for each level: the level's key columns down from the root, and ``weight`` (integer).
    """
    keys = ["key_0", "key_1", "key_2"]
    tree = leaves.select(*keys, "tokens", (F.col("tokens") * max_epochs).cast(WIDE).alias("capacity"))
    leaves = tree
    # a leaf takes part if no node on its path lacks a weight: what the others could hold is no one's capacity
    for depth in range(len(keys)):
        own = keys[: depth + 1]
        w = weights[depth].where(F.col("weight") > 0).select(*[F.col(k).alias(f"w_{k}") for k in own])
        tree = tree.join(w, _same(tree, w, {k: f"w_{k}" for k in own}), "left_semi")
    given = tree.agg(F.least(F.sum("capacity"), F.lit(budget).cast(WIDE)).alias("given")).withColumn("root", F.lit(1))
    for depth in range(len(keys)):
        own, parent = keys[: depth + 1], keys[:depth]
        level = tree.groupBy(*own).agg(F.sum("capacity").alias("capacity"))
        w = weights[depth].select(*[F.col(k).alias(f"w_{k}") for k in own], F.col("weight").cast(WIDE).alias("weight"))
        level = level.join(w, _same(level, w, {k: f"w_{k}" for k in own})).select(*own, "capacity", "weight")
        if depth:
            up = given.select(*[F.col(k).alias(f"p_{k}") for k in parent], "given")
            level = level.join(up, _same(level, up, {k: f"p_{k}" for k in parent})).drop(*[f"p_{k}" for k in parent])
        else:
            level = level.withColumn("root", F.lit(1)).join(given, "root")
        given = _share(level, parent or ["root"]).select(*own, F.col("budget").alias("given"))
    done = given.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("given").cast("long").alias("budget"))
    joined = leaves.join(done, _same(leaves, done, {k: f"p_{k}" for k in keys}), "left")
    return joined.select(*keys, "tokens", F.coalesce("budget", F.lit(0).cast("long")).alias("budget"))


def _same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    out = F.lit(True)
    for left, right in names.items():
        out = out & a[left].eqNullSafe(b[right])
    return out


def equal_weights(leaves: DataFrame) -> list[DataFrame]:
    """The same weight for every sibling, at every level."""
    keys = ["key_0", "key_1", "key_2"]
    return [leaves.select(*keys[: d + 1]).distinct().withColumn("weight", F.lit(1)) for d in range(3)]


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The seeded place of a document in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix(
    documents: DataFrame,
    path: list[Column],
    weights: list[DataFrame] | None,
    budget: int | float,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """The documents of the mix, with ``epoch`` (0-based) under a free name as last column.

    ``path`` gives domain, language and source of a row. A ``budget`` below 1 is a share of all tokens.
    A document comes once for each epoch that takes it.
    """
    names = {n: fresh(documents.columns, n) for n in ("key_0", "key_1", "key_2", "tokens", "budget", "epoch", "order", "digest")}
    n = names
    docs = documents.select(
        "*",
        *[path[i].cast("string").alias(n[f"key_{i}"]) for i in range(3)],
        count_tokens(F.col("text")).alias(n["tokens"]),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias(n["digest"]),
    )
    keys = [n[f"key_{i}"] for i in range(3)]
    leaves = docs.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).agg(F.sum(n["tokens"]).alias("tokens"))
    if 0 < budget < 1:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget)
    shares = budgets(leaves, weights or equal_weights(leaves), int(budget), max_epochs)
    shares = shares.select(
        *[F.col(f"key_{i}").alias(f"leaf_{i}") for i in range(3)],
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("part"),
    )
    cuts = _cuts(docs, shares, n, seed)
    joined = docs.join(F.broadcast(cuts) if _few(cuts) else cuts, _same(docs, cuts, {k: f"leaf_{i}" for i, k in enumerate(keys)}))
    last = order_key(seed, F.col("whole"), F.col("doc_id"))
    place = F.struct(last.alias("key"), F.col(n["digest"]).alias("digest"))
    taken = F.col("whole") + F.when(F.col("cut").isNotNull() & (place <= F.col("cut")), 1).otherwise(0)
    epochs = F.explode(F.when(taken > 0, F.sequence(F.lit(0), taken - 1)).otherwise(F.array().cast("array<int>")))
    return joined.select(*[joined[c] for c in documents.columns], epochs.alias(n["epoch"]))


def _few(cuts: DataFrame, most: int = 100_000) -> bool:
    return cuts.count() <= most


def _cuts(docs: DataFrame, shares: DataFrame, n: dict[str, str], seed: int) -> DataFrame:
    """Per leaf: whole epochs, and the last place (order key, text digest) that the partial epoch takes, or null.

    The order of the partial epoch is cut in three steps: token sums per bin of the key, the bin that crosses
    the budget, and a running sum inside that bin alone.
    """
    keys = [n[f"key_{i}"] for i in range(3)]
    leaf = ["leaf_0", "leaf_1", "leaf_2"]
    shares = checkpointed(shares)
    rows = docs.select(*keys, n["digest"], n["tokens"], "doc_id")
    side = F.broadcast(shares) if _few(shares) else shares
    rows = rows.join(side, _same(rows, shares, dict(zip(keys, leaf)))).where(F.col("part") > 0)
    place = order_key(seed, F.col("whole"), F.col("doc_id"))
    rows = rows.select(*leaf, "part", F.col(n["tokens"]).alias("tokens"), place.alias("key"), F.col(n["digest"]).alias("digest"))
    rows = rows.withColumn("bin", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    bins = rows.groupBy(*leaf, "bin", "part").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*leaf).orderBy("bin")
    bins = bins.withColumn("end", F.sum("tokens").over(upto)).withColumn("before", F.col("end") - F.col("tokens"))
    crossing = checkpointed(bins.where((F.col("before") <= F.col("part")) & (F.col("end") > F.col("part"))).select(*[F.col(k).alias(f"c_{k}") for k in leaf], F.col("bin").alias("c_bin"), "before"))
    side = F.broadcast(crossing) if _few(crossing) else crossing
    inside = rows.join(side, _same(rows, crossing, {k: f"c_{k}" for k in leaf}) & (rows["bin"] == crossing["c_bin"]))
    run = Window.partitionBy(*leaf).orderBy("key", "digest")  # equal rows are taken together or not at all
    inside = inside.withColumn("end", F.col("before") + F.sum("tokens").over(run)).where(F.col("end") <= F.col("part"))
    found = inside.groupBy(*leaf).agg(F.max(F.struct("key", "digest")).alias("last"))
    found = found.select(*[F.col(k).alias(f"f_{k}") for k in leaf], "last")
    ends = crossing.select(*[F.col(f"c_{k}").alias(f"e_{k}") for k in leaf], F.format_string("%04x", "c_bin").alias("edge"))
    out = shares.join(ends, _same(shares, ends, {k: f"e_{k}" for k in leaf}), "left")
    out = out.join(found, _same(out, found, {k: f"f_{k}" for k in leaf}), "left")
    # without a document of the crossing bin, everything below its edge is taken
    below = F.struct(F.col("edge").alias("key"), F.lit("").alias("digest"))
    return checkpointed(out.select(*leaf, "whole", F.when(F.col("part") > 0, F.coalesce("last", below)).alias("cut")))
