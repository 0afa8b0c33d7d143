"""Queries over trained codebooks and balanced assignment.

Training has no closed form in SQL, so these return facts that must hold whatever the centroids are: sizes, exact
usage, errors that may not grow, and the error of the one mean vector, which SQL computes too and which every
trained codebook must beat by a stated factor. Each is computed from the whole vector table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quantaloom.functions import vectors as V
from quantaloom.operators import assign, balance, metrics, training
from quantaloom.plans.base import (
    VECTOR_CTES,
    mean_codebook,
    minus_sql,
    query,
    rounded,
    scratch,
    table,
    two_level_codebook,
    vectors,
    whole,
    with_ctes,
)
from quantaloom.plans.vector_queries import EMA_SQL, ITEM_VECTORS_SQL, item_vectors
from quantaloom.session import cut
from quantaloom.streaming import monitor
from quantaloom.streaming.upkeep import CodebookUpkeep, encode_stream

K, LEVELS, ITERS = 16, 2, 5



# squared error of the mean vector, summed over all rows
MEAN_ERROR = "(SELECT round(sum(d), 3) FROM (SELECT pos, sum((val - m) ** 2) AS d FROM (SELECT pos, val, avg(val) OVER (PARTITION BY pos) AS m FROM ve) GROUP BY pos))"


def mean_error(rows):
    """One row: the error above."""
    mean = mean_codebook(rows.withColumn("all", F.lit(0)), "all", 1)
    return assign.encode(rows.select("idx", "embedding"), mean).agg(F.sum("sq_error").alias("mean_error"))


def beside_mean(errors, rows, factor: float):
    """``errors`` (with ``sq_error``) and the rounded mean error, and whether the first is below ``factor`` of it."""
    both = errors.withColumn("one", F.lit(1)).join(F.broadcast(mean_error(rows).withColumn("one", F.lit(1))), "one").drop("one")
    below = (F.col("sq_error") < F.col("mean_error") * factor).alias("below")
    return both.select(*[c for c in errors.columns if c != "sq_error"], F.round("mean_error", 3).alias("mean_error"), below)


def part_error(coded, vector: str = "embedding"):
    return coded.agg(F.count("*").alias("n"), F.sum(V.sq_l2(F.col(vector), F.col("decoded"))).alias("sq_error"))


def level_errors(df, books, levels: int):
    """``level, n, codes, sq_error`` after each number of levels."""
    out = None
    for level in range(1, levels + 1):
        coded = assign.encode(df.select("idx", "embedding"), books.where(F.col("level") <= level))
        one = coded.agg(
            F.lit(level).alias("level"),
            F.count("*").alias("n"),
            F.max(F.get("codes", F.lit(level - 1))).alias("top"),
            F.sum("sq_error").alias("sq_error"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "kmeans_codebook",
    with_ctes(f"SELECT {K}::BIGINT AS codes, 64::INT AS dim, count(*)::BIGINT AS n, {MEAN_ERROR} AS mean_error, true AS below FROM embeddings", VECTOR_CTES),
)
def kmeans_codebook(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    book = cut(training.fit_codebook(rows, K, ITERS))
    fitted = assign.encode(rows, book).agg(F.count("*").alias("n"), F.sum("sq_error").alias("sq_error"), F.lit(1).alias("one"))
    shape = book.agg(F.count("*").alias("codes"), F.max(F.size("centroid")).alias("dim"), F.lit(1).alias("one"))
    return beside_mean(shape.join(fitted, "one").drop("one"), rows, 0.95)


@query(
    "residual_training",
    with_ctes(
        f"""SELECT level::INT AS level, count(*)::BIGINT AS n, true AS codes_in_range, true AS error_not_larger, {MEAN_ERROR} AS mean_error, true AS below
FROM embeddings, (VALUES (1), (2)) l(level) GROUP BY level""",
        VECTOR_CTES,
    ),
)
def residual_training(spark, sf_dir):
    from pyspark.sql import Window

    rows = vectors(spark, sf_dir)
    errors = level_errors(rows, cut(training.fit_rq(rows, [K] * LEVELS, ITERS)), LEVELS)
    before = F.lag("sq_error").over(Window.orderBy("level"))
    checked = errors.select(
        "level",
        "n",
        (F.col("top") < K).alias("codes_in_range"),
        F.coalesce(F.col("sq_error") <= before, F.lit(True)).alias("error_not_larger"),
        "sq_error",
    )
    return beside_mean(checked, rows, 0.95)


@query(
    "trained_codes_summary",
    "SELECT level::INT AS level, count(*)::BIGINT AS n, true AS rates_add_up FROM embeddings, (VALUES (1), (2)) l(level) GROUP BY level",
)
def trained_codes_summary(spark, sf_dir):
    """Train, encode and measure in one go."""
    rows = vectors(spark, sf_dir)
    coded = assign.encode(rows, cut(training.fit_rq(rows, [K] * LEVELS, ITERS))).select("codes")
    out = metrics.core_metrics(coded, levels=LEVELS)
    return out.select("level", "n", (F.abs(F.col("icr") + F.col("collision_rate") - 1) < 1e-9).alias("rates_add_up"))


@query(
    "balanced_init_training",
    with_ctes(
        f"""SELECT level::INT AS level, {K}::BIGINT AS codes, (SELECT count(*) FROM embeddings)::BIGINT AS n, {MEAN_ERROR} AS mean_error, true AS below
FROM (VALUES (1), (2)) l(level)""",
        VECTOR_CTES,
    ),
)
def balanced_init_training(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("domain", F.when(F.col("label") < 3, "station").otherwise("video"))
    books = cut(training.fit_rq_balanced(rows, [K] * LEVELS, ("station", "video"), iters=ITERS))
    coded = assign.encode(rows, books).agg(F.count("*").alias("n"), F.sum("sq_error").alias("sq_error"), F.lit(1).alias("one"))
    sizes = books.groupBy("level").agg(F.count("*").alias("codes")).withColumn("one", F.lit(1))
    return beside_mean(sizes.join(coded, "one").select("level", "codes", "n", "sq_error"), rows, 0.95)


@query(
    "product_training",
    with_ctes(
        f"""SELECT part::INT AS part, {K}::BIGINT AS codes, 32::INT AS dim, (SELECT count(*) FROM embeddings)::BIGINT AS n, {MEAN_ERROR} AS mean_error,
true AS below FROM (VALUES (1), (2)) p(part)""",
        VECTOR_CTES,
    ),
)
def product_training(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    book = cut(training.fit_pq(rows, 2, K, ITERS))
    shape = book.groupBy("part").agg(F.count("*").alias("codes"), F.max(F.size("centroid")).alias("dim")).withColumn("one", F.lit(1))
    error = part_error(training.encode_parts(rows, book)).withColumn("one", F.lit(1))
    return beside_mean(shape.join(error, "one").drop("one"), rows, 0.95)


@query(
    "rotated_product_training",
    "SELECT count(*)::BIGINT AS n, true AS orthogonal, true AS close_to_plain FROM embeddings",
)
def rotated_product_training(spark, sf_dir):
    """The rotation is orthogonal, and the rotated quantizer is no worse than a twentieth above the plain one."""
    rows = vectors(spark, sf_dir).drop("label")
    rotation, parts = training.fit_opq(rows, 2, K, iters=ITERS)
    orthogonal = bool(np.abs(rotation @ rotation.T - np.eye(len(rotation))).max() < 1e-8)

    def error(book, turn, name):
        coded = training.encode_parts(rows if turn is None else training.rotate(rows, turn), book)
        return coded.agg(F.count("*").alias("n_" + name), F.sum(V.sq_l2(F.col("embedding"), F.col("decoded"))).alias(name), F.lit(1).alias("one"))

    both = error(cut(parts), rotation, "turned").join(error(cut(training.fit_pq(rows, 2, K, ITERS)), None, "plain"), "one")
    return both.select(
        F.col("n_turned").alias("n"),
        F.lit(orthogonal).alias("orthogonal"),
        (F.col("turned") <= F.col("plain") * 1.05).alias("close_to_plain"),
    )


@query(
    "composite_training",
    with_ctes(f"SELECT count(*)::BIGINT AS n, 5::INT AS levels, true AS in_range, {MEAN_ERROR} AS mean_error, true AS below FROM embeddings", VECTOR_CTES),
)
def composite_training(spark, sf_dir):
    """Three residual levels, then a rotated product quantizer of two parts; the error of all five codes."""
    rows = vectors(spark, sf_dir)
    book, rotation, parts = training.fit_rq_pq(rows, [K, K, K], m=2, k=K, iters=ITERS)
    book, parts = cut(book), cut(parts)
    coded = training.encode_rq_pq(rows, book, rotation, parts)
    left = training.subtract_nearest(rows.select("idx", "embedding"), book, "embedding")
    error = part_error(training.encode_parts(training.rotate(left, rotation), parts)).withColumn("one", F.lit(1)).drop("n")
    shape = coded.agg(
        F.count("*").alias("n"),
        F.max(F.size("codes")).alias("levels"),
        (F.max(F.array_max("codes")) < K).alias("in_range"),
        F.lit(1).alias("one"),
    )
    return beside_mean(shape.join(error, "one").drop("one"), rows, 0.8)


@query(
    "subspace_training",
    with_ctes(
        f"""SELECT level::INT AS level, count(*)::BIGINT AS n, true AS in_range, {MEAN_ERROR} AS mean_error, true AS below
FROM embeddings, generate_series(1, 4) l(level) GROUP BY level""",
        VECTOR_CTES,
    ),
)
def subspace_training(spark, sf_dir):
    """Two parts with two levels each; usage of the four code columns, and the error of all of them."""
    rows = vectors(spark, sf_dir)
    book = cut(training.fit_subspace_rq(rows, 2, [8, 8], ITERS))
    coded = training.encode_parts(rows, book)
    counts = metrics.code_counts(coded.select("codes"), levels=4)
    used = counts.groupBy("level").agg(F.sum("n").cast("bigint").alias("n"), (F.max("code") < 8).alias("in_range"), F.lit(1).alias("one"))
    error = part_error(coded).withColumn("one", F.lit(1)).drop("n")
    return beside_mean(used.join(error, "one").drop("one"), rows, 0.95)


@query(
    "balanced_assignment",
    """WITH c AS (SELECT count(*) AS n FROM embeddings)
SELECT code::INT AS code, (n // 10 + CASE WHEN code < n % 10 THEN 1 ELSE 0 END)::BIGINT AS rows FROM c, generate_series(0, 9) g(code)""",
)
def balanced_assignment(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    out = balance.balance(rows, cut(mean_codebook(rows, "label", 1)), iters=10, topk=4, vector="embedding")
    return out.groupBy("code").agg(F.count("*").alias("rows"))


# row numbers move the vectors a little, so that no two rows are equally far from both means
APART = "list_transform(x, lambda v: v + idx * 0.0001)"


@query(
    "balanced_two_codes",
    with_ctes(
        f"""SELECT idx, (CASE WHEN place <= (n + 1 - code) // 2 THEN code ELSE 1 - code END)::INT AS code
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY abs(a - b) DESC) AS place FROM (
SELECT idx, a, b, CASE WHEN a <= b THEN 0 ELSE 1 END AS code, count(*) OVER () AS n FROM (
SELECT idx, max(d) FILTER (code = 0) AS a, max(d) FILTER (code = 1) AS b FROM (
SELECT idx, code, list_distance(x, centroid) ** 2 AS d FROM moved, halves) GROUP BY idx)))""",
        VECTOR_CTES,
        f"moved AS (SELECT idx, label, {APART} AS x FROM v)",
        """halves AS (SELECT code, list(m ORDER BY pos) AS centroid FROM (SELECT code, pos, avg(val) AS m FROM (
SELECT label % 2 AS code, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM moved) GROUP BY code, pos) GROUP BY code)""",
    ),
)
def balanced_two_codes(spark, sf_dir):
    """Which of two codes each row gets: the fuller one keeps the rows that lose most by leaving."""
    moved = F.transform("embedding", lambda v: v.cast("double") + F.col("idx") * F.lit(0.0001))
    rows = vectors(spark, sf_dir).withColumn("embedding", moved).withColumn("half", F.col("label") % 2)
    book = cut(mean_codebook(rows, "half", 1))
    return balance.balance(rows, book, iters=0, tau=10.0, vector="embedding").select("idx", "code")


@query(
    "balanced_last_level",
    """WITH c AS (SELECT count(*) AS n FROM embeddings)
SELECT code::INT AS code, (n // 16 + CASE WHEN code < n % 16 THEN 1 ELSE 0 END)::BIGINT AS rows FROM c, generate_series(0, 15) g(code)""",
)
def balanced_last_level(spark, sf_dir):
    rows, book = vectors(spark, sf_dir), two_level_codebook(spark, sf_dir)
    coded = assign.encode(rows, book).select("idx", "embedding", "codes")
    out = balance.balance_last_level(coded, book, iters=10)
    return out.groupBy(F.get("codes", F.lit(1)).alias("code")).agg(F.count("*").alias("rows"))


@query(
    "temperature_estimate",
    with_ctes(
        """SELECT round(greatest(median(p) * 0.1, 1e-6), 6) AS tau FROM (SELECT idx, quantile_cont(d - low, 0.9) AS p FROM (
SELECT idx, d, min(d) OVER (PARTITION BY idx) AS low FROM (SELECT idx, list_distance(x, centroid) ** 2 AS d FROM v, cb1)) GROUP BY idx)""",
        VECTOR_CTES,
    ),
)
def temperature_estimate(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    tau = balance.estimate_tau(rows, cut(mean_codebook(rows, "label", 1)), "embedding")
    return rounded(rows.select(F.lit(tau).alias("tau")).limit(1), "tau")


# item vectors, shifted a little by row so that all distances differ: more rows than embeddings has
SHIFTED = "list_transform(x, lambda v: v + (idx % 97) * 0.001)"


@query(
    "temperature_of_items",
    with_ctes(
        f"""SELECT round(greatest(median(p) * 0.1, 1e-6), 9) AS tau FROM (SELECT idx, quantile_cont(d - low, 0.9) AS p FROM (
SELECT idx, d, min(d) OVER (PARTITION BY idx) AS low FROM (
SELECT idx, list_distance({SHIFTED}, centroid) ** 2 AS d FROM ({ITEM_VECTORS_SQL}), cb1)) GROUP BY idx)""",
        VECTOR_CTES,
    ),
)
def temperature_of_items(spark, sf_dir):
    shifted = F.transform("embedding", lambda v: v.cast("double") + (F.col("idx") % 97) * F.lit(0.001))
    items = item_vectors(spark, sf_dir).select("idx", shifted.alias("embedding"))
    tau = balance.estimate_tau(items, cut(mean_codebook(vectors(spark, sf_dir), "label", 1)), "embedding")
    return rounded(items.select(F.lit(tau).alias("tau")).limit(1), "tau", digits=9)


def _balanced_ctes(name: str, distances: str, epsilon: float, center: str, iters: int = 2) -> str:
    """CTEs that end in ``name(idx, code)``: transport inside batches ``b`` over rows (idx, b, code, d), spelled out."""
    if center == "global":
        middle = "((max(d) OVER w + min(d) OVER w) / 2)"
        scaled, window = f"(d - {middle}) / (max(d) OVER w - {middle} + 1e-5)", "b"
    else:
        scaled, window = "(d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-8)", "idx"
    steps = [
        f"""{name}_0 AS (SELECT idx, b, code, exp(-({scaled}) / {epsilon}) AS k, 1.0::DOUBLE AS c,
count(*) OVER (PARTITION BY idx) AS m, count(*) OVER (PARTITION BY b) / count(*) OVER (PARTITION BY idx) AS n
FROM {distances} WINDOW w AS (PARTITION BY {window}))"""
    ]
    for i in range(iters):
        steps.append(
            f"""{name}_{i + 1} AS (SELECT idx, b, code, k, 1 / (m * sum(k / (n * s)) OVER (PARTITION BY b, code)) AS c, m, n
FROM (SELECT *, sum(k * c) OVER (PARTITION BY idx) AS s FROM {name}_{i}))"""
        )
    return ",\n".join([*steps, f"{name} AS (SELECT idx, arg_max(code, k * c) AS code FROM {name}_{iters} GROUP BY idx)"])


@query(
    "batch_balanced_codes",
    with_ctes(
        "SELECT r1.idx, r1.c1::INT AS c1, s2.code::INT AS c2 FROM r1 JOIN s2 USING (idx)",
        VECTOR_CTES,
        "d2 AS (SELECT r1.idx, r1.idx // 256 AS b, cb2.code, list_distance(r, centroid) ** 2 AS d FROM r1, cb2)",
        _balanced_ctes("s2", "d2", 0.003, "global"),
    ),
)
def batch_balanced_codes(spark, sf_dir):
    """Mini-batch transport at the second level only, two steps of it."""
    rows, book = vectors(spark, sf_dir), two_level_codebook(spark, sf_dir)
    out = assign.sinkhorn_batch(rows, book, [0.0, 0.003], iters=2, batch_size=256)
    return out.select("idx", F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"))


@query(
    "row_centred_batch_codes",
    with_ctes(
        "SELECT s1.idx, s1.code::INT AS c1, s2.code::INT AS c2 FROM s1 JOIN s2 USING (idx)",
        VECTOR_CTES,
        "d1 AS (SELECT idx, idx // 256 AS b, code, list_distance(x, centroid) ** 2 AS d FROM v, cb1)",
        _balanced_ctes("s1", "d1", 0.05, "row"),
        f"left1 AS (SELECT v.idx, {minus_sql('v.x', 'cb1.centroid')} AS r FROM v JOIN s1 ON v.idx = s1.idx JOIN cb1 ON s1.code = cb1.code)",
        "d2 AS (SELECT idx, idx // 256 AS b, code, list_distance(r, centroid) ** 2 AS d FROM left1, cb2)",
        _balanced_ctes("s2", "d2", 0.05, "row"),
    ),
)
def row_centred_batch_codes(spark, sf_dir):
    rows, book = vectors(spark, sf_dir), two_level_codebook(spark, sf_dir)
    out = assign.sinkhorn_batch(rows, book, [0.05, 0.05], iters=2, batch_size=256, center="row")
    return out.select("idx", F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"))


def vector_stream(spark, sf_dir):
    """The table as a stream, be it one file or a folder of files: a stream cannot start at a file but at a pattern."""
    schema = "vec_id bigint, embedding array<float>, label int"
    source = spark.readStream.schema(schema).parquet(sf_dir.rstrip("/") + "/{embeddings.parquet}")
    return source.select(F.col("vec_id").alias("idx"), "embedding", "label")


@query("streamed_encoding", with_ctes("SELECT idx, c1, c2 FROM coded", VECTOR_CTES))
def streamed_encoding(spark, sf_dir):
    root = scratch(spark)
    coded = encode_stream(vector_stream(spark, sf_dir), two_level_codebook(spark, sf_dir)).select("idx", "codes")
    run = (
        coded.writeStream.format("parquet")
        .option("checkpointLocation", root + "/progress")
        .trigger(availableNow=True)
        .start(root + "/codes")
    )
    run.awaitTermination()
    out = spark.read.schema(coded.schema).parquet(root + "/codes")
    return out.select("idx", F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"))


@query("streamed_codebook_upkeep", EMA_SQL)
def streamed_codebook_upkeep(spark, sf_dir):
    root = scratch(spark)
    upkeep = CodebookUpkeep(spark, root + "/state", mean_codebook(vectors(spark, sf_dir), "label", 1), decay=0.9)
    run = (
        upkeep.attach(vector_stream(spark, sf_dir))
        .option("checkpointLocation", root + "/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return upkeep.state().select("code", F.round("count", 6).alias("count"), *whole("centroid"))


# -- windowed collisions: events as encoded items that arrive in six deliveries -----------------------------

MONITOR_CODES = ["user_id % 16", "cast(floor(value) AS bigint) % 8"]
MONITOR_HOURS = 6
# the delivery of a row, a sixth of the time each; every seventh row comes one delivery late, every tenth comes twice
_DELIVERY = "least(cast(floor(6 * ({epoch} - low) / (high - low + 1)) AS int), 5) + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END"


def arriving(spark, sf_dir: str, folder: str):
    """A stream of the events in order of delivery, closed by a row beyond the last window."""
    epoch = F.expr("unix_timestamp(ts)")
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min(epoch).alias("low"), F.max(epoch).alias("high"))
    rows = events.select("event_id", "ts", "user_id", "value").withColumn("epoch", epoch).join(F.broadcast(ends))
    delivery = F.expr(_DELIVERY.format(epoch="epoch"))
    again = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("again", F.explode(again)).withColumn("delivery", delivery + F.col("again"))
    codes = F.array(*[F.expr(c) for c in MONITOR_CODES])
    rows = cut(rows.select("event_id", "ts", codes.alias("codes"), "delivery"))
    for number in range(8):
        rows.where(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(folder)
    last = rows.agg(F.max("ts").alias("ts"))
    closing = last.select(F.lit(-1).cast("long").alias("event_id"), F.expr("ts + INTERVAL 400 DAYS").alias("ts"), F.array(F.lit(-1).cast("long")).alias("codes"))
    closing.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("delivery").schema).option("maxFilesPerTrigger", 12).parquet(folder)


@query(
    "collision_windows",
    f"""SELECT epoch(w)::BIGINT AS window_start, epoch(w)::BIGINT + {MONITOR_HOURS * 3600} AS window_end, sum(n)::BIGINT AS rows, count(*) AS unique_paths,
  (sum(n) - count(*))::BIGINT AS collisions, round((sum(n) - count(*)) / sum(n)::DOUBLE, 6) AS collision_rate, max(n) AS largest_bucket
FROM (SELECT time_bucket(INTERVAL {MONITOR_HOURS} HOURS, ts, TIMESTAMP '1970-01-01') AS w, {MONITOR_CODES[0]} AS c1, {MONITOR_CODES[1]} AS c2, count(*) AS n
  FROM events WHERE ts IS NOT NULL GROUP BY ALL) GROUP BY w""",
)
def collision_windows(spark, sf_dir):
    """Late and repeated deliveries change nothing: the delay is longer than three deliveries take."""
    root = scratch(spark)
    stream = arriving(spark, sf_dir, root + "/events")
    found = monitor.collision_windows(stream, "event_id", width=f"{MONITOR_HOURS} hours", delay="25 days")
    run = (
        found.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", root + "/progress")
        .trigger(availableNow=True)
        .start(root + "/windows")
    )
    run.awaitTermination()
    out = spark.read.schema(found.schema).parquet(root + "/windows")
    out = rounded(out, "collision_rate")
    return out.withColumns({c: F.unix_timestamp(c) for c in ("window_start", "window_end")})
