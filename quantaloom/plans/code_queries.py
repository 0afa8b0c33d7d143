"""Queries over code matrices: collision, coverage, bucket sizes, usage, comparison, top buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantaloom.functions import codes as K
from quantaloom.functions.fields import pack_hardcode, unpack_hardcode
from quantaloom.operators import content, metrics, ranking
from quantaloom.plans.base import (
    LINE_CODES,
    LINE_CODES_SQL,
    ORDER_CODES_SQL,
    cte,
    line_codes,
    order_codes,
    picked,
    query,
    rounded,
    table,
)

RATES = ["collision_rate", "icr", "coverage", "mean", "median", "p25", "p75"]


def level_sql(codes_sql: str, levels: int = 5, by: str | None = None, sizes: str = "default") -> str:
    """DuckDB form of the level metrics: one grouped count per prefix length."""
    scopes = ["NULL::VARCHAR", by] if by else ["NULL::VARCHAR"]
    parts = []
    for scope in scopes:
        for level in range(1, levels + 1):
            cols = ", ".join(f"c{i}" for i in range(1, level + 1))
            name = "'overall'" if scope.startswith("NULL") else f"'{by}'"
            group = "" if scope.startswith("NULL") else f", {scope}"
            parts.append(
                f"SELECT {name} AS scope, {scope} AS g, {level} AS level, c{level} AS own, count(*) AS n FROM codes GROUP BY {cols}{group}"
            )
    inferred = "greatest(max(own), 0) + 1"
    if sizes == "default":
        size = f"CASE WHEN level <= 4 THEN greatest({inferred}, 1024) ELSE {inferred} END"
    else:
        known = sizes.split(",")
        size = "CASE level " + " ".join(f"WHEN {i + 1} THEN {s}" for i, s in enumerate(known)) + f" ELSE {inferred} END"
    return f"""
WITH codes AS ({codes_sql}),
b AS ({' UNION ALL '.join(parts)}),
s AS (SELECT scope, g, level, count(*) AS bucket_count, sum(n) AS n, max(n) AS max, avg(n) AS mean,
      quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75,
      {size} AS codebook_size FROM b GROUP BY scope, g, level),
m AS (SELECT *, max(bucket_count) OVER (PARTITION BY scope, g) AS unique_paths,
      product(codebook_size) OVER (PARTITION BY scope, g ORDER BY level) AS capacity FROM s)
"""


def core_select(extra: str = "") -> str:
    return f"""SELECT {extra} level::INT AS level, n::BIGINT AS n, unique_paths::BIGINT AS unique_paths,
round((n - unique_paths)::DOUBLE / n, 6) AS collision_rate, round(unique_paths::DOUBLE / n, 6) AS icr,
round(bucket_count::DOUBLE / n, 6) AS coverage, codebook_size::BIGINT AS codebook_size,
round(log10(bucket_count / capacity), 6) AS log_capacity_use FROM m"""


def stats_select(extra: str = "") -> str:
    return f"""SELECT {extra} level::INT AS level, bucket_count::BIGINT AS bucket_count, round(mean, 6) AS mean,
round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, max::BIGINT AS max FROM m"""


def core_shape(df):
    out = df.withColumn("log_capacity_use", F.log10("capacity_use")).drop("capacity_use")
    return rounded(out, "collision_rate", "icr", "coverage", "log_capacity_use")


@query("core_metrics", level_sql(LINE_CODES_SQL) + core_select())
def core_metrics(spark, sf_dir):
    return core_shape(metrics.core_metrics(line_codes(spark, sf_dir).drop("domain")))


@query("core_metrics_sized", level_sql(LINE_CODES_SQL, sizes="16,32,8,8,512") + core_select())
def core_metrics_sized(spark, sf_dir):
    return core_shape(metrics.core_metrics(line_codes(spark, sf_dir).drop("domain"), sizes=[16, 32, 8, 8, 512]))


@query("codebook_sizes", level_sql(LINE_CODES_SQL) + "SELECT level::INT AS level, codebook_size::BIGINT AS codebook_size FROM m")
def codebook_sizes(spark, sf_dir):
    return metrics.codebook_sizes(line_codes(spark, sf_dir).drop("domain"))


@query("bucket_stats", level_sql(LINE_CODES_SQL) + stats_select())
def bucket_stats(spark, sf_dir):
    return rounded(metrics.bucket_stats(line_codes(spark, sf_dir).drop("domain")), *RATES)


SUMMARY_SQL = (
    level_sql(LINE_CODES_SQL)
    + """SELECT view::INT AS view, level::INT AS level, n::BIGINT AS n, u::BIGINT AS unique_paths,
round((n - u)::DOUBLE / n, 6) AS collision_rate, round(bucket_count::DOUBLE / n, 6) AS coverage, max::BIGINT AS max,
round(median, 6) AS median
FROM (SELECT m.*, view, max(bucket_count) OVER (PARTITION BY view) AS u
      FROM m, (VALUES (4), (5)) w(view) WHERE level <= view)"""
)


@query("summary_views", SUMMARY_SQL)
def summary_views(spark, sf_dir):
    out = metrics.summarize(line_codes(spark, sf_dir).drop("domain"))
    keep = ["view", "level", "n", "unique_paths", "collision_rate", "coverage", "max", "median"]
    return rounded(out.select(*keep), *RATES)


@query("domain_metrics", level_sql(LINE_CODES_SQL, by="domain") + core_select("scope, g AS domain,"))
def domain_metrics(spark, sf_dir):
    return core_shape(metrics.core_metrics(line_codes(spark, sf_dir), by="domain"))


@query("domain_bucket_stats", level_sql(LINE_CODES_SQL, by="domain") + stats_select("scope, g AS domain,"))
def domain_bucket_stats(spark, sf_dir):
    return rounded(metrics.bucket_stats(line_codes(spark, sf_dir), by="domain"), *RATES)


MARGINAL_PARTS = " UNION ALL ".join(
    f"SELECT {i} AS level, c{i} AS code, count(*) AS n FROM codes GROUP BY c{i}" for i in range(1, 6)
)


@query(
    "marginal_metrics",
    f"""WITH codes AS ({LINE_CODES_SQL}), b AS ({MARGINAL_PARTS})
SELECT level::INT AS level, count(*)::BIGINT AS active, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median,
round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75, max(n)::BIGINT AS max,
(max(code) + 1)::BIGINT AS codebook_size, round(count(*)::DOUBLE / (max(code) + 1), 6) AS capacity_use
FROM b GROUP BY level""",
)
def marginal_metrics(spark, sf_dir):
    out = metrics.marginal_metrics(line_codes(spark, sf_dir).drop("domain"))
    return rounded(out, "capacity_use", *RATES)


@query(
    "layer_usage",
    f"""WITH codes AS ({LINE_CODES_SQL}), b AS ({MARGINAL_PARTS}),
other AS (SELECT c1, c2, c3, c4 // 2 AS c4, c5 FROM codes),
o AS ({MARGINAL_PARTS.replace('FROM codes', 'FROM other')}),
x AS (SELECT level, count(*) AS a, max(n) AS m FROM b GROUP BY level),
y AS (SELECT level, count(*) AS a, max(n) AS m FROM o GROUP BY level)
SELECT x.level::INT AS level, x.a::BIGINT AS active_baseline, x.m::BIGINT AS max_count_baseline,
round(x.a::DOUBLE / CASE x.level WHEN 5 THEN 512 ELSE 1024 END, 6) AS utilization_baseline,
y.a::BIGINT AS active_candidate, y.m::BIGINT AS max_count_candidate,
round(y.a::DOUBLE / CASE y.level WHEN 5 THEN 512 ELSE 1024 END, 6) AS utilization_candidate
FROM x JOIN y ON x.level = y.level""",
)
def layer_usage(spark, sf_dir):
    base = line_codes(spark, sf_dir).drop("domain")
    other = base.withColumn("c4", F.floor(F.col("c4") / 2).cast("int"))
    return rounded(metrics.layer_usage(base, other), "utilization_baseline", "utilization_candidate")


@query(
    "collision_rate",
    f"""WITH codes AS ({LINE_CODES_SQL}), p AS (SELECT count(*) AS n FROM codes GROUP BY c1, c2, c3, c4, c5)
SELECT sum(n)::BIGINT AS n, count(*)::BIGINT AS unique_paths,
round((sum(n) - count(*))::DOUBLE / sum(n), 6) AS collision_rate FROM p""",
)
def collision_rate(spark, sf_dir):
    return rounded(metrics.collision_rate(line_codes(spark, sf_dir).drop("domain")), "collision_rate")


_STAGE_TAIL = """SELECT '{tag}' AS {label}, level::INT AS level, n::BIGINT AS n, bucket_count::BIGINT AS bucket_count,
max::BIGINT AS max, round((n - unique_paths)::DOUBLE / n, 6) AS collision_rate FROM m"""


def _stacked(label: str, runs: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({level_sql(sql, 4)} {_STAGE_TAIL.format(tag=tag, label=label)})" for tag, sql in runs.items()
    )


BALANCED_SQL = "SELECT c1, c2, c3, (hash_slot % 8)::INT AS c4 FROM (SELECT c1, c2, c3, c4 + c5 AS hash_slot FROM ({}))".format(LINE_CODES_SQL)


def _balanced(df):
    return df.select("c1", "c2", "c3", ((F.col("c4") + F.col("c5")) % 8).cast("int").alias("c4"))


@query("before_after", _stacked("stage", {"before_balance": LINE_CODES_SQL, "after_balance": BALANCED_SQL}))
def before_after(spark, sf_dir):
    base = line_codes(spark, sf_dir)
    out = metrics.before_after(base.select("c1", "c2", "c3", "c4"), _balanced(base))
    return rounded(out.select("stage", "level", "n", "bucket_count", "max", "collision_rate"), "collision_rate")


THREE_WAY = {
    "baseline": f"SELECT c1, c2, c3, c4 FROM ({LINE_CODES_SQL}) WHERE domain = 'A'",
    "same_source": f"SELECT c1, c2, c3, c4 FROM ({LINE_CODES_SQL})",
    "variant": BALANCED_SQL,
}


@query("three_way_comparison", _stacked("system", THREE_WAY))
def three_way_comparison(spark, sf_dir):
    base = line_codes(spark, sf_dir)
    four = ["c1", "c2", "c3", "c4"]
    runs = {
        "baseline": base.where(F.col("domain") == "A").select(*four),
        "same_source": base.select(*four),
        "variant": _balanced(base),
    }
    out = metrics.compare(runs)
    return rounded(out.select("system", "level", "n", "bucket_count", "max", "collision_rate"), "collision_rate")


@query(
    "distinct_prefixes",
    f"""WITH codes AS ({LINE_CODES_SQL})
SELECT c1, c2, c3, count(*)::BIGINT AS n FROM codes GROUP BY c1, c2, c3""",
)
def distinct_prefixes(spark, sf_dir):
    buckets = metrics.prefix_buckets(line_codes(spark, sf_dir).drop("domain"))
    return buckets.where(F.col("level") == 3).select("c1", "c2", "c3", "n")


@query(
    "packed_codes",
    f"""WITH r AS ({cte(LINE_CODES, 'lineitem')}), p AS (SELECT sale, year, ((((CASE WHEN 2035 - year BETWEEN 0 AND 125 THEN 2035 - year ELSE 0 END)::INT & 127) << 2) | sale)::INT AS v9,
((least(greatest(year, 0), 63)::INT << 2) | least(greatest(sale, 0), 2))::INT AS legacy_a,
((least(greatest(sale, 0), 3)::INT << 6) | least(greatest(year, 0), 63))::INT AS legacy_b FROM r)
SELECT v9, legacy_a, legacy_b, (v9 & 3)::INT AS sale, (2035 - (v9 >> 2))::INT AS year, count(*)::BIGINT AS n
FROM p GROUP BY ALL""",
)
def packed_codes(spark, sf_dir):
    rows = picked(table(spark, sf_dir, "lineitem"), LINE_CODES)
    packs = {lay: pack_hardcode(F.col("sale"), F.col("year"), lay) for lay in ("v9", "legacy_a", "legacy_b")}
    counts = rows.select(*[c.alias(n) for n, c in packs.items()]).groupBy("v9", "legacy_a", "legacy_b").agg(F.count("*").alias("n"))
    back = unpack_hardcode(F.col("v9"))
    return counts.select("v9", "legacy_a", "legacy_b", back["sale"].alias("sale"), back["year"].alias("year"), "n")


@query(
    "packed_usage",
    f"WITH codes AS ({LINE_CODES_SQL}) SELECT count(*)::BIGINT AS rows, count(DISTINCT c5)::BIGINT AS unique_hardcode FROM codes",
)
def packed_usage(spark, sf_dir):
    return content.packed_usage(line_codes(spark, sf_dir), "c5")


# -- rows with identity ----------------------------------------------------------------------------


@query(
    "top_buckets",
    f"""WITH codes AS ({ORDER_CODES_SQL}), b AS (
SELECT 1 AS level, c1, NULL::INT AS c2, NULL::INT AS c3, NULL::INT AS c4, count(*) AS n, min(idx) AS f FROM codes GROUP BY c1 UNION ALL
SELECT 2, c1, c2, NULL, NULL, count(*), min(idx) FROM codes GROUP BY c1, c2 UNION ALL
SELECT 3, c1, c2, c3, NULL, count(*), min(idx) FROM codes GROUP BY c1, c2, c3 UNION ALL
SELECT 4, c1, c2, c3, c4, count(*), min(idx) FROM codes GROUP BY c1, c2, c3, c4)
SELECT level::INT AS level, c1, c2, c3, c4, n::BIGINT AS n, rk::INT AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, f) AS rk FROM b) WHERE rk <= 5""",
)
def top_buckets(spark, sf_dir):
    return content.top_buckets(order_codes(spark, sf_dir).select("idx", "c1", "c2", "c3", "c4"), 5).drop("first_idx")


@query(
    "first_rows_per_bucket",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT c1, idx, rn::INT AS rn FROM (
SELECT c1, idx, row_number() OVER (PARTITION BY c1 ORDER BY idx) AS rn FROM codes) WHERE rn <= 512""",
)
def first_rows_per_bucket(spark, sf_dir):
    return ranking.first_rows(order_codes(spark, sf_dir).select("c1", "idx"), ["c1"], 512, [F.col("idx")])


@query(
    "rank_in_bucket",
    f"""WITH codes AS ({ORDER_CODES_SQL})
SELECT idx, c1, row_number() OVER (PARTITION BY c1 ORDER BY c2 DESC, idx)::BIGINT AS rank FROM codes""",
)
def rank_in_bucket(spark, sf_dir):
    rows = order_codes(spark, sf_dir).select("idx", "c1", "c2")
    return ranking.rank_within(rows, ["c1"], [F.col("c2").desc(), F.col("idx")]).select("idx", "c1", "rank")


@query(
    "row_numbers",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice, "
    "(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1)::BIGINT AS idx FROM lineitem",
)
def row_numbers(spark, sf_dir):
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(*key)
    out = ranking.with_row_idx(rows, [F.col(k) for k in key])
    return rounded(out, "l_extendedprice", digits=2)


@query("slice_rows", f"WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, c1, c2 FROM codes WHERE idx >= 1000 AND idx < 9000")
def slice_rows(spark, sf_dir):
    return ranking.slice_rows(order_codes(spark, sf_dir), 1000, 9000).select("idx", "c1", "c2")


TOKENS_SQL = " || ',' || ".join(f"'<{chr(96 + i)}_' || c{i} || '>'" for i in range(1, 5))


@query("format_tokens", f"WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, {TOKENS_SQL} AS tokens FROM codes")
def format_tokens(spark, sf_dir):
    rows = order_codes(spark, sf_dir)
    return rows.select("idx", F.array_join(K.format_sid(F.array("c1", "c2", "c3", "c4")), ",").alias("tokens"))


@query(
    "format_subspace_tokens",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, '<a1_' || c1 || '>,<a2_' || c2 || '>' AS sid_subspace1,
'<b1_' || c3 || '>,<b2_' || c4 || '>' AS sid_subspace2 FROM codes""",
)
def format_subspace_tokens(spark, sf_dir):
    from quantaloom.operators.records import subspace_sids

    tokens = K.format_sid(F.array("c1", "c2", "c3", "c4"), "subspace", per_part=2)
    out = subspace_sids(order_codes(spark, sf_dir).select("idx", tokens.alias("tokens")), 2)
    return out.select("idx", *[F.array_join(f"sid_subspace{i}", ",").alias(f"sid_subspace{i}") for i in (1, 2)])


@query("parse_tokens", f"WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, c1, c2, c3, c4 FROM codes")
def parse_tokens(spark, sf_dir):
    rows = order_codes(spark, sf_dir).select("idx", K.format_sid(F.array("c1", "c2", "c3", "c4")).alias("t"))
    strict, lenient = K.parse_sid(F.col("t")), K.parse_sid(F.col("t"), strict=False)
    rows = rows.select("idx", F.when(strict == lenient, strict).alias("codes"))
    return rows.select("idx", *[F.get("codes", F.lit(i)).alias(f"c{i + 1}") for i in range(4)])


@query(
    "prefixes_and_trim",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, '<a_' || c1 || '><b_' || c2 || '>' AS prefix2,
c1 || '-' || c2 || '-' || c3 || '-' || c4 AS trimmed FROM codes""",
)
def prefixes_and_trim(spark, sf_dir):
    five = F.array("c1", "c2", "c3", "c4", (F.col("c1") + 100).cast("int"))
    rows = order_codes(spark, sf_dir).select("idx", five.alias("codes"))
    return rows.select(
        "idx",
        K.prefix_text(K.format_sid(F.col("codes")), 2).alias("prefix2"),
        F.array_join(K.trim_levels(F.col("codes"), 4, strict=True).cast("array<string>"), "-").alias("trimmed"),
    )


@query("unpack_bits", f"WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, c1, c2, c3, c4 FROM codes")
def unpack_bits(spark, sf_dir):
    packed = F.col("c1").cast("bigint")
    for i, c in enumerate(("c2", "c3", "c4"), start=1):
        packed = packed.bitwiseOR(F.shiftleft(F.col(c).cast("bigint"), 10 * i))
    rows = order_codes(spark, sf_dir).select("idx", K.unpack_bits(packed, 10, 4).alias("codes"))
    return rows.select("idx", *[F.get("codes", F.lit(i)).alias(f"c{i + 1}") for i in range(4)])


RUNS = {"run": "o_orderpriority", "epoch": "year(o_orderdate)", "price": "o_totalprice", "cust": "o_custkey"}
RUNS_SQL = f"""SELECT run, epoch, round(avg(price), 2) AS loss, (count(*) - count(DISTINCT cust))::DOUBLE / count(*) AS collision_rate
FROM ({cte(RUNS, 'orders')}) GROUP BY run, epoch"""


@query(
    "best_runs",
    f"""WITH r AS (SELECT run || '/' || epoch AS run, epoch, loss, collision_rate FROM ({RUNS_SQL}))
SELECT 'best_collision' AS reason, arg_min(run, collision_rate) AS run FROM r UNION ALL
SELECT 'best_loss', arg_min(run, loss) FROM r UNION ALL
SELECT 'newest', run FROM (SELECT run FROM r ORDER BY epoch DESC, run LIMIT 3) UNION ALL
SELECT 'lowest_collision', run FROM (SELECT run FROM r ORDER BY collision_rate, epoch, run LIMIT 3)""",
)
def best_runs(spark, sf_dir):
    rows = picked(table(spark, sf_dir, "orders"), RUNS)
    runs = rows.groupBy("run", "epoch").agg(
        F.round(F.avg("price"), 2).alias("loss"),
        ((F.count("*") - F.countDistinct("cust")) / F.count("*")).alias("collision_rate"),
    )
    runs = runs.select(F.concat_ws("/", "run", F.col("epoch").cast("string")).alias("run"), "epoch", "loss", "collision_rate")
    return metrics.best_runs(runs, 3)


# -- content of prefix buckets ---------------------------------------------------------------------

_SCALAR = "coalesce(list_filter(list_transform(regexp_split_to_array({c}, '[;,；、|]+'), lambda x: trim(x)), lambda x: x <> '')[1], '(缺失)')"
_VALUES = "list_filter(list_transform(regexp_split_to_array({c}, '[;,；、|]+'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "bucket_purity",
    f"""WITH codes AS ({ORDER_CODES_SQL}), l AS (
SELECT c1, c2, 'pay_type' AS field, {_SCALAR.format(c='pay_type')} AS value FROM codes UNION ALL
SELECT c1, c2, 'genre_types', {_SCALAR.format(c='genre_types')} FROM codes),
k AS (SELECT c1, c2, field, value, count(*) AS n FROM l GROUP BY ALL)
SELECT c1, c2, field, sum(n)::BIGINT AS n, round(max(n)::DOUBLE / sum(n), 6) AS purity FROM k GROUP BY c1, c2, field""",
)
def bucket_purity(spark, sf_dir):
    return rounded(content.purity(order_codes(spark, sf_dir), 2, ["pay_type", "genre_types"]), "purity")


@query(
    "bucket_field_top",
    f"""WITH codes AS ({ORDER_CODES_SQL}), l AS (
SELECT c1, idx, 'pay_type' AS field, {_SCALAR.format(c='pay_type')} AS value FROM codes UNION ALL
SELECT c1, idx, 'genre_types', unnest({_VALUES.format(c='genre_types')}) FROM codes),
k AS (SELECT c1, field, value, count(*) AS n, min(idx) AS f FROM l GROUP BY ALL)
SELECT c1, field, value, n::BIGINT AS n, rk::INT AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY c1, field ORDER BY n DESC, f, value) AS rk FROM k) WHERE rk <= 5""",
)
def bucket_field_top(spark, sf_dir):
    out = content.field_top(order_codes(spark, sf_dir), 1, ["pay_type", "genre_types"], 5, multi=("genre_types",))
    return out.drop("first_idx")


@query(
    "bucket_samples",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT c1, c2, rn::INT AS rn, idx, title FROM (
SELECT c1, c2, idx, left(replace(title, '|', '/'), 55) AS title, row_number() OVER (PARTITION BY c1, c2 ORDER BY idx) AS rn
FROM codes) WHERE rn <= 3""",
)
def bucket_samples(spark, sf_dir):
    return content.bucket_samples(order_codes(spark, sf_dir), 2, F.col("title"))


@query(
    "top_bucket_samples",
    f"""WITH codes AS ({ORDER_CODES_SQL}),
t AS (SELECT c1, c2 FROM codes GROUP BY c1, c2 ORDER BY count(*) DESC, min(idx) LIMIT 5)
SELECT c1, c2, rn::INT AS rn, idx, title FROM (
SELECT c1, c2, idx, left(replace(title, '|', '/'), 160) AS title, row_number() OVER (PARTITION BY c1, c2 ORDER BY idx) AS rn
FROM codes SEMI JOIN t USING (c1, c2)) WHERE rn <= 5""",
)
def top_bucket_samples(spark, sf_dir):
    kept = content.in_top_buckets(order_codes(spark, sf_dir), 5, 2)
    return content.bucket_samples(kept, 2, F.col("title"), content.SAMPLE_ROWS, content.TEXT_CHARS)


def _jaccard_sql(level: int, cap: int | None) -> str:
    keys = ", ".join(f"c{i}" for i in range(1, level + 1))
    match = " AND ".join(f"a.c{i} = b.c{i}" for i in range(1, level + 1))
    out = ", ".join(f"a.c{i} AS c{i}" for i in range(1, level + 1))
    limit = f"WHERE rn <= {cap}" if cap else ""
    return f"""WITH codes AS ({ORDER_CODES_SQL}),
s AS (SELECT {keys}, idx, list_distinct({_VALUES.format(c='genre_types')}) AS tags FROM codes),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY idx) AS rn FROM s WHERE len(tags) > 0) {limit}),
c AS (SELECT {keys}, count(*) AS sets FROM f GROUP BY {keys}),
p AS (SELECT {out}, avg(len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags)))) AS j, count(*) AS pairs
FROM f a JOIN f b ON {match} AND a.idx < b.idx GROUP BY {', '.join(f'a.c{i}' for i in range(1, level + 1))})
SELECT {', '.join(f'p.c{i}' for i in range(1, level + 1))}, sets::BIGINT AS sets, pairs::BIGINT AS pairs, round(j, 6) AS jaccard
FROM p JOIN c USING ({keys})"""


@query("bucket_jaccard", _jaccard_sql(2, None))
def bucket_jaccard(spark, sf_dir):
    return rounded(content.jaccard(order_codes(spark, sf_dir), 2, "genre_types"), "jaccard")


@query(
    "three_way_wide",
    f"""WITH s AS ({_stacked("system", THREE_WAY)}) SELECT level, max(collision_rate) FILTER (WHERE system = 'baseline') AS baseline,
max(collision_rate) FILTER (WHERE system = 'same_source') AS same_source, max(collision_rate) FILTER (WHERE system = 'variant') AS variant
FROM s GROUP BY level""",
)
def three_way_wide(spark, sf_dir):
    base = line_codes(spark, sf_dir)
    four = ["c1", "c2", "c3", "c4"]
    runs = {"baseline": base.where(F.col("domain") == "A").select(*four), "same_source": base.select(*four), "variant": _balanced(base)}
    return rounded(metrics.compare_wide(runs, "collision_rate"), "baseline", "same_source", "variant")
