"""Tokens and metrics: literals, properties and a brute-force comparison."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaloom.functions import codes as K
from quantaloom.operators import cohesion, content, metrics, ranking


def frame(spark, codes, **extra):
    rows = [(i, list(map(int, c)), *[v[i] for v in extra.values()]) for i, c in enumerate(codes)]
    schema = "idx bigint, codes array<int>" + "".join(f", {n} string" for n in extra)
    return spark.createDataFrame(rows, schema)


def test_literal_metrics(spark):
    df = frame(spark, [(1, 1), (1, 1), (1, 2), (2, 1)]).select("codes")
    core = {r.level: r for r in metrics.core_metrics(df).collect()}
    assert (core[1].n, core[1].unique_paths, core[1].collision_rate, core[1].icr) == (4, 3, 0.25, 0.75)
    assert [core[1].coverage, core[2].coverage] == [0.5, 0.75]
    assert core[2].capacity_use == pytest.approx(3 / 1024**2)
    stats = {r.level: r for r in metrics.bucket_stats(df).collect()}
    assert (stats[1].bucket_count, stats[1].mean, stats[1].median, stats[1].max) == (2, 2.0, 2.0, 3)


def test_negative_codes_do_not_size_a_codebook(spark):
    df = frame(spark, [(-1, 5), (3, -1)]).select("codes")
    got = {r.level: r.codebook_size for r in metrics.codebook_sizes(df, sizes=[7]).collect()}
    assert got == {1: 7, 2: 6}


def test_sizes_beyond_bigint_do_not_overflow(spark):
    df = frame(spark, [(1000,) * 8]).select("codes")
    row = metrics.core_metrics(df, sizes=[1024] * 8).where("level = 8").head()
    assert row.capacity_use == pytest.approx(2.0**-80)


def test_unequal_lengths_fail(spark):
    df = frame(spark, [(1, 2), (1, 2, 3)]).select("codes")
    with pytest.raises(Exception, match="expected 2 codes"):
        metrics.core_metrics(df, levels=2).collect()


def test_empty_collision(spark):
    df = spark.createDataFrame([], "codes array<int>")
    wide = df.select(F.lit(0).alias("c1"), F.lit(0).alias("c2"))
    row = metrics.collision_rate(wide).head()
    assert (row.n, row.unique_paths, row.collision_rate) == (0, 0, 1.0)


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60))
def test_metric_properties(spark, rows):
    df = frame(spark, rows).select("codes").repartition(3)
    got = sorted(metrics.level_metrics(df).collect(), key=lambda r: r.level)
    for level, r in enumerate(got, start=1):
        sizes = np.array(list(Counter(x[:level] for x in rows).values()))
        assert (r.n, r.bucket_count, r.max) == (len(rows), len(sizes), sizes.max())
        assert [r.p25, r.median, r.p75] == pytest.approx(np.percentile(sizes, [25, 50, 75]).tolist())
        assert r.mean == pytest.approx(sizes.mean())
        assert r.icr + r.collision_rate == pytest.approx(1)
    assert all(a.coverage <= b.coverage for a, b in itertools.pairwise(got))


def test_domains_named_like_the_overall_scope(spark):
    df = frame(spark, [(1, 1), (1, 2), (2, 1)], domain=["overall", None, "overall"]).drop("idx")
    got = {(r.scope, r.domain, r.level): r.n for r in metrics.level_metrics(df, by="domain").collect()}
    assert got[("overall", None, 1)] == 3
    assert got[("domain", "overall", 1)] == 2
    assert got[("domain", "__missing__", 2)] == 1


def test_marginals(spark):
    df = frame(spark, [(0, 4), (0, 2), (1, 2)]).select("codes")
    got = {r.level: r for r in metrics.marginal_metrics(df).collect()}
    assert (got[1].active, got[1].max, got[1].codebook_size, got[1].capacity_use) == (2, 2, 2, 1.0)
    assert (got[2].active, got[2].codebook_size, got[2].capacity_use) == (2, 5, 0.4)


def test_tokens_round_trip(spark):
    df = frame(spark, [(7, 1, 0, 503)])
    tokens = df.select(K.format_sid(F.col("codes")).alias("t"))
    assert tokens.head().t == ["<a_7>", "<b_1>", "<c_0>", "<d_503>"]
    assert tokens.select(K.parse_sid(F.col("t"))).head()[0] == [7, 1, 0, 503]


def test_strict_tokens(spark):
    df = spark.createDataFrame([(["<a_-1>"],)], "t array<string>")
    assert df.select(K.parse_sid(F.col("t"))).head()[0] == [-1]
    bad = spark.createDataFrame([(["<a1_3>"],)], "t array<string>")
    with pytest.raises(Exception, match="not a level token"):
        bad.select(K.parse_sid(F.col("t"))).collect()
    assert bad.select(K.parse_sid(F.col("t"), strict=False)).head()[0] == [3]


def test_subspace_tokens(spark):
    df = frame(spark, [(1, 2, 3, 4)])
    assert df.select(K.format_sid(F.col("codes"), "subspace", 2)).head()[0] == ["<a1_1>", "<a2_2>", "<b1_3>", "<b2_4>"]


def test_unpack_bits_with_uneven_widths(spark):
    df = spark.createDataFrame([(5 | (9 << 4) | (1023 << 8),)], "v bigint")
    assert df.select(K.unpack_bits(F.col("v"), [4, 4, 10])).head()[0] == [5, 9, 1023]


def brute_cosine(x, codes, level):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm == 0, 1, norm)
    buckets = {}
    for i, c in enumerate(codes):
        buckets.setdefault(tuple(c[:level]), []).append(i)
    sims, pairs = [], []
    for rows in buckets.values():
        if len(rows) > 1:
            s = unit[rows] @ unit[rows].T
            sims.append(s[np.triu_indices(len(rows), 1)].mean())
            pairs.append(len(rows) * (len(rows) - 1) // 2)
    return np.average(sims, weights=pairs), np.mean(sims)


@pytest.mark.parametrize("dim", [5, 300])
def test_cosine_equals_pairs(spark, dim):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, dim))
    x[3] = 0
    codes = rng.integers(0, 3, size=(60, 2))
    rows = [(i, [int(v) for v in codes[i]], [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, codes array<int>, embedding array<double>").repartition(5)
    for r in cohesion.bucket_cosine(df).collect():
        assert (r.weighted_sim, r.unweighted_sim) == pytest.approx(brute_cosine(x, codes, r.level), abs=1e-6)


def test_a_level_without_pairs_has_similarity_zero(spark):
    rows = [(0, [1, 1], [1.0, 0.0]), (1, [1, 2], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "idx bigint, codes array<int>, embedding array<double>")
    got = {r.level: (r.bucket_count, r.pairs, r.weighted_sim, r.unweighted_sim) for r in cohesion.bucket_cosine(df).collect()}
    assert got == {1: (1, 1, 1.0, 1.0), 2: (0, 0, 0.0, 0.0)}


def test_cosine_levels_and_domains(spark):
    rows = [(0, [1, 1], [1.0, 0.0], "a"), (1, [1, 2], [0.0, 1.0], "a"), (2, [1, 2], [0.0, 2.0], "b")]
    df = spark.createDataFrame(rows, "idx bigint, codes array<int>, embedding array<double>, domain string")
    got = {(r.scope, r.domain, r.level): r.weighted_sim for r in cohesion.bucket_cosine(df, by="domain").collect()}
    assert got[("overall", None, 1)] == pytest.approx(1 / 3)
    assert got[("overall", None, 2)] == pytest.approx(1.0)
    assert got[("domain", "a", 1)] == pytest.approx(0.0)
    only = cohesion.bucket_cosine(df, exclude_last=True).collect()
    assert [r.level for r in only] == [1]


def brute_jaccard(sets):
    sets = [s for s in sets if s]
    values = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
    return np.mean(values) if values else None


@pytest.mark.parametrize("most", [10, 2, 0])
def test_jaccard_equals_pairs(spark, most):
    rnd = random.Random(3)
    tags = [";".join(rnd.sample("abcdef", rnd.randint(0, 4))) for _ in range(80)]
    # one bucket holds most of the rows, with many equal sets
    codes = [(0 if rnd.random() < 0.7 else rnd.randint(1, 3),) for _ in range(80)]
    df = frame(spark, codes, tags=tags).repartition(4)
    got = {r.c1: r for r in content.jaccard(df, 1, "tags", most=most).collect()}
    for code in {c[0] for c in codes}:
        want = brute_jaccard([set(filter(None, t.split(";"))) for t, c in zip(tags, codes) if c[0] == code])
        if want is None:
            assert code not in got
        else:
            assert got[code].jaccard == pytest.approx(want)


def test_jaccard_of_a_bucket_of_many_distinct_sets(spark):
    """100,000 distinct sets in one bucket: one tag that all have, one of a hundred groups, one of their own."""
    n = 100_000
    tags = F.concat_ws(";", F.lit("all"), F.concat(F.lit("g"), F.col("id") % 100), F.concat(F.lit("own"), "id"))
    df = spark.range(n).select(F.col("id").alias("idx"), F.array(F.lit(1)).alias("codes"), tags.alias("tags"))
    got = content.jaccard(df, 1, "tags").collect()
    # two of six tags in common with 999 sets, one with the rest
    want = (999 * 2 / 4 + (n - 1000) * 1 / 5) / (n - 1)
    assert [(r.sets, r.pairs) for r in got] == [(n, n * (n - 1) // 2)] and got[0].jaccard == pytest.approx(want)


def test_ties_go_to_the_first_seen(spark):
    df = frame(spark, [(2,), (1,), (1,), (2,), (3,)])
    got = content.top_buckets(df, 2).orderBy("rank").collect()
    assert [(r.c1, r.n) for r in got] == [(2, 2), (1, 2)]


def test_bucket_caps_follow_record_order(spark):
    df = spark.range(513).select(F.col("id").alias("idx"), F.lit(1).alias("k")).repartition(7)
    kept = ranking.first_rows(df, ["k"], 512, [F.col("idx")])
    assert kept.agg(F.max("idx"), F.count("*")).head()[:] == (511, 512)


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.hash("id").alias("h")
    )
    got = ranking.rank_within(df.repartition(8), ["k"], [F.col("h").desc(), F.col("id")]).toPandas()
    want = got.sort_values(["k", "h", "id"], ascending=[True, False, True]).groupby("k").cumcount() + 1
    assert (want.sort_index() == got["rank"].sort_index()).all()


def test_ranks_with_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    got = {r.id: r["rank"] for r in ranking.rank_within(df, ["k"], [F.col("id").desc()]).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_purity_counts_missing_values(spark):
    df = frame(spark, [(1,)] * 4, f=["x", None, "", "x;y"])
    assert content.purity(df, 1, ["f"]).head().purity == 0.5


def test_top_field_values(spark):
    df = frame(spark, [(1,)] * 3, f=["x;y", "y", "y;x"], g=["p", "q", "p"])
    got = {(r.field, r["rank"]): (r.value, r.n) for r in content.field_top(df, 1, ["f", "g"], 2, multi=("f",)).collect()}
    assert got == {("f", 1): ("y", 3), ("f", 2): ("x", 2), ("g", 1): ("p", 2), ("g", 2): ("q", 1)}


def test_sample_titles(spark):
    df = frame(spark, [(1,)] * 4, t=["a|b", "x\ny", "z" * 80, "late"])
    got = [r.title for r in content.bucket_samples(df, 1, F.col("t")).orderBy("rn").collect()]
    assert got == ["a/b", "x y", "z" * 55]


def test_summary_views_share_levels(spark):
    df = frame(spark, [(1, 1, 1), (1, 1, 2), (1, 2, 1)]).select("codes")
    got = {(r["view"], r.level): r.unique_paths for r in metrics.summarize(df, views=(2, 3)).collect()}
    assert got == {(2, 1): 2, (2, 2): 2, (3, 1): 3, (3, 2): 3, (3, 3): 3}


def test_comparison_is_pivoted(spark):
    a, b = frame(spark, [(1,), (2,)]).select("codes"), frame(spark, [(1,), (1,)]).select("codes")
    row = metrics.compare_wide({"a": a, "b": b}, "bucket_count").head()
    assert (row.a, row.b) == (2, 1)
    long = metrics.metrics_long(metrics.core_metrics(a), ["level"]).where("metric = 'icr'").head()
    assert long.value == 1.0


@pytest.mark.parametrize("n", [3, 1200])
def test_first_rows_in_two_steps(spark, n):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"))
    df = df.repartition(11)
    one = ranking.first_rows(df, ["k"], n, [F.col("id").desc()], merge_groups=1)
    two = ranking.first_rows(df, ["k"], n, [F.col("id").desc()], merge_groups=4)
    assert sorted(map(tuple, one.select("k", "id", "rn").collect())) == sorted(map(tuple, two.select("k", "id", "rn").collect()))


def test_runs_to_keep(spark):
    rows = [("a", 0, 0.3, 9.0), ("b", 1, 0.1, 5.0), ("c", 2, 0.1, 4.0), ("d", 3, 0.2, 6.0)]
    runs = spark.createDataFrame(rows, "run string, epoch int, collision_rate double, loss double")
    got = sorted(map(tuple, metrics.best_runs(runs, 2).collect()))
    want = [("best_collision", "b"), ("best_loss", "c"), ("lowest_collision", "b"), ("lowest_collision", "c"), ("newest", "c"), ("newest", "d")]
    assert got == want


def test_metrics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "codes array<int>")
    got = [(r.level, r.n, r.unique_paths, r.collision_rate, r.coverage) for r in metrics.core_metrics(empty, levels=2).orderBy("level").collect()]
    assert got == [(1, 0, 0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="pass levels"):
        metrics.core_metrics(empty)
    assert tuple(metrics.collision_rate(empty).head()) == (0, 0, 1.0)
