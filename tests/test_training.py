"""Assignment, balancing, training and upkeep against plain array arithmetic on small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantaloom.functions import vectors as V
from quantaloom.operators import assign, balance, encode, sums, training
from quantaloom.plans import training_queries
from quantaloom.streaming import upkeep
from quantaloom.streaming.upkeep import CodebookUpkeep


def table(spark, x, parts=4):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "idx bigint, embedding array<double>").repartition(parts)


def book(spark, *levels):
    rows = [(l, c, [float(v) for v in r]) for l, m in enumerate(levels, start=1) for c, r in enumerate(m)]
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    return rng.normal(size=(200, 6)), rng.normal(size=(8, 6)), rng.normal(size=(4, 6)) * 0.3


def plain_codes(x, *levels):
    codes, rest = [], x.copy()
    for c in levels:
        pick = ((rest[:, None] - c[None]) ** 2).sum(2).argmin(1)
        codes.append(pick)
        rest = rest - c[pick]
    return np.stack(codes, 1), rest


def test_encode_decode(spark, data):
    x, c1, c2 = data
    want, rest = plain_codes(x, c1, c2)
    out = assign.encode(table(spark, x), book(spark, c1, c2), residual=True)
    got = out.orderBy("idx").collect()
    assert [r.codes for r in got] == want.tolist()
    assert np.allclose([r.residual for r in got], rest)
    back = assign.decode(out, book(spark, c1, c2)).orderBy("idx").collect()
    assert np.allclose([r.decoded for r in back], x - rest)
    first = assign.residual(out.drop("residual"), book(spark, c1, c2), upto=1).orderBy("idx").collect()
    assert np.allclose([r.residual for r in first], x - c1[want[:, 0]])


def test_ties_take_the_lowest_code(spark):
    x = np.array([[0.0, 0.0], [1.0, 1.0]])
    c = np.array([[1.0, 1.0], [-1.0, -1.0], [1.0, 1.0]])
    assert [r.code for r in assign.nearest(table(spark, x), book(spark, c)).orderBy("idx").collect()] == [0, 0]


@pytest.mark.parametrize("limit", [100, 300])
def test_sliced_codebook(spark, data, limit):
    x, c1, _ = data
    want = plain_codes(x, c1)[0][:, 0]
    got = assign.nearest(table(spark, x), book(spark, c1), limit=limit).orderBy("idx").collect()
    assert [r.code for r in got] == want.tolist()


def test_codebooks_beyond_the_bound_give_equal_answers(spark, data, tmp_path):
    """Two centroids a slice: answers must not depend on the bound."""
    x, c1, c2 = data
    limit = 400
    books, rows = book(spark, c1, c2), table(spark, x)
    levels = assign.load_levels(books, limit=limit)
    assert [level.centroids for level in levels] == [None, None] and len(levels[0].slices) == 4

    def same(make, *columns):
        held, cut_up = (sorted(make(bound).select("idx", *columns).collect()) for bound in (10**9, limit))
        for a, b in zip(held, cut_up, strict=True):
            for left, right in zip(a, b):
                assert left == right if np.ndim(left) == 0 else np.allclose(left, right)

    coded = assign.encode(rows, books, residual=True)
    want, rest = plain_codes(x, c1, c2)
    got = assign.encode(rows, books, residual=True, limit=limit).orderBy("idx").collect()
    assert [r.codes for r in got] == want.tolist() and np.allclose([r.residual for r in got], rest)
    same(lambda bound: assign.decode(coded, books, limit=bound), "decoded")
    same(lambda bound: assign.residual(coded.drop("residual"), books, upto=1, limit=bound), "residual")
    same(lambda bound: assign.sinkhorn_batch(rows, books, [0.05, 0.0], 20, 64, limit=bound), "codes")
    first = books.where("level = 1")
    same(lambda bound: balance.balance(rows, first, iters=5, tau=0.5, topk=4, vector="embedding", limit=bound), "code")
    taus = [balance.estimate_tau(rows, first, "embedding", limit=bound) for bound in (10**9, limit)]
    assert taus[0] == pytest.approx(taus[1])
    parts = first.where("code < 4").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "level", "code", F.slice("centroid", 1, 3).alias("centroid"))
    same(lambda bound: training.encode_parts(rows, parts, limit=bound), "codes", "decoded")
    rows.write.parquet(f"{tmp_path}/in")
    stream = upkeep.encode_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), books, limit=limit)
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True)
    sink.start(f"{tmp_path}/out").awaitTermination()
    assert [r.codes for r in spark.read.parquet(f"{tmp_path}/out").orderBy("idx").collect()] == want.tolist()


def test_ties_across_slices_take_the_lowest_code(spark):
    x, c = np.array([[0.0, 0.0], [2.0, 0.0]]), np.array([[1.0, 0.0], [-1.0, 0.0], [3.0, 0.0], [1.0, 0.0]])
    assert [r.code for r in assign.nearest(table(spark, x), book(spark, c), limit=1).orderBy("idx").collect()] == [0, 0]


def test_unequal_vectors_fail(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "idx bigint, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="equal length"):
        assign.encode(df, book(spark, np.eye(2))).collect()


def test_missing_codes_add_nothing(spark, data):
    x, c1, _ = data
    df = spark.createDataFrame([(0, [-1]), (1, [3])], "idx bigint, codes array<int>")
    got = assign.decode(df, book(spark, c1)).orderBy("idx").collect()
    assert got[0].decoded == [0.0] * 6 and np.allclose(got[1].decoded, c1[3])
    bad = spark.createDataFrame([(0, [99])], "idx bigint, codes array<int>")
    with pytest.raises(Exception, match="not in level"):
        assign.decode(bad, book(spark, c1)).collect()


def plain_plan(d, eps, iters, center):
    if center == "global":
        mid = (d.max() + d.min()) / 2
        d = (d - mid) / (d.max() - mid + 1e-5)
    else:
        d = d - d.min(1, keepdims=True)
        d = d / (d.max(1, keepdims=True) + 1e-8)
    plan = np.exp(-d / eps)
    plan = plan / plan.sum()
    for _ in range(iters):
        plan = plan / plan.sum(1, keepdims=True) / len(d)
        plan = plan / plan.sum(0, keepdims=True) / d.shape[1]
    return plan.argmax(1)


@pytest.mark.parametrize("center", ["global", "row"])
def test_batch_balance(spark, data, center):
    x, c1, c2 = data
    out = assign.sinkhorn_batch(table(spark, x), book(spark, c1, c2), [0.05, 0.0], 30, 64, center)
    got = np.array([r.codes for r in out.orderBy("idx").collect()])
    for start in range(0, 200, 64):
        part = x[start : start + 64]
        d = ((part[:, None] - c1[None]) ** 2).sum(2)
        first = plain_plan(d, 0.05, 30, center)
        assert (got[start : start + 64, 0] == first).all()
        second = plain_codes(part - c1[first], c2)[0][:, 0]
        assert (got[start : start + 64, 1] == second).all()


@pytest.mark.parametrize("topk,n", [(2, 203), (8, 203), (3, 5)])
def test_capacities_hold_exactly(spark, data, topk, n):
    _, c1, _ = data
    rng = np.random.default_rng(2)
    # everybody wants the same code
    x = c1[0] + rng.normal(size=(n, 6)) * 0.01
    out = balance.balance(table(spark, x), book(spark, c1), iters=5, topk=topk, vector="embedding").toPandas()
    assert sorted(out.idx) == list(range(n))
    counts = out.groupby("code").size().reindex(range(8), fill_value=0)
    assert counts.tolist() == [n // 8 + (c < n % 8) for c in range(8)]


def plain_balance(plan, ties, room):
    """Pairs of row and code from the best score down, ties by the larger hash: taken while both are free."""
    free, out = list(room), {}
    order = sorted(((s, ties[i], -c, i) for (i, c), s in np.ndenumerate(plan)), reverse=True)
    for _, _, c, i in order:
        if i not in out and free[-c]:
            out[i] = -c
            free[-c] -= 1
    return out


@pytest.mark.parametrize("topk,n,spread,sizes", [(8, 203, 1.0, None), (4, 90, 3.0, [0, 5, 40, 1, 30, 9, 5, 20]), (8, 60, 0.0, None)])
def test_balance_is_the_stable_assignment(spark, data, topk, n, spread, sizes):
    _, c1, _ = data
    x = c1[0] + np.random.default_rng(5).normal(size=(n, 6)) * spread
    rows = table(spark, x)
    got = balance.balance(rows, book(spark, c1), iters=0, tau=2.0, topk=topk, vector="embedding", sizes=sizes).collect()
    hashes = rows.select("idx", F.xxhash64(F.lit(42), "idx").alias("h")).collect()
    ties = {r.idx: r.h % (1 << 64) for r in hashes}
    plan = balance._log_plan(x, assign.load_levels(book(spark, c1))[0], np.zeros(8), 2.0)
    if spread == 0.0:
        plan = np.repeat(plan[:1], n, axis=0)
    want = plain_balance(plan, ties, balance.capacities(n, 8) if sizes is None else sizes)
    assert {r.idx: r.code for r in got} == want


def test_bins_keep_the_order_of_keys():
    rng = np.random.default_rng(3)
    score = np.r_[-np.exp(rng.normal(size=500) * 9), 0.0, -0.0, np.full(98, -1.5)]
    tie = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
    keys = [(int(a) << 64) | int(b) for a, b in zip(balance._ordered_bits(score), tie)]
    for low, high in [(0, balance.TOP), (sorted(keys)[50], sorted(keys)[400]), (sorted(keys)[300], sorted(keys)[301]), (keys[7], keys[7] + 1)]:
        cuts = balance.Cutoffs(np.ones(1, np.int64))
        cuts.low, cuts.high = [low], [high]
        upper, lower, bits = cuts.arrays()
        inside = np.array([key >= low for key in keys])
        assert (balance._admitted(score, tie, upper, lower) == inside).all()
        zeros = np.zeros(inside.sum(), int)
        got = balance._bins(score[inside], tie[inside], upper[zeros], lower[zeros], bits[zeros])
        assert got.tolist() == [min((key - low) >> int(bits[0]), 1 << balance.BIN_BITS) for key in keys if key >= low]


def test_balance_refuses_repeated_row_numbers_and_takes_no_rows(spark, data):
    _, c1, _ = data
    rows = table(spark, np.repeat(c1[:1], 20, axis=0))
    with pytest.raises(ValueError, match="unique"):
        balance.balance(rows.withColumn("idx", F.lit(1).cast("long")), book(spark, c1), iters=0, tau=1.0, vector="embedding")
    assert balance.balance(rows.where("idx < 0"), book(spark, c1), iters=1, tau=1.0, vector="embedding").collect() == []


def test_potentials_balance_the_columns(spark, data):
    x, c1, _ = data
    level = assign.load_levels(book(spark, c1))[0]
    target = np.full(8, 25.0)
    potential = balance.column_potentials(table(spark, x), level, target, 1.0, 60, "embedding")
    mass = np.exp(balance._log_plan(x, level, potential, 1.0)).sum(0)
    assert np.allclose(mass, target, atol=0.5)


def test_last_level_balance_keeps_the_prefix(spark, data):
    x, c1, c2 = data
    coded = assign.encode(table(spark, x), book(spark, c1, c2)).select("idx", "embedding", "codes")
    after = balance.balance_last_level(coded, book(spark, c1, c2), iters=5).orderBy("idx").collect()
    before = coded.orderBy("idx").collect()
    assert all(a.codes[0] == b.codes[0] for a, b in zip(after, before))
    assert np.bincount([r.codes[1] for r in after]).tolist() == [50] * 4


def test_tau(spark, data):
    x, c1, _ = data
    d = ((x[:, None] - c1[None]) ** 2).sum(2)
    want = np.median(np.percentile(d - d.min(1, keepdims=True), 90, axis=1)) * 0.1
    assert balance.estimate_tau(table(spark, x), book(spark, c1), "embedding") == pytest.approx(want)


def test_kmeans_fills_missing_centroids(spark):
    x = np.array([[1.0, 1.0], [1.0, 1.0], [2.0, 2.0]])
    got = training.fit_codebook(table(spark, x), 5, 3).collect()
    assert len(got) == 5 and {tuple(r.centroid) for r in got} <= {(1.0, 1.0), (2.0, 2.0)}
    empty = table(spark, x).where("idx < 0")
    assert training.fit_codebook(empty, 3, 3, dim=2).count() == 3


def test_residual_error_falls(spark, data):
    x = data[0]
    books = training.fit_rq(table(spark, x), [8, 8, 4], iters=5)
    errors = [
        assign.encode(table(spark, x), books.where(F.col("level") <= l)).agg(F.sum("sq_error")).head()[0] for l in (1, 2, 3)
    ]
    assert errors[0] >= errors[1] >= errors[2]
    with pytest.raises(ValueError):
        training.fit_rq(table(spark, x), [6])


def test_moments_and_rotation(spark, data):
    x = data[0]
    df = table(spark, x).withColumn("other", F.transform("embedding", lambda v: v * 2))
    assert np.allclose(training.cross_moment(df, "embedding", "other"), 2 * x.T @ x)
    rotation, parts = training.fit_opq(table(spark, x), 2, 8, niter=2, iters=3)
    assert np.allclose(rotation @ rotation.T, np.eye(6))
    turned = training.rotate(table(spark, x), rotation).orderBy("idx").collect()
    assert np.allclose([r.embedding for r in turned], x @ rotation.T)
    coded = training.encode_parts(table(spark, x), parts, rotation=rotation).head()
    assert len(coded.codes) == 2 and len(coded.decoded) == 6


def test_rotation_training_holds_one_worker_and_a_piece_at_a_time(spark, data, monkeypatch):
    x = data[0]
    rows, plans, moment = table(spark, x), [], training._moment
    monkeypatch.setattr(training, "_moment", lambda df, *rest: plans.append(df._jdf.queryExecution().toString()) or moment(df, *rest))
    rotation, parts = training.fit_opq(rows, 2, 8, niter=2, iters=3)
    assert len(plans) == 2 and not any("MapInArrow" in plan for plan in plans)
    coded = training.encode_parts(rows, parts, rotation=rotation)
    want = training.cross_moment(coded, "decoded", "embedding")
    assert np.allclose(training.decoded_moment(rows, parts, rotation=rotation), want)
    batch = pa.RecordBatch.from_pydict({"v": [[float(i)] * 6 for i in range(100)], "i": list(range(100))})
    monkeypatch.setattr(training, "PIECE", 8 * 6 * 30)
    cut = list(training.pieces(batch, "v"))
    assert [p.num_rows for p in cut] == [30, 30, 30, 10] and pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in training.pieces(batch.slice(0, 0), "v")] == [0]


def test_ema_rules(spark, data):
    x, c1, _ = data
    want = plain_codes(x, c1)[0][:, 0]
    counts = np.bincount(want, minlength=8)
    totals = np.stack([x[want == k].sum(0) for k in range(8)])
    state = training.ema_state(book(spark, c1).where("level = 1"))
    got = training.ema_step(state, table(spark, x), decay=0.9).orderBy("code").collect()
    size, mass = 0.9 + 0.1 * counts, 0.9 * c1 + 0.1 * totals
    smooth = (size + 1e-5) / (size.sum() + 8e-5) * size.sum()
    assert np.allclose([r.centroid for r in got], mass / smooth[:, None])
    post = training.ema_step(state, table(spark, x), decay=0.9, mode="post").orderBy("code").collect()
    smooth = (counts + 1e-5) / (counts.sum() + 8e-5) * counts.sum()
    assert np.allclose([r.centroid for r in post], 0.9 * c1 + 0.1 * totals / smooth[:, None])


def test_upkeep_is_idempotent(spark, data, tmp_path):
    x, c1, _ = data
    upkeep = CodebookUpkeep(spark, str(tmp_path / "state"), book(spark, c1), decay=0.9)
    first, second = table(spark, x[:100]), table(spark, x[100:])
    upkeep.fold(first, 0)
    upkeep.fold(second, 1)
    once = upkeep.state().orderBy("code").collect()
    upkeep.fold(second, 1)
    assert upkeep.state().orderBy("code").collect() == once
    assert upkeep.codebook().count() == 8


def test_upkeep_keeps_the_newest_states(spark, data, tmp_path):
    x, c1, _ = data
    folder = tmp_path / "state"
    upkeep = CodebookUpkeep(spark, str(folder), book(spark, c1), decay=0.9)
    for i in range(5):
        upkeep.fold(table(spark, x[i * 40 : i * 40 + 40]), i)
    names = sorted(p.name for p in folder.iterdir())
    assert names == ["batch=000000000002", "batch=000000000003", "batch=000000000004", "start"]
    once = upkeep.state().orderBy("code").collect()
    again = CodebookUpkeep(spark, str(folder), book(spark, c1 * 0), decay=0.9)
    again.fold(table(spark, x[160:200]), 4)
    assert again.state().orderBy("code").collect() == once
    with pytest.raises(ValueError, match="states before batch 1 are gone"):
        again.fold(table(spark, x[:40]), 1)


def test_factored_codebook(spark):
    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, -1.0)], "code int, basis_id int, weight double")
    basis = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 3.0])], "basis_id int, vector array<double>")
    got = training.materialize_codebook(weights, basis).orderBy("code").collect()
    assert [r.centroid for r in got] == [[1.0, 6.0], [0.0, -3.0]]


def test_wide_vector_sums(spark):
    x = np.random.default_rng(0).normal(size=(40, 600))
    df = table(spark, x).withColumn("k", F.col("idx") % 3)
    got = sums.vector_sum(df, ["k"], "embedding", 600, [("n", F.count("*"))]).orderBy("k").collect()
    assert [r.n for r in got] == [14, 13, 13]
    assert np.allclose([r.vec_sum for r in got], [x[k::3].sum(0) for k in range(3)])


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(
        V.unit(F.col("a")).alias("u"),
        V.unit(F.col("b")).alias("z"),
        V.cosine(F.col("a"), F.col("b")).alias("c"),
        V.sq_l2(F.col("a"), F.col("b")).alias("d"),
        V.blend([F.col("a"), F.col("b")], F.col("a"), 0.2, 0.8).alias("m"),
    ).head()
    assert row.u == [0.6, 0.8] and row.z == [0.0, 0.0] and (row.c, row.d) == (0.0, 25.0)
    assert row.m == pytest.approx([0.2 * 1.5 + 2.4, 0.2 * 2.0 + 3.2])
    with pytest.raises(ValueError):
        V.blend([F.col("a")], F.col("a"), 0.5, 0.6)


def test_reconstruction_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 4.0])], "a array<double>, b array<double>")
    assert assign.recon_error(df, "a", "b", quant_weight=0.5).head()[:] == (2.5, 2.5, 3.75)
    assert assign.recon_error(df, "a", "b", "l1").head().recon == 1.5


def test_embedding_hook(spark):
    def encoder(texts):
        assert 0 < len(texts) <= 2
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(0, "abc"), (1, None), (2, "  "), (3, "de"), (4, "x")], "idx bigint, t string").coalesce(1)
    got = encode.embed(df, ["t"], encoder, 2, batch_size=2).orderBy("idx").collect()
    assert [r.emb_t for r in got] == [[3.0, 1.0], [0.0, 0.0], [0.0, 0.0], [2.0, 1.0], [1.0, 1.0]]


@pytest.mark.parametrize("activation", ["relu", "tanh", "sigmoid", "leakyrelu", "none"])
def test_dense_layers(spark, data, activation):
    x = data[0]
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(3, 6)), rng.normal(size=3)), (rng.normal(size=(2, 3)), rng.normal(size=2))]
    hidden = encode.ACTIVATIONS[activation](x @ layers[0][0].T + layers[0][1])
    got = encode.dense_score(table(spark, x), layers, activation).orderBy("idx").collect()
    assert np.allclose([r.scored for r in got], hidden @ layers[1][0].T + layers[1][1])


@pytest.mark.parametrize("n", [1, 2, 7, 40, 101])
def test_exact_median_by_bins(spark, monkeypatch, n):
    monkeypatch.setattr(balance, "FEW_VALUES", 3)
    monkeypatch.setattr(balance, "BINS", 4)
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.3, 0.5, rng.lognormal(0, 3, n))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    assert balance.exact_median(df, "v") == pytest.approx(float(np.median(values)))
    assert balance.exact_median(df.limit(0), "v") is None


def test_sample_of_any_size_is_the_rows_with_the_smallest_keys(spark, monkeypatch):
    from quantaloom.operators import sampling

    monkeypatch.setattr(sampling, "FEW_KEYS", 2)
    df = spark.range(500).withColumnRenamed("id", "idx")
    order = [r[0] for r in df.orderBy(sampling.draw_key("idx", 4), "idx").collect()]
    for n in (1, 2, 77, 499):
        assert {r[0] for r in sampling.sample_rows(df, n, 4).collect()} == set(order[:n])


def test_streams_read_a_table_of_one_file_and_of_many(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 1, 8)], i % 3) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    table.repartition(4).write.parquet(str(tmp_path / "many" / "embeddings.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "one_file"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "one_file").glob("part-*")).rename(tmp_path / "one" / "embeddings.parquet")
    for folder in (str(tmp_path / "many"), str(tmp_path / "one")):
        coded = {r["idx"]: [r["c1"], r["c2"]] for r in training_queries.streamed_encoding(spark, folder).collect()}
        want = assign.encode(training_queries.vectors(spark, folder), training_queries.two_level_codebook(spark, folder)).collect()
        assert coded == {r["idx"]: r["codes"] for r in want} and len(coded) == 60
        counts = [r["count"] for r in training_queries.streamed_codebook_upkeep(spark, folder).collect()]
        assert abs(sum(counts) - (0.9 * 3 + 0.1 * 60)) < 1e-4  # three codes start at one row each
