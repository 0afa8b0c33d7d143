"""Record layouts, row-numbered joins and files."""

import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quantaloom.operators import joins, records, sampling
from quantaloom.sources import jsonl, sinks, vectors


def parsed(spark, rows):
    df = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "idx bigint, raw string")
    return records.parse_records(df)


def test_strict_join_needs_every_row(spark):
    a = spark.range(5).withColumnRenamed("id", "idx")
    b = spark.range(4).select(F.col("id").alias("idx"), F.lit("m").alias("meta"))
    assert joins.attach(a, b).count() == 4
    with pytest.raises(Exception, match="no partner for row 4"):
        joins.attach(a, b, strict=True).count()


def test_overwrite_with_present_nulls(spark):
    target = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx bigint, sid string")
    source = spark.createDataFrame([(0, "x", True), (1, None, True), (2, None, False)], "idx bigint, sid string, has boolean")
    out, stats = joins.overwrite(target, source, ["sid"], {"sid": F.col("has")})
    assert [r.sid for r in out.orderBy("idx").collect()] == ["x", None, "c"]
    counters = {"processed": 3, "changed_sid": 2, "missing_sid": 1}
    assert stats.head().asDict() == counters
    seen = Observation()
    out, _ = joins.overwrite(target, source, ["sid"], {"sid": F.col("has")}, seen=seen)
    assert len(out.collect()) == 3 and seen.get == counters


def test_keyed_patch(spark):
    schema = "line bigint, idx string, id string, domain string, indices array<int>, tokens array<string>"
    five = [1, 2, 3, 4, 5]
    tokens = ["<a_1>", "<b_2>", "<c_3>", "<d_4>", "<e_5>"]
    target = spark.createDataFrame(
        [(0, "0", "10", "video", five, tokens), (1, "1", "x", "video", five, tokens), (2, "2", "12", "video", five, None),
         (3, "3", "13", None, five, tokens), (4, "4", "14", "video", [1], tokens), (5, "5", "15", "video", five, tokens)],
        schema,
    )
    source = spark.createDataFrame(
        [(0, "0", "10", "video", [0, 0, 0, 0, 7], None), (1, "0", "10", "video", [0, 0, 0, 0, 9], None),
         (2, "2", "12", "video", [0, 0, 0, 0, 5], None), (3, "5", "15", "station", five, None)],
        schema,
    )
    out, stats = joins.patch_layer5(target, source)
    got = {r.line: r for r in out.collect()}
    assert got[0].indices[4] == 9 and got[0].tokens[4] == "<e_9>"
    assert got[2].tokens is None and got[4].indices == [1] and got[5].indices == five
    counters = {"target_total": 6, "target_bad": 3, "target_missing": 1, "target_changed": 1}
    assert stats.head().asDict() == counters
    seen = Observation()
    out, _ = joins.patch_layer5(target, source, seen=seen)
    assert len(out.collect()) == 6 and seen.get == counters


def test_offset_join(spark):
    codes = spark.createDataFrame([(7, [1]), (9, [2])], "idx bigint, codes array<int>")
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "idx bigint, embedding array<double>")
    got = joins.align_offset(codes, rows, 3, renumber=True).orderBy("idx").collect()
    assert [(r.source_idx, r.embedding) for r in got] == [(7, [3.0]), (9, [4.0])]
    with pytest.raises(Exception, match="no vector for row 5"):
        joins.align_offset(codes, rows, 4, renumber=True).collect()


def test_concatenation_continues_numbers(spark):
    a = spark.createDataFrame([(0, "s")], "idx bigint, f_tags string")
    b = spark.createDataFrame([(0, "v"), (1, "w")], "idx bigint, name string")
    got = joins.concat_domains(a, b, names=("station", "video")).orderBy("idx").collect()
    assert [(r.idx, r.domain, r.name) for r in got] == [(0, "station", None), (1, "video", "v"), (2, "video", "w")]


def test_alignment(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(5)], "idx bigint, id string")
    b = a.withColumn("id", F.when(F.col("idx") == 3, "z").otherwise(F.col("id")))
    assert joins.check_alignment(a, b).count() == 0
    assert [r.idx for r in joins.check_alignment(a, b, full=True).collect()] == [3]


def test_overlay_precedence(spark):
    df = parsed(spark, [{"sid": "old", "标题": "片", "n": None}])
    fields = {"sid": F.array(F.lit("<a_1>")), "extra": F.lit(1)}
    new = json.loads(df.select(records.overlay(F.col("rec"), fields)).head()[0])
    old = json.loads(df.select(records.overlay(F.col("rec"), fields, "meta")).head()[0])
    assert new == {"sid": ["<a_1>"], "标题": "片", "n": None, "extra": 1}
    assert old == {"sid": "old", "标题": "片", "n": None, "extra": 1}


def test_writer_fields(spark):
    df = parsed(
        spark,
        [{"saletype": 7, "meta": {"pay_type": "PAY", "publish_year": None}, "publish_year": 1999}, {"saletype": 7}, {}],
    )
    sale, year = records.writer_fields(F.col("rec"))
    assert [tuple(r) for r in df.orderBy("idx").select(sale, year).collect()] == [("2", "1999"), ("0", "未知"), ("0", "未知")]
    sale, year = records.writer_fields(F.col("rec"), meta_first=False)
    assert [tuple(r) for r in df.orderBy("idx").select(sale, year).collect()] == [("0", "1999"), ("0", "未知"), (None, "未知")]


def test_meta_as_text(spark):
    df = parsed(
        spark,
        [
            {"idx": 0, "id": 1, "domain": "video", "meta": {"a": 1, "id": 9, "text_format": "t", "meta_json": {"s": "1"}}, "indices": [1]},
            {"idx": "1", "meta": "kept", "text_format": "own"},
            {"idx": 2},
        ],
    )
    got = records.normalize_meta(df).orderBy("idx").collect()
    assert json.loads(got[0].meta) == {"a": 1} and json.loads(got[0].meta_json) == {"s": "1"}
    assert (got[0].text_format, got[0].indices) == ("t", [1])
    assert (got[1].meta, got[1].text_format, got[2].meta) == ("kept", "own", "{}")
    with pytest.raises(Exception, match="missing"):
        records.normalize_meta(df, strict=True).collect()


def test_layer5_repair(spark):
    df = parsed(spark, [{"saletype": 2, "publish_year": "30"}, {"meta_json": {"saletype": "9"}}, {}])
    df = df.withColumn("indices", F.array(*[F.lit(i) for i in (1, 2, 3, 4, 0)])).withColumn("tokens", F.lit(None).cast("array<string>"))
    got = records.fix_layer5(df).orderBy("idx").collect()
    assert [(r.indices[4], r.changed) for r in got] == [((2 << 6) | 30, True), (3 << 6, True), (0, False)]


def test_classifier(spark):
    rows = [
        {"json_format": '{"垂域":"电台"}', "directors": "x"},
        {"json_format": {"垂域": "video"}, "f_tags": "x"},
        {"json_format": "{bad", "cpId": 1},
        {"f_tags": "x", "actors": "y"},
        {},
    ]
    got = [r[0] for r in parsed(spark, rows).orderBy("idx").select(records.is_video(F.col("rec"))).collect()]
    assert got == [False, True, False, True, True]


def test_codes_of_records(spark):
    rows = [{"indices": [1, 2]}, {"indices": [], "tokens": ["<a_3>", "<b_4>"]}, {"sid": ["<a_5>", "<b_6>"]}, {}]
    got = [r.codes for r in records.record_codes(parsed(spark, rows)).orderBy("idx").collect()]
    assert got == [[1, 2], [3, 4], [5, 6], None]


def lines(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_line_numbers_across_splits_and_shards(spark, tmp_path):
    a = lines(tmp_path, "z.jsonl", "".join(f'{{"n": {i}}}\n' for i in range(5000)))
    b = lines(tmp_path, "a.jsonl", "".join(f'{{"n": {i}}}\n' for i in range(5000, 5100)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = jsonl.read_jsonl(spark, [a, b]).select("line", records.field(F.col("rec"), "n", as_type="bigint").alias("n"))
        assert got.count() == 5100
        assert got.where("line <> n").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_lines(spark, tmp_path):
    path = lines(tmp_path, "bad.jsonl", '{"n":1}\n\n  \n{bad\n[]\n"s"\n')
    with pytest.raises(Exception, match="malformed JSON at line 4"):
        jsonl.read_jsonl(spark, path).collect()
    dropped = jsonl.read_jsonl(spark, path, mode="drop", dense=True).orderBy("idx").collect()
    assert [(r.idx, r.line) for r in dropped] == [(0, 0), (1, 4), (2, 5)]
    stats = jsonl.scan_stats(jsonl.read_jsonl(spark, path, mode="keep")).head()
    assert (stats.total, stats.bad_json) == (4, 1)
    with pytest.raises(Exception):
        jsonl.read_lines(spark, [path, str(tmp_path / "missing")]).count()


def test_codes_file(spark, tmp_path):
    items = parsed(spark, [{"title": "片", "saletype": "PAY"}, {"title": "b", "meta": {"publish_year": 2000}}])
    codes = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "idx bigint, codes array<int>")
    out = str(tmp_path / "indices")
    sinks.write_indices(records.format_b(items, codes), out)
    got = {r["idx"]: r for r in (json.loads(v.value) for v in spark.read.text(out).collect())}
    assert got[0]["title"] == "片" and got[0]["tokens"] == ["<a_1>", "<b_2>"] and got[0]["saletype"] == "2"
    assert got[1]["indices"] == [3, 4] and got[1]["publish_year"] == "2000"


def test_matrix_file(spark, tmp_path):
    x = np.arange(60, dtype=np.float64).reshape(20, 3)
    path = str(tmp_path / "x.npy")
    np.save(path, x)
    got = vectors.read_vectors(spark, path).orderBy("idx").collect()
    assert [r.embedding for r in got] == x.tolist()
    assert vectors.read_npy(spark, path, max_rows=7).count() == 7


def test_matrix_files_in_parts(spark, tmp_path, monkeypatch):
    x = np.arange(300, dtype=np.float32).reshape(100, 3)
    rows = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "idx bigint, embedding array<float>")
    monkeypatch.setattr(vectors, "RANGE_BYTES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        paths = vectors.write_npy(rows.repartition(5), f"file://{tmp_path}/parts")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(paths) > 1 and np.array_equal(np.concatenate([np.load(p[len("file://"):]) for p in paths]), x)
    got = vectors.read_npy(spark, paths).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(100)) and [r.embedding for r in got] == x.tolist()
    assert vectors.read_npy(spark, paths, max_rows=41).count() == 41
    assert vectors.write_npy(rows.limit(0), f"{tmp_path}/none") == [] and vectors.read_npy(spark, []).count() == 0
    np.save(f"{tmp_path}/columns.npy", np.asfortranarray(x))
    np.save(f"{tmp_path}/wide.npy", np.ones((2, 4)))
    with pytest.raises(ValueError, match="row-major"):
        vectors.read_npy(spark, f"{tmp_path}/columns.npy")
    with pytest.raises(ValueError, match="expected 3 components, got 4"):
        vectors.read_npy(spark, [*paths, f"{tmp_path}/wide.npy"])


def test_placeholder_level(spark, tmp_path):
    book = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [3.0])], "level int, code int, centroid array<double>")
    path = str(tmp_path / "book")
    sinks.write_codebook(book, path, include_hardcode=True)
    got = spark.read.parquet(path).where("level = 3").orderBy("code").collect()
    assert [r.centroid for r in got] == [[0.0], [0.0]]


def test_row_assertions(spark):
    a, b = spark.range(3), spark.range(4)
    assert sampling.row_gap(a, a).head()[:] == (3, 3)
    with pytest.raises(Exception, match="row counts differ"):
        sampling.row_gap(a, b).collect()
    with pytest.raises(ValueError):
        sampling.assert_rows(a, b)


def test_sampling(spark):
    df = spark.range(20_000).withColumnRenamed("id", "idx")
    one = [r.idx for r in sampling.sample_rows(df, 500, seed=1).orderBy("idx").collect()]
    two = [r.idx for r in sampling.sample_rows(df.repartition(17), 500, seed=1).orderBy("idx").collect()]
    assert len(set(one)) == 500 and one == two
    assert one != [r.idx for r in sampling.sample_rows(df, 500, seed=2).orderBy("idx").collect()]
    mixed = df.withColumn("domain", F.when(F.col("idx") < 40, "station").otherwise("video"))
    counts = dict(sampling.balanced_sample(mixed, per_domain=100).groupBy("domain").count().collect())
    assert counts == {"station": 40, "video": 40}
    with pytest.raises(ValueError):
        sampling.balanced_sample(mixed, ("station", "radio"))


def test_vector_filters(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 2.0]), (2, [1.0, -inf]), (3, [1.0, 2.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "idx bigint, embedding array<float>")
    kept = sampling.finite_rows(df)
    assert sorted(r.idx for r in kept.collect()) == [0, 3, 4]
    assert sorted(r.idx for r in sampling.dedup_vectors(kept).collect()) == [0, 4]
    rows = [(0, [0.0, nan]), (1, [-0.0, nan]), (2, [0.0]), (3, None), (4, None), (5, []), (6, [0.0, nan])]
    same = spark.createDataFrame(rows, "idx bigint, embedding array<float>").repartition(3)
    assert sorted(r.idx for r in sampling.dedup_vectors(same).collect()) == [0, 2, 3, 5]


def test_codes_held_as_numbers_or_tokens(spark):
    rows = [{"indices": ["<a_1>", "<b_2>"], "tokens": ["<a_9>"]}, {"sid": [3, 4]}, {"indices": [], "sid": []}]
    got = [r.codes for r in records.record_codes(parsed(spark, rows)).orderBy("idx").collect()]
    assert got == [[1, 2], [3, 4], None]


def test_typed_columns(spark):
    rows = [{"name": "n", "tags": "a"}, {"tags": ["a", "b"], "meta": {"name": 5}}]
    df = parsed(spark, rows)
    got = records.item_columns(df, ["name"], ["tags"]).orderBy("idx").collect()
    assert [(r.name, r.tags) for r in got] == [("n", ["a"]), (None, ["a", "b"])]
    assert [r.name for r in records.item_columns(df, ["name"], holder="meta").orderBy("idx").collect()] == [None, "5"]


def test_dense_numbers_across_splits(spark, tmp_path):
    body = "".join(f'{{"n": {i}}}\n' if i % 5 else ("\n" if i % 2 else "{bad\n") for i in range(4000))
    shards = [lines(tmp_path, "b.jsonl", body), lines(tmp_path, "a.jsonl", body)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = jsonl.read_jsonl(spark, shards, mode="drop", dense=True)
        rows = got.select("idx", "line", records.field(F.col("rec"), "n", as_type="bigint").alias("n")).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    good = [i for i in range(4000) if i % 5]
    assert [r.idx for r in rows] == list(range(2 * len(good)))
    assert [r.n for r in rows] == good * 2
    assert [r.line for r in rows] == good + [4000 + i for i in good]
