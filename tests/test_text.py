"""Text columns by hand-computed values."""

import pytest
from pyspark.sql import functions as F

from quantaloom.functions import text as X


def one(spark, fn, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(fn(*[F.col(n) for n in names])).head()[0]


@pytest.mark.parametrize(
    "value,expected",
    [("  a\t", "a"), ("　标题　", "标题"), ("  ", None), (None, None), ("a b", "a b")],
)
def test_to_text(spark, value, expected):
    assert one(spark, X.to_text, value) == expected


def test_list_to_text(spark):
    df = spark.createDataFrame([(["a ", "", None, " b"],), ([" "],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(X.list_to_text(F.col("v"))).collect()] == ["a、b", None, None, None]


def test_tags_keep_the_first_spelling(spark):
    assert one(spark, X.merge_tags, "Ab、ab;C") == "Ab、C"
    assert one(spark, X.merge_tags, " , ；") is None
    assert one(spark, X.merge_tags, None) is None
    assert one(spark, lambda a, b: X.merge_tags(a, b, sep=","), "x,Y", "y, z") == "x、Y、z"


def test_titles(spark):
    assert one(spark, X.resolve_title, "X Lv", "xlv full") == "xlv full"
    assert one(spark, X.resolve_title, "A", "B") == "A、B"
    assert one(spark, X.resolve_title, "A-b", "a b") == "A-b"
    assert one(spark, X.resolve_title, " ", "B ") == "B"
    assert one(spark, X.resolve_title, None, " ") is None
    assert one(spark, X.resolve_title, "!", "?") == "!、?"
    assert one(spark, X.resolve_title, "abc", "b", "abcd") == "abcd"


def test_labels(spark):
    assert [one(spark, X.saletype_label, v) for v in ("0", " 1", "2", "3", "x", None)] == ["免费", "付费", "付费", None, None, None]
    assert [one(spark, X.paytype_label, v) for v in ("pay", " FREE ", "1", None)] == ["付费", "免费", None, None]


def test_top_artists(spark):
    assert one(spark, X.top_artists, "a、b、c、d") == "a、b、c"
    assert one(spark, X.top_artists, " ") is None


def test_video_text(spark):
    df = spark.createDataFrame(
        [("Film", None, ["d1", "d2"], "", ["x"], 2001, "pay"), (None, None, None, None, None, None, None)],
        "meta_main_name string, llm_tag string, directors array<string>, main_actors string, actors array<string>, publish_year int, pay_type string",
    )
    got = [r[0] for r in df.select(X.video_text(df)).collect()]
    assert got == ["标题：“Film”，付费状态：“付费”，出版时间：“2001”，导演：“d1、d2”，演员：“x”。", ""]


def test_station_text_maps_providers(spark):
    df = spark.createDataFrame([("c1", "n", "0"), ("c2", None, None)], "cp string, name string, saletype string")
    got = [r[0] for r in df.select(X.station_text(df, {"c1": "One"})).collect()]
    assert got == ["资源商：“One”，原始标题：“n”，付费状态：“免费”。", "资源商：“c2”。"]


def test_extracting_fields(spark):
    text = "主标题：“T，U”，副标题：“S”，标签：“a、b”。"
    assert one(spark, lambda c: X.extract_field(c, "tags"), text) == "a、b"
    assert one(spark, lambda c: X.extract_field(c, "subname"), text) == "S"
    assert one(spark, lambda c: X.extract_field(c, "tags", literal=True), text) == ""
    assert one(spark, lambda c: X.extract_field(c, "tags"), "描述：“x”") is None
    assert one(spark, lambda c: X.extract_field(c, "main_title"), text) == "主标题：“T"
    assert one(spark, lambda c: X.extract_field(c, "tags"), "标签：a、b，描述") == "a、b"


def test_multi_values(spark):
    assert one(spark, X.split_values, " a;b， |c；") == ["a", "b，", "c"]
    assert one(spark, X.split_values, None) == []
    assert one(spark, X.scalar_or_missing, "") == "(缺失)"


def test_domain_and_rebuild(spark):
    df = spark.createDataFrame(
        [("电台", None, "n", "keep"), (None, '{"垂域":"电台"}', "n", "keep"), ("x", None, "n", "keep"), ("", "{bad", "n", "keep")],
        "domain string, json_format string, name string, other string",
    )
    out = X.rebuild_text_format(df).collect()
    assert [r.text_format for r in out] == ["原始标题：“n”。", "原始标题：“n”。", "", ""]
    assert all(r.other == "keep" for r in out)


def test_prepared_texts(spark):
    df = spark.createDataFrame(
        [("", "m", "r", "副标题：“s”", 5)], "name string, mainname string, rawname string, text_format string, json_format int"
    )
    row = X.prepare_texts(df, domain="station").head()
    assert (row.text_name, row.text_subname, row.text_tags, row.text_json_format) == ("m", "s", None, None)
