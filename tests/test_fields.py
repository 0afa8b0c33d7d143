"""Metadata normalisation, packing and fallback chains, by hand-computed values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaloom.functions import fields as D


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_year_buckets(spark):
    years = ["2035", "2034", "1910", "1909", "2036", "0", None, " 2020 ", "x"]
    packed = column(spark, years, lambda c: F.shiftright(D.pack_hardcode(F.lit(0), D.norm_year(c)), 2))
    assert packed == [0, 1, 125, 0, 0, 0, 0, 15, 0]


def test_sale_variants(spark):
    values = ["FREE", "pay ", "2", "7", "-1", None, "vip"]
    assert column(spark, values, D.norm_sale) == [1, 2, 2, 7, 0, 0, 0]
    assert column(spark, values, lambda c: D.norm_sale(c, "writer")) == [1, 2, 2, 7, 0, 0, 0]
    assert column(spark, values, lambda c: D.norm_sale(c, "embed")) == [2, 1, 2, 7, -1, 0, 0]
    numbers = [0, 1, 2, 7, -1, None]
    assert column(spark, numbers, lambda c: D.norm_sale(c, "pack", True), "bigint") == [0, 1, 2, 7, -1, 0]
    assert column(spark, numbers, lambda c: D.norm_sale(c, "writer", True), "bigint") == [0, 1, 2, 0, 0, 0]


def test_packing_clips_the_sale_type(spark):
    assert column(spark, ["7", "-1"], lambda c: D.pack_hardcode(D.norm_sale(c, "embed"), F.lit(2035))) == [3, 0]
    assert column(spark, [3], lambda c: D.pack_hardcode(c, F.lit(1910)), "int") == [503]


def test_legacy_layouts(spark):
    assert column(spark, [2], lambda c: D.pack_hardcode(c, F.lit(5), "legacy_a"), "int") == [22]
    assert column(spark, [3], lambda c: D.pack_hardcode(c, F.lit(5), "legacy_a"), "int") == [22]
    assert column(spark, [3], lambda c: D.pack_hardcode(c, F.lit(2020), "legacy_b"), "int") == [255]


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(1910, 2035)), min_size=1, max_size=40))
def test_unpack_inverts_pack(spark, rows):
    df = spark.createDataFrame(rows, "s int, y int")
    back = D.unpack_hardcode(D.pack_hardcode(F.col("s"), F.col("y")))
    got = df.select("s", "y", back["sale"].alias("bs"), back["year"].alias("by")).collect()
    assert all(r.s == r.bs and r.y == r.by for r in got)


RECORDS = [
    '{"saletype":null,"meta":{"saletype":1}}',
    '{"meta":{"saletype":1}}',
    '{"saletype":"","meta":{"saletype":"PAY"}}',
    '{"saletype":1.9}',
    '{"saletype":true}',
    '{"pay_type":"FREE","meta":"text"}',
    '{"saletype":5}',
]


def test_fallback_rules(spark):
    found = {
        rule: column(
            spark,
            RECORDS,
            lambda c, rule=rule: F.try_variant_get(D.first_present(F.parse_json(c), D.SALE_KEYS, rule), "$", "string"),
        )
        for rule in ("presence", "nonnull", "truthy")
    }
    assert found["presence"] == [None, "1", "", "1.9", "true", "FREE", "5"]
    assert found["nonnull"] == ["1", "1", "", "1.9", "true", "FREE", "5"]
    assert found["truthy"] == ["1", "1", "PAY", "1.9", "true", "FREE", "5"]


def test_sale_of_variant_knows_strings_from_numbers(spark):
    def code(variant):
        return lambda c: D.sale_of_variant(D.first_present(F.parse_json(c), D.SALE_KEYS), variant)

    assert column(spark, RECORDS, code("pack")) == [0, 1, 0, 1, 1, 1, 5]
    assert column(spark, RECORDS, code("writer")) == [0, 1, 0, 1, 1, 1, 0]


def test_domains(spark):
    rows = [
        '{"domain":"视频"}',
        '{"domain":"radio"}',
        '{"meta":{"domain":"电台"}}',
        '{"json_format":"{\\"垂域\\":\\"视频\\"}"}',
        '{"json_format":"{bad"}',
        "{}",
    ]
    got = column(spark, rows, lambda c: D.domain_of(F.parse_json(c)))
    assert got == ["video", "radio", "station", "video", "__missing__", "__missing__"]


def test_years_ago(spark):
    assert column(spark, ["2020", "2030", None, "x"], D.years_ago) == [6, 0, 0, 0]


def test_keys_that_cannot_be_addressed():
    with pytest.raises(ValueError):
        D.json_path('a"b')
