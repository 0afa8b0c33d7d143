"""Registry of verification queries, and the tables they derive from the given ones.

A derived table is stated once as SQL expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions.fields import pack_hardcode
from quantaloom.session import shared_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder next to the session's checkpoints."""
    return f"{shared_root(spark)}/quantaloom-{uuid.uuid4().hex}"


def picked(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def cte(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {source}"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


# -- a code matrix at scale, without row identity -------------------------------------------------

LINE_CODES = {
    "c1": "cast(l_suppkey % 16 AS int)",
    "c2": "cast(l_partkey % 32 AS int)",
    "c3": "cast(l_linenumber AS int)",
    "c4": "cast(cast(l_quantity AS int) % 8 AS int)",
    "sale": "CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END",
    "year": "year(l_shipdate)",
    "domain": "l_returnflag",
}
PACK_SQL = "(((CASE WHEN 2035 - year BETWEEN 0 AND 125 THEN 2035 - year ELSE 0 END)::INT & 127) << 2) | sale"
LINE_CODES_SQL = f"SELECT c1, c2, c3, c4, ({PACK_SQL})::INT AS c5, domain FROM ({cte(LINE_CODES, 'lineitem')})"


def line_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = picked(table(spark, sf_dir, "lineitem"), LINE_CODES)
    return df.select("c1", "c2", "c3", "c4", pack_hardcode(F.col("sale"), F.col("year")).alias("c5"), "domain")


# -- codes and text fields of items with a dense row number ----------------------------------------

ORDER_CODES = {
    "idx": "o_orderkey",
    "c1": "cast(o_custkey % 8 AS int)",
    "c2": "cast(month(o_orderdate) AS int)",
    "c3": "cast(day(o_orderdate) % 8 AS int)",
    "c4": "cast(o_custkey % 5 AS int)",
    "domain": "o_orderstatus",
    "pay_type": "CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN ' ' ELSE o_orderstatus END",
    "genre_types": "CASE WHEN o_custkey % 9 = 0 THEN '' ELSE replace(o_orderpriority, '-', ';') || '；' || o_orderstatus END",
    "title": "o_orderpriority || '|' || cast(o_custkey AS string)",
}
ORDER_CODES_SQL = cte(ORDER_CODES, "orders")


def order_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(table(spark, sf_dir, "orders"), ORDER_CODES)


# -- catalogue records with text fields ----------------------------------------------------------

CATALOGUE = {
    "idx": "p_partkey",
    "id": "p_partkey",
    "meta_main_name": "p_name",
    "meta_origin_name": "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' ' || p_type "
    "WHEN 2 THEN upper(p_name) WHEN 3 THEN '  ' || p_brand || ' ' ELSE '' END",
    "name": "p_brand",
    "rawname": "p_type",
    "mainname": "CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END",
    "subname": "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END",
    "directors": "p_brand || '、' || p_type || '、' || p_name || '、x'",
    "main_actors": "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name || '、' || p_type END",
    "actors": "p_type",
    "characters": "CASE WHEN p_size % 4 = 0 THEN ' ' ELSE ' ' || p_name END",
    "llm_tag": "replace(p_name, ' ', '、') || ',' || p_type || ';；' || lower(p_type) || ', ' || upper(p_name)",
    "rec_tag_desc": "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_type || ' ' || p_name END",
    "patchwall_ip_name": "CASE WHEN p_size % 7 = 0 THEN p_brand END",
    "publish_year": "1990 + p_size",
    "pay_type": "CASE p_size % 4 WHEN 0 THEN 'PAY' WHEN 1 THEN ' free ' WHEN 2 THEN '1' ELSE NULL END",
    "saletype": "CASE p_size % 6 WHEN 0 THEN '0' WHEN 1 THEN ' 1' WHEN 2 THEN '2' WHEN 3 THEN 'FREE' WHEN 4 THEN '7' ELSE NULL END",
    "domain": "CASE p_size % 3 WHEN 0 THEN 'station' WHEN 1 THEN '视频' ELSE NULL END",
    "json_format": """CASE p_size % 4 WHEN 0 THEN '{"垂域":"电台"}' WHEN 1 THEN '{"domain":"station"}' """
    """WHEN 2 THEN '{bad' ELSE NULL END""",
    "cp": "p_brand",
    "desc": "p_type || '，' || p_name",
    "br_name": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END",
    "f_tags": "replace(p_name, ' ', ',')",
    "s_tags": "upper(p_name) || ', ' || p_type",
    "k_tags": "CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type || ',,' || p_brand END",
    "c_tags": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END",
    "text_format": "CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN '描述：' || p_name ELSE "
    "'主标题：“' || p_name || '”，副标题：“' || p_type || '”，标签：“' || replace(p_name, ' ', '、') || '”。' END",
    "genre_types": "replace(p_name, ' ', ';') || '；' || p_type",
}
CATALOGUE_SQL = cte(CATALOGUE, "part")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(table(spark, sf_dir, "part"), CATALOGUE)


# -- JSON records: nested, aliased, null, blank and malformed -------------------------------------

_ID = "cast(event_id AS string)"
_SALE = """CASE event_type WHEN 'click' THEN '"FREE"' WHEN 'view' THEN '" pay "' WHEN 'error' THEN 'null' ELSE '2' END"""
_YEAR = "cast(1985 + event_id % 60 AS string)"
RECORDS = {
    "idx": "event_id",
    "raw": "CASE event_id % 8 "
    f"""WHEN 0 THEN '{{"idx":' || {_ID} || ',"id":' || {_ID} || ',"saletype":' || {_SALE} || ',"publish_year":' || {_YEAR} || ',"meta":{{"saletype":1,"publish_year":"x"}}}}' """
    f"""WHEN 1 THEN '{{"idx":"' || {_ID} || '","id":' || {_ID} || ',"meta":{{"idx":1,"pay_type":' || {_SALE} || ',"publish_year":" ' || {_YEAR} || ' ","text_format":"t' || {_ID} || '","meta_json":{{"saletype":"1"}}}},"indices":[1,2,3,4,5]}}' """
    f"""WHEN 2 THEN '{{"id":' || {_ID} || ',"pay_type":"pay ","publish_year":" ' || {_YEAR} || '","domain":"station","cpId":"c"}}' """
    f"""WHEN 3 THEN '{{"id":' || {_ID} || ',"publish_year":null,"meta":{{"publish_year":' || {_YEAR} || ',"sale_type":"7"}},"video_type":"' || event_type || '"}}' """
    f"""WHEN 4 THEN '{{bad' || {_ID} """
    """WHEN 5 THEN '  ' """
    f"""WHEN 6 THEN '{{"id":' || {_ID} || ',"domain":"视频","json_format":"{{\\"垂域\\":\\"电台\\"}}","meta_json":{{"saletype":"0"}},"meta":"text","f_tags":"a"}}' """
    f"""ELSE '{{"id":' || {_ID} || ',"meta":{{"domain":"other","saletype":""}},"paytype":' || {_SALE} || ',"f_tags":"' || event_type || '"}}' END""",
}
RECORDS_SQL = cte(RECORDS, "events")
# one row per parsed record, with its JSON
PARSED_SQL = f"SELECT idx, raw, try_cast(raw AS JSON) AS j FROM ({RECORDS_SQL}) WHERE trim(raw) <> '' AND json_valid(raw)"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark reads a backslash in a literal as an escape, DuckDB does not
    columns = {n: e.replace("\\", "\\\\") for n, e in RECORDS.items()}
    return picked(table(spark, sf_dir, "events"), columns)


def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_records(spark, sf_dir).withColumn("rec", F.try_parse_json("raw"))
    return rows.where(F.col("rec").isNotNull())


# -- vectors and a two-level codebook of means -----------------------------------------------------

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", "label")


def mean_codebook(df: DataFrame, code: str, level: int, vector: str = "embedding") -> DataFrame:
    """One centroid per value of ``code``: the mean of its rows."""
    from quantaloom.operators.sums import dimension, vector_sum

    sums = vector_sum(df, [code], vector, dimension(df, vector), [("n", F.count("*"))])
    mean = F.zip_with("vec_sum", F.array_repeat(F.col("n").cast("double"), F.size("vec_sum")), lambda s, n: s / n)
    return sums.select(F.lit(level).alias("level"), F.col(code).cast("int").alias("code"), mean.alias("centroid"))


def two_level_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 1: mean vector per label. Level 2: mean residual per row number modulo 16."""
    from quantaloom.operators.assign import encode
    from quantaloom.session import cut

    rows = vectors(spark, sf_dir)
    first = cut(mean_codebook(rows, "label", 1))
    left = encode(rows, first, residual=True).withColumn("slot", F.col("idx") % 16)
    return cut(first.unionByName(mean_codebook(left, "slot", 2, "residual")))


def minus_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


VECTOR_CTES = f"""
v AS (SELECT vec_id AS idx, label, embedding::DOUBLE[] AS x FROM embeddings),
ve AS (SELECT label, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM v),
cb1 AS (SELECT label AS code, list(m ORDER BY pos) AS centroid
        FROM (SELECT label, pos, avg(val) AS m FROM ve GROUP BY label, pos) GROUP BY label),
n1 AS (SELECT idx, arg_min(code, d) AS code, min(d) AS d
       FROM (SELECT idx, code, list_distance(x, centroid) AS d FROM v, cb1) GROUP BY idx),
r1 AS (SELECT v.idx, v.label, v.x, n1.code AS c1, {minus_sql('v.x', 'cb1.centroid')} AS r
       FROM v JOIN n1 ON v.idx = n1.idx JOIN cb1 ON n1.code = cb1.code),
re AS (SELECT idx % 16 AS slot, unnest(r) AS val, generate_subscripts(r, 1) AS pos FROM r1),
cb2 AS (SELECT slot AS code, list(m ORDER BY pos) AS centroid
        FROM (SELECT slot, pos, avg(val) AS m FROM re GROUP BY slot, pos) GROUP BY slot),
n2 AS (SELECT idx, arg_min(code, d) AS code, min(d) AS d
       FROM (SELECT r1.idx, cb2.code, list_distance(r, centroid) AS d FROM r1, cb2) GROUP BY idx),
coded AS (SELECT r1.idx, r1.label, r1.x, r1.c1::INT AS c1, n2.code::INT AS c2, n2.d * n2.d AS err,
                 {minus_sql('r1.r', 'cb2.centroid')} AS r2
          FROM r1 JOIN n2 ON r1.idx = n2.idx JOIN cb2 ON n2.code = cb2.code)
"""


# two sums over all components of a vector, weighted by place and by its square: linear, so sums and means keep them
def whole_sql(x: str, around: str = "{}") -> str:
    sums = [around.format(f"list_sum(list_transform({x}, lambda e, i: e * {w}))") for w in ("i", "i * i")]
    return f"round({sums[0]}, 4) AS w1, round({sums[1]}, 4) AS w2"


def whole(vector: str) -> list[Column]:
    def total(power: int) -> Column:
        weighted = F.transform(vector, lambda e, i: e.cast("double") * F.pow(i + 1, F.lit(power)))
        return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, e: a + e), 4)

    return [total(1).alias("w1"), total(2).alias("w2")]


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
