"""Queries over JSON records, their fallback rules and layouts, and over row-numbered joins."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quantaloom.functions import fields as D
from quantaloom.functions import codes as K
from quantaloom.operators import content, joins, ranking, records
from quantaloom.plans.base import (
    ORDER_CODES_SQL,
    PARSED_SQL,
    RECORDS_SQL,
    order_codes,
    parsed_records,
    query,
    raw_records,
    rounded,
    scratch,
    table,
    whole,
    whole_sql,
)
from quantaloom.sources import jsonl, sinks
from quantaloom.sources.vectors import read_npy, read_vectors, write_npy


def t_string(*keys: str) -> str:
    path = "$" + "".join(f'."{k}"' for k in keys)
    return f"json_extract_string(j, '{path}')"


def t_type(*keys: str) -> str:
    path = "$" + "".join(f'."{k}"' for k in keys)
    return f"json_type(j, '{path}')"


def t_exists(*keys: str) -> str:
    path = "$" + "".join(f'."{k}"' for k in keys)
    return f"json_exists(j, '{path}')"


def t_presence(*paths: tuple[str, ...]) -> str:
    """Value of the first existing key, null when it holds null."""
    arms = " ".join(f"WHEN {t_exists(*p)} THEN {t_string(*p)}" for p in paths)
    return f"(CASE {arms} END)"


def t_presence_type(*paths: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {t_exists(*p)} THEN {t_type(*p)}" for p in paths)
    return f"(CASE {arms} END)"


def nested(keys: list[str], holders: tuple[str, ...] = ("", "meta")) -> list[tuple[str, ...]]:
    return [(h, k) if h else (k,) for h in holders for k in keys]


SALE_PATHS = nested(D.SALE_KEYS)


def t_sale_number(value: str, kind: str, writer: bool = False) -> str:
    text = f"""CASE upper(trim({value})) WHEN 'FREE' THEN 1 WHEN 'PAY' THEN 2 ELSE
coalesce(CASE WHEN regexp_matches(trim({value}), '^[0-9]+$') THEN try_cast(trim({value}) AS BIGINT) END, 0) END"""
    number = f"coalesce(trunc(try_cast({value} AS DOUBLE))::BIGINT, 0)"
    if writer:
        number = f"(CASE WHEN {number} IN (0, 1, 2) THEN {number} ELSE 0 END)"
    return f"(CASE WHEN {value} IS NULL THEN 0 WHEN {kind} = 'VARCHAR' THEN {text} ELSE {number} END)"


def t_year(value: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches(trim({value}), '^[+-]?[0-9]+$') THEN try_cast(trim({value}) AS BIGINT) END, 0)"


@query(
    "first_present_rules",
    f"""SELECT idx, {t_presence(*SALE_PATHS)} AS presence,
coalesce({', '.join(t_string(*p) for p in SALE_PATHS)}) AS nonnull,
coalesce({', '.join(f"nullif({t_string(*p)}, '')" for p in SALE_PATHS)}) AS truthy FROM ({PARSED_SQL})""",
)
def first_present_rules(spark, sf_dir):
    rec = F.col("rec")
    found = {r: D.first_present(rec, D.SALE_KEYS, r) for r in ("presence", "nonnull", "truthy")}
    return parsed_records(spark, sf_dir).select(
        "idx", *[F.try_variant_get(v, "$", "string").alias(n) for n, v in found.items()]
    )


@query(
    "nested_paths",
    f"""SELECT idx, {t_string('meta', 'publish_year')} AS meta_year, {t_string('saletype')} AS sale,
{t_exists('publish_year')} AS has_year FROM ({PARSED_SQL})""",
)
def nested_paths(spark, sf_dir):
    rec = F.col("rec")
    return parsed_records(spark, sf_dir).select(
        "idx",
        D.get_path(rec, "meta.publish_year").alias("meta_year"),
        D.get_path(rec, "saletype").alias("sale"),
        D.has_key(rec, "publish_year").alias("has_year"),
    )


SALE_VALUE, SALE_KIND = t_presence(*SALE_PATHS), t_presence_type(*SALE_PATHS)
YEAR_VALUE = t_presence(*nested(["publish_year"]))


@query(
    "record_packed_code",
    f"""SELECT idx, ((((CASE WHEN 2035 - y BETWEEN 0 AND 125 THEN 2035 - y ELSE 0 END)::INT & 127) << 2) | least(greatest(s, 0), 3)::INT)::INT AS packed
FROM (SELECT idx, {t_sale_number(SALE_VALUE, SALE_KIND)} AS s, {t_year(YEAR_VALUE)} AS y FROM ({PARSED_SQL}))""",
)
def record_packed_code(spark, sf_dir):
    return parsed_records(spark, sf_dir).select("idx", D.packed_code(F.col("rec")).alias("packed"))


@query(
    "record_domain",
    f"""WITH r AS (SELECT idx, j, CASE WHEN json_valid({t_string('json_format')}) THEN {t_string('json_format')}::JSON END AS f FROM ({PARSED_SQL})),
d AS (SELECT idx, coalesce({t_string('domain')}, {t_string('meta', 'domain')}, nullif(json_extract_string(f, '$.domain'), ''),
json_extract_string(f, '$."垂域"')) AS d FROM r)
SELECT idx, CASE WHEN d IN ('视频', 'video') THEN 'video' WHEN d IN ('电台', 'station') THEN 'station' ELSE coalesce(d, '__missing__') END AS domain FROM d""",
)
def record_domain(spark, sf_dir):
    return parsed_records(spark, sf_dir).select("idx", D.domain_of(F.col("rec")).alias("domain"))


@query(
    "is_video",
    f"""WITH r AS (SELECT idx, j, CASE WHEN json_valid({t_string('json_format')}) THEN {t_string('json_format')}::JSON END AS f,
json_keys(j) AS keys FROM ({PARSED_SQL}))
SELECT idx, CASE WHEN json_extract_string(f, '$."垂域"') IS NOT NULL THEN json_extract_string(f, '$."垂域"') IN ('视频', 'video')
WHEN list_has_any(keys, {records.VIDEO_KEYS}) THEN true WHEN list_has_any(keys, {records.STATION_KEYS}) THEN false ELSE true END AS video FROM r""",
)
def is_video(spark, sf_dir):
    return parsed_records(spark, sf_dir).select("idx", records.is_video(F.col("rec")).alias("video"))


@query(
    "video_vectors",
    f"""WITH r AS (SELECT idx, j, CASE WHEN json_valid({t_string('json_format')}) THEN {t_string('json_format')}::JSON END AS f,
json_keys(j) AS keys FROM ({PARSED_SQL})),
k AS (SELECT idx FROM r WHERE CASE WHEN json_extract_string(f, '$."垂域"') IS NOT NULL THEN json_extract_string(f, '$."垂域"') IN ('视频', 'video')
WHEN list_has_any(keys, {records.VIDEO_KEYS}) THEN true WHEN list_has_any(keys, {records.STATION_KEYS}) THEN false ELSE true END)
SELECT vec_id AS idx, label FROM embeddings SEMI JOIN k ON vec_id = k.idx""",
)
def video_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label")
    return joins.keep_in(rows, parsed_records(spark, sf_dir).where(records.is_video(F.col("rec"))))


WRITER_KEYS = records.WRITER_SALE_KEYS


def _two_step(keys: list[str]) -> tuple[str, str]:
    meta, top = nested(keys, ("meta",)), nested(keys, ("",))
    value = f"coalesce({t_presence(*meta)}, {t_presence(*top)})"
    kind = f"(CASE WHEN {t_presence(*meta)} IS NOT NULL THEN {t_presence_type(*meta)} ELSE {t_presence_type(*top)} END)"
    return value, kind


W_VALUE, W_KIND = _two_step(WRITER_KEYS)
WY_VALUE, _ = _two_step(["publish_year"])
CODE_COLUMNS = "cast(o_custkey % 8 AS int) AS c1, cast(month(o_orderdate) AS int) AS c2"


@query(
    "format_b_records",
    f"""WITH codes AS ({ORDER_CODES_SQL}), r AS (SELECT idx, ({t_sale_number(W_VALUE, W_KIND, True)})::VARCHAR AS saletype,
coalesce({WY_VALUE}, '未知') AS publish_year FROM ({PARSED_SQL}))
SELECT idx, c1 || ',' || c2 || ',' || c3 || ',' || c4 AS indices, '<a_' || c1 || '><b_' || c2 || '><c_' || c3 || '><d_' || c4 || '>' AS sid,
saletype, publish_year FROM r JOIN codes USING (idx)""",
)
def format_b_records(spark, sf_dir):
    codes = order_codes(spark, sf_dir).select("idx", F.array("c1", "c2", "c3", "c4").alias("codes"))
    out = records.format_b(parsed_records(spark, sf_dir), codes)
    return out.select(
        "idx",
        F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"),
        F.array_join("sid", "").alias("sid"),
        "saletype",
        "publish_year",
    )


T_VALUE, T_KIND = t_presence(*nested(["saletype", "sale_type", "pay_type", "paytype"])), t_presence_type(*SALE_PATHS)


@query(
    "top_first_writer_fields",
    f"""SELECT idx, CASE WHEN {T_VALUE} IS NOT NULL THEN ({t_sale_number(T_VALUE, T_KIND, True)})::VARCHAR END AS saletype,
coalesce({YEAR_VALUE}, '未知') AS publish_year FROM ({PARSED_SQL})""",
)
def top_first_writer_fields(spark, sf_dir):
    sale, year = records.writer_fields(F.col("rec"), meta_first=False)
    return parsed_records(spark, sf_dir).select("idx", sale.alias("saletype"), year.alias("publish_year"))


@query(
    "overlay_precedence",
    f"""SELECT idx, '9' AS new_sale, CASE WHEN {t_exists('saletype')} THEN {t_string('saletype')} ELSE '9' END AS meta_sale,
{t_string('id')} AS id FROM ({PARSED_SQL})""",
)
def overlay_precedence(spark, sf_dir):
    fields = {"saletype": F.lit("9")}
    rec = F.col("rec")
    new = F.parse_json(records.overlay(rec, fields))
    meta = F.parse_json(records.overlay(rec, fields, "meta"))
    return parsed_records(spark, sf_dir).select(
        "idx",
        D.get_path(new, "saletype").alias("new_sale"),
        D.get_path(meta, "saletype").alias("meta_sale"),
        D.get_path(new, "id").alias("id"),
    )


@query(
    "meta_json_overlay",
    f"""SELECT idx, coalesce({t_string('meta_json', 'saletype')}, {t_string('saletype')}, {t_string('meta', 'saletype')}, '0') AS saletype,
coalesce({t_string('meta_json', 'publish_year')}, {t_string('publish_year')}, {t_string('meta', 'publish_year')}, '未知') AS publish_year FROM ({PARSED_SQL})""",
)
def meta_json_overlay(spark, sf_dir):
    merged = F.parse_json(records.meta_json_fields(F.col("rec")))
    return parsed_records(spark, sf_dir).select(
        "idx", *[D.get_path(merged, k).alias(k) for k in ("saletype", "publish_year")]
    )


@query(
    "normalize_meta",
    f"""SELECT idx AS row_id, {t_string('idx')} AS idx, {t_string('id')} AS id, {t_string('domain')} AS domain,
CASE {t_type('meta')} WHEN 'VARCHAR' THEN {t_string('meta')} WHEN 'OBJECT' THEN
array_to_string(list_sort(list_filter(json_keys(j, '$.meta'), lambda k: NOT list_contains({records.WRAPPER_KEYS}, k))), ',') ELSE '' END AS meta_keys,
CASE WHEN {t_type('meta')} = 'OBJECT' THEN {t_string('meta', 'pay_type')} END AS meta_pay,
coalesce({t_string('meta_json', 'saletype')}, CASE WHEN {t_type('meta')} = 'OBJECT' THEN {t_string('meta', 'meta_json', 'saletype')} END) AS meta_json_sale,
coalesce({t_string('text_format')}, CASE WHEN {t_type('meta')} = 'OBJECT' THEN {t_string('meta', 'text_format')} END) AS text_format,
array_to_string(json_extract(j, '$.indices')::INT[], ',') AS indices FROM ({PARSED_SQL})""",
)
def normalize_meta(spark, sf_dir):
    rows = parsed_records(spark, sf_dir)
    # the row number travels as a further field so that rows can be told apart
    out = records.normalize_meta(rows.withColumn("rec", F.parse_json(records.overlay(F.col("rec"), {"sid": F.array(F.col("idx").cast("string"))}))))
    meta = F.try_parse_json("meta")
    keys = F.array_join(F.array_sort(F.map_keys(F.try_variant_get(meta, "$", "map<string,variant>"))), ",")
    return out.select(
        F.get("sid", F.lit(0)).cast("bigint").alias("row_id"),
        "idx",
        "id",
        "domain",
        F.when(meta.isNull(), F.col("meta")).otherwise(keys).alias("meta_keys"),
        D.get_path(meta, "pay_type").alias("meta_pay"),
        D.get_path(F.try_parse_json("meta_json"), "saletype").alias("meta_json_sale"),
        "text_format",
        F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"),
    )


@query(
    "five_level_records",
    f"""WITH codes AS ({ORDER_CODES_SQL}), r AS (SELECT (row_number() OVER (ORDER BY idx) - 1) AS n, idx AS item, raw, j FROM ({PARSED_SQL}))
SELECT n::VARCHAR AS idx, {t_string('id')} AS id, 'video' AS domain, length(raw)::INT AS meta_length,
CASE WHEN c1 % 2 = 0 THEN '1999' ELSE '未知' END AS publish_year, c1 || ',' || c2 || ',' || c3 || ',' || c4 || ',0' AS sid
FROM r JOIN codes ON codes.idx = r.n""",
)
def five_level_records(spark, sf_dir):
    items = ranking.with_row_idx(parsed_records(spark, sf_dir).select(F.col("idx").alias("item"), "raw"), [F.col("item")])
    items = items.select("idx", F.lit("video").alias("domain"), "raw", F.parse_json("raw").alias("rec"))
    known = F.create_map(F.lit("publish_year"), F.lit("1999"))
    unknown = F.create_map(F.lit("saletype"), F.lit("0"))
    codes = order_codes(spark, sf_dir).select(
        "idx",
        F.array("c1", "c2", "c3", "c4", F.lit(0)).alias("indices"),
        F.when(F.col("c1") % 2 == 0, known).otherwise(unknown).alias("meta_json"),
    )
    ref = joins.keep_in(codes, items)
    out = records.build_records(items, ref)
    return out.select(
        "idx",
        "id",
        "domain",
        F.length("meta").alias("meta_length"),
        F.col("meta_json")["publish_year"].alias("publish_year"),
        F.array_join(F.col("sid").cast("array<string>"), ",").alias("sid"),
    )


B_SALE = t_presence(*nested(["saletype"], ("", "meta", "meta_json")))
B_YEAR = t_presence(*nested(["publish_year"], ("", "meta", "meta_json")))


@query(
    "fix_layer5",
    f"""WITH codes AS ({ORDER_CODES_SQL}), r AS (SELECT idx, ((least(greatest({t_year(B_SALE)}, 0), 3)::INT << 6) |
least(greatest({t_year(B_YEAR)}, 0), 63)::INT)::INT AS e FROM ({PARSED_SQL}))
SELECT idx, c1 || ',' || c2 || ',' || c3 || ',' || c4 || ',' || e AS indices, '<e_' || e || '>' AS last_token, e <> 63 AS changed
FROM r JOIN codes USING (idx)""",
)
def fix_layer5(spark, sf_dir):
    five = F.array("c1", "c2", "c3", "c4", F.lit(63))
    codes = order_codes(spark, sf_dir).select("idx", five.alias("indices"), K.format_sid(five).alias("tokens"))
    out = records.fix_layer5(parsed_records(spark, sf_dir).join(codes, "idx"))
    return out.select(
        "idx",
        F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"),
        F.get("tokens", F.lit(4)).alias("last_token"),
        "changed",
    )


@query(
    "indices_to_sid",
    f"""WITH codes AS ({ORDER_CODES_SQL})
SELECT r.idx, c1 || ',' || c2 AS sid, CASE WHEN {t_type('meta', 'meta_json')} IS NOT NULL THEN {t_string('meta', 'meta_json', 'saletype')} ELSE NULL END AS sale
FROM ({PARSED_SQL}) r JOIN codes ON codes.idx = r.idx""",
)
def indices_to_sid(spark, sf_dir):
    codes = order_codes(spark, sf_dir).select("idx", F.array("c1", "c2").alias("indices"))
    rows = parsed_records(spark, sf_dir).join(codes, "idx")
    rows = rows.select(F.col("idx").cast("string").alias("idx"), "indices", F.lit(None).cast("string").alias("meta_json"), "rec")
    out = records.indices_to_sid(rows)
    return out.select(
        "idx",
        F.array_join(F.col("sid").cast("array<string>"), ",").alias("sid"),
        D.get_path(F.try_parse_json("meta_json"), "saletype").alias("sale"),
    )


@query(
    "record_codes",
    f"""SELECT idx, array_to_string(json_extract(j, '$.indices')::INT[], ',') AS codes FROM ({PARSED_SQL})""",
)
def record_codes(spark, sf_dir):
    out = records.record_codes(parsed_records(spark, sf_dir))
    return out.select("idx", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


# codes as numbers or as tokens, in any of the three fields; an empty field is passed over
_FORMS = {
    0: """'{"indices":[' || c1 || ',' || c2 || '],"tokens":["<a_9>"]}'""",
    1: """'{"tokens":["<a_' || c1 || '>","<b_' || c2 || '>"],"sid":[9]}'""",
    2: """'{"indices":[],"sid":["<a_' || c1 || '>","<b_' || c2 || '>"]}'""",
    3: """'{"tokens":[],"sid":[' || c1 || ',' || c2 || ']}'""",
    4: """'{"indices":["<a_' || c1 || '>","<b_' || c2 || '>"],"sid":[9,9]}'""",
    5: """'{"indices":[],"tokens":[],"sid":[]}'""",
}
CODE_FORMS = "CASE idx % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in _FORMS.items()) + " END"


@query(
    "record_codes_of_all_forms",
    f"""SELECT idx, CASE WHEN idx % 6 <> 5 THEN c1 || ',' || c2 END AS codes FROM ({ORDER_CODES_SQL})""",
)
def record_codes_of_all_forms(spark, sf_dir):
    rows = order_codes(spark, sf_dir).select("idx", F.expr(CODE_FORMS).alias("raw"))
    out = records.record_codes(rows.select("idx", F.parse_json("raw").alias("rec")))
    return out.select("idx", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(
    "code_validity",
    f"""SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE {t_string('domain')} IS NULL)::BIGINT AS missing_domain,
count(*) FILTER (WHERE {t_string('domain')} IN ('station', '视频') AND coalesce(json_array_length(j, '$.indices'), 0) < 3)::BIGINT AS missing_indices
FROM ({PARSED_SQL})""",
)
def code_validity(spark, sf_dir):
    rec = F.col("rec")
    rows = parsed_records(spark, sf_dir).select(
        "idx",
        records.field(rec, "domain").alias("domain"),
        records.field(rec, "indices", as_type="array<int>").alias("indices"),
    )
    return records.code_validity(rows, 3, ["station", "视频"])[1]


@query("domain_rows", f"WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, domain FROM codes WHERE domain = 'F'")
def domain_rows(spark, sf_dir):
    return records.filter_domain(order_codes(spark, sf_dir), "F").select("idx", "domain")


# -- distributions -----------------------------------------------------------------------------------


@query(
    "value_distribution",
    f"""WITH v AS (SELECT idx, trim({t_string('publish_year')}) AS value FROM ({PARSED_SQL})),
c AS (SELECT count(*) FILTER (WHERE trim(raw) <> '' AND json_valid(raw)) AS total,
count(*) FILTER (WHERE trim(raw) <> '' AND NOT json_valid(raw)) AS bad FROM ({RECORDS_SQL}))
SELECT value, n::BIGINT AS n, round(n::DOUBLE / greatest(total - bad, 1), 6) AS ratio FROM (
SELECT value, count(*) AS n, min(idx) AS f FROM v WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, f LIMIT 20), c""",
)
def value_distribution(spark, sf_dir):
    top, _ = content.value_distribution(raw_records(spark, sf_dir), "publish_year", 20)
    return rounded(top.drop("first_idx"), "ratio")


@query(
    "value_distribution_totals",
    f"""WITH v AS (SELECT trim({t_string('publish_year')}) AS value FROM ({PARSED_SQL}))
SELECT (SELECT count(*) FROM v)::BIGINT AS total, (SELECT count(*) FROM v WHERE value IS NULL)::BIGINT AS missing,
(SELECT count(*) FROM ({RECORDS_SQL}) WHERE trim(raw) <> '' AND NOT json_valid(raw))::BIGINT AS bad_json,
(SELECT count(DISTINCT value) FROM v)::BIGINT AS "unique" """,
)
def value_distribution_totals(spark, sf_dir):
    return content.value_distribution(raw_records(spark, sf_dir), "publish_year", 20)[1]


_DIST = [tuple(p.split(".")) for p in content.SALE_PATHS]
_PICK = f"coalesce({', '.join(t_string(*p) for p in _DIST)})"
_FROM = "CASE " + " ".join(f"WHEN {t_string(*p)} IS NOT NULL THEN '{'.'.join(p)}'" for p in _DIST) + " END"
DIST_SQL = f"""WITH p AS (SELECT idx, trim({_PICK}) AS v, {_FROM} AS path FROM ({PARSED_SQL})),
v AS (SELECT idx, path, CASE WHEN upper(v) IN ('FREE', 'PAY') THEN upper(v) WHEN regexp_matches(v, '^[0-9]+$') THEN v::BIGINT::VARCHAR ELSE v END AS value FROM p),
c AS (SELECT count(*) FILTER (WHERE trim(raw) <> '' AND json_valid(raw)) AS total,
count(*) FILTER (WHERE trim(raw) <> '' AND NOT json_valid(raw)) AS bad FROM ({RECORDS_SQL}))
SELECT {{x}} AS value, n::BIGINT AS n, round(n::DOUBLE / greatest(total - bad, 1), 6) AS ratio FROM (
SELECT {{x}}, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY {{x}}), c"""


@query("sale_type_distribution", DIST_SQL.replace("{x}", "value"))
def sale_type_distribution(spark, sf_dir):
    return rounded(content.first_path_distribution(raw_records(spark, sf_dir))[0].drop("first_idx"), "ratio")


@query("sale_type_sources", DIST_SQL.replace("{x}", "path"))
def sale_type_sources(spark, sf_dir):
    return rounded(content.first_path_distribution(raw_records(spark, sf_dir))[1].drop("first_idx"), "ratio")


@query(
    "scan_stats",
    f"""SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE NOT json_valid(raw))::BIGINT AS bad_json
FROM ({RECORDS_SQL}) WHERE trim(raw) <> ''""",
)
def scan_stats(spark, sf_dir):
    return jsonl.scan_stats(raw_records(spark, sf_dir))


# -- files --------------------------------------------------------------------------------------------


def written_lines(spark, sf_dir) -> str:
    """The records as text files whose names and lines follow the row numbers."""
    path = scratch(spark) + "/records"
    rows = raw_records(spark, sf_dir)
    rows.repartitionByRange(4, "idx").sortWithinPartitions("idx").select(F.col("raw").alias("value")).write.text(path)
    return path


@query("numbered_lines", f"SELECT idx AS line, raw AS value FROM ({RECORDS_SQL})")
def numbered_lines(spark, sf_dir):
    return jsonl.read_lines(spark, written_lines(spark, sf_dir))


@query(
    "tolerant_scan",
    f"SELECT (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS idx, idx AS line, {t_string('id')} AS id FROM ({PARSED_SQL})",
)
def tolerant_scan(spark, sf_dir):
    out = jsonl.read_jsonl(spark, written_lines(spark, sf_dir), mode="drop", dense=True)
    return out.select("idx", "line", records.field(F.col("rec"), "id").alias("id"))


@query(
    "strict_scan_of_shards",
    f"""WITH p AS (SELECT idx, raw FROM ({PARSED_SQL}))
SELECT (row_number() OVER (ORDER BY shard, idx) - 1)::BIGINT AS line, id FROM (
SELECT 0 AS shard, idx, {t_string('id')} AS id FROM ({PARSED_SQL}) UNION ALL SELECT 1, idx, {t_string('id')} FROM ({PARSED_SQL}))""",
)
def strict_scan_of_shards(spark, sf_dir):
    root = scratch(spark)
    rows = parsed_records(spark, sf_dir).select("idx", F.col("raw").alias("value"))
    for shard in ("a", "b"):
        rows.repartitionByRange(3, "idx").sortWithinPartitions("idx").select("value").write.text(f"{root}/{shard}")
    out = jsonl.read_jsonl(spark, [f"{root}/a", f"{root}/b"])
    return out.select("line", records.field(F.col("rec"), "id").alias("id"))


@query(
    "indices_file_round_trip",
    f"""WITH codes AS ({ORDER_CODES_SQL}), r AS (SELECT idx, {t_string('id')} AS id, ({t_sale_number(W_VALUE, W_KIND, True)})::VARCHAR AS saletype FROM ({PARSED_SQL}))
SELECT idx::VARCHAR AS idx, id, c1 || ',' || c2 AS indices, '<b_' || c2 || '>' AS second, saletype FROM r JOIN codes USING (idx)""",
)
def indices_file_round_trip(spark, sf_dir):
    path = scratch(spark) + "/indices"
    codes = order_codes(spark, sf_dir).select("idx", F.array("c1", "c2").alias("codes"))
    sinks.write_indices(records.format_b(parsed_records(spark, sf_dir), codes), path)
    rec = F.col("rec")
    return jsonl.read_jsonl(spark, path).select(
        records.field(rec, "idx").alias("idx"),
        records.field(rec, "id").alias("id"),
        F.array_join(records.field(rec, "indices", as_type="array<string>"), ",").alias("indices"),
        F.get(records.field(rec, "tokens", as_type="array<string>"), F.lit(1)).alias("second"),
        records.field(rec, "saletype").alias("saletype"),
    )


@query(
    "metrics_tree_round_trip",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT 'r1' AS run, domain AS strategy, count(*)::BIGINT AS n,
count(DISTINCT c1)::BIGINT AS used FROM codes GROUP BY domain""",
)
def metrics_tree_round_trip(spark, sf_dir):
    path = scratch(spark) + "/metrics"
    stats = order_codes(spark, sf_dir).groupBy(F.col("domain").alias("strategy")).agg(
        F.count("*").alias("n"), F.count_distinct("c1").alias("used")
    )
    sinks.write_metrics(stats.withColumn("run", F.lit("r1")), path, ["run", "strategy"])
    return spark.read.schema("n bigint, used bigint, run string, strategy string").json(path).select("run", "strategy", "n", "used")


@query("vector_scan", f"SELECT vec_id AS idx, len(embedding)::INT AS dim, {whole_sql('embedding::DOUBLE[]')} FROM embeddings")
def vector_scan(spark, sf_dir):
    rows = read_vectors(spark, f"{sf_dir}/embeddings.parquet", idx="vec_id")
    return rows.select("idx", F.size("embedding").alias("dim"), *whole("embedding"))


@query(
    "matrix_file_round_trip",
    f"""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, len(embedding)::INT AS dim, {whole_sql('embedding::DOUBLE[]')} FROM embeddings""",
)
def matrix_file_round_trip(spark, sf_dir):
    """The vectors as matrix files in the shared folder, and their rows as numbered when read back."""
    paths = write_npy(table(spark, sf_dir, "embeddings"), f"{scratch(spark)}/matrix", idx="vec_id")
    return read_npy(spark, paths).select("idx", F.size("embedding").alias("dim"), *whole("embedding"))


# -- joins --------------------------------------------------------------------------------------------


@query(
    "positional_join",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT codes.idx, c1, event_type FROM codes JOIN events ON event_id = codes.idx""",
)
def positional_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "event_type")
    return joins.attach(order_codes(spark, sf_dir).select("idx", "c1"), events)


@query(
    "strict_positional_join",
    f"""WITH codes AS ({ORDER_CODES_SQL}) SELECT idx, c1, o_orderstatus AS status FROM codes JOIN orders ON o_orderkey = idx""",
)
def strict_positional_join(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("status"))
    return joins.attach(order_codes(spark, sf_dir).select("idx", "c1"), status, strict=True)


SOURCE_SQL = f"""SELECT idx, CASE WHEN c1 = 0 THEN NULL ELSE c1 || '-' || c3 END AS sid, c2 + (c1 % 2) AS indices FROM ({ORDER_CODES_SQL})"""


def _overwrite(spark, sf_dir, seen=None):
    rows = order_codes(spark, sf_dir)
    dash = F.concat_ws("-", F.col("c1").cast("string"), F.col("c4").cast("string"))
    target = rows.select("idx", dash.alias("sid"), F.col("c2").alias("indices"), "title")
    fresh = F.when(F.col("c1") != 0, F.concat_ws("-", F.col("c1").cast("string"), F.col("c3").cast("string")))
    source = rows.select("idx", fresh.alias("sid"), (F.col("c2") + F.col("c1") % 2).alias("indices"))
    return joins.overwrite(target, source, ["sid", "indices"], seen=seen)


@query(
    "positional_overwrite",
    f"""WITH codes AS ({ORDER_CODES_SQL}), s AS ({SOURCE_SQL})
SELECT codes.idx, coalesce(s.sid, c1 || '-' || c4) AS sid, s.indices::INT AS indices, title FROM codes JOIN s ON s.idx = codes.idx""",
)
def positional_overwrite(spark, sf_dir):
    return _overwrite(spark, sf_dir)[0]


@query(
    "overwrite_counters",
    f"""WITH codes AS ({ORDER_CODES_SQL}), s AS ({SOURCE_SQL})
SELECT count(*)::BIGINT AS processed, count(*) FILTER (WHERE s.sid IS NOT NULL AND s.sid <> c1 || '-' || c4)::BIGINT AS changed_sid,
count(*) FILTER (WHERE s.indices <> c2)::BIGINT AS changed_indices, count(*) FILTER (WHERE s.sid IS NULL)::BIGINT AS missing_sid,
0::BIGINT AS missing_indices FROM codes JOIN s ON s.idx = codes.idx""",
)
def overwrite_counters(spark, sf_dir):
    return _overwrite(spark, sf_dir)[1]


@query(
    "overwrite_with_counters",
    f"""WITH codes AS ({ORDER_CODES_SQL}), s AS ({SOURCE_SQL})
SELECT codes.idx, coalesce(s.sid, c1 || '-' || c4) AS sid, count(*) OVER ()::BIGINT AS processed,
count(*) FILTER (WHERE s.sid IS NOT NULL AND s.sid <> c1 || '-' || c4) OVER ()::BIGINT AS changed_sid,
count(*) FILTER (WHERE s.sid IS NULL) OVER ()::BIGINT AS missing_sid FROM codes JOIN s ON s.idx = codes.idx""",
)
def overwrite_with_counters(spark, sf_dir):
    """The rows as written, beside the counters that the writing job observed: one join gives both."""
    seen, path = Observation(), f"{scratch(spark)}/rows"
    rows = _overwrite(spark, sf_dir, seen)[0]
    rows.write.parquet(path)
    counters = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("processed", "changed_sid", "missing_sid")]
    return spark.read.schema(rows.schema).parquet(path).select("idx", "sid", *counters)


@query(
    "inject_meta_json",
    f"""WITH r AS (SELECT idx, j FROM ({PARSED_SQL}))
SELECT idx, coalesce({t_string('meta_json', 'saletype')}, {t_string('meta', 'meta_json', 'saletype')}) AS meta_json FROM r""",
)
def inject_meta_json(spark, sf_dir):
    rec = F.col("rec")
    rows = parsed_records(spark, sf_dir)
    meta = rows.select(
        "idx",
        D.get_path(rec, "meta_json.saletype").alias("meta_json"),
        D.get_path(rec, "meta.meta_json.saletype").alias("nested_meta_json"),
    )
    return joins.inject_meta_json(rows.select("idx"), meta)


PATCH_SQL = """WITH t AS (SELECT o_orderkey AS line, CASE WHEN o_custkey % 11 = 0 THEN 'x' ELSE o_orderkey::VARCHAR END AS idx,
o_custkey AS id, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS domain, (o_custkey % 7)::INT AS e FROM orders),
s AS (SELECT l_orderkey AS idx, o_custkey AS id, o_orderstatus AS domain, arg_max(l_quantity::INT, rn) AS e FROM (
SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) l
JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
j AS (SELECT t.*, t.idx <> 'x' AND t.domain IS NOT NULL AS good, s.e AS new_e FROM t LEFT JOIN s
ON try_cast(t.idx AS BIGINT) = s.idx AND t.id = s.id AND t.domain = s.domain)
"""


def _patched(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    five = F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4), (F.col("o_custkey") % 7).cast("int"))
    target = orders.select(
        F.col("o_orderkey").alias("line"),
        F.when(F.col("o_custkey") % 11 == 0, "x").otherwise(F.col("o_orderkey").cast("string")).alias("idx"),
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_custkey") % 13 != 0, F.col("o_orderstatus")).alias("domain"),
        five.alias("indices"),
        K.format_sid(five).alias("tokens"),
    )
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select(*key, "l_quantity")
    source = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("idx"),
        F.col("o_custkey").alias("id"),
        F.col("o_orderstatus").alias("domain"),
        F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.col("l_quantity").cast("int")).alias("indices"),
        # record order of the source: the key columns themselves, compared as a struct
        F.struct(*key).alias("line"),
    )
    return joins.patch_layer5(target, source)


@query(
    "patch_layer5",
    PATCH_SQL + "SELECT line, coalesce(CASE WHEN good THEN new_e END, e)::INT AS code, '<e_' || coalesce(CASE WHEN good THEN new_e END, e) || '>' AS token FROM j",
)
def patch_layer5(spark, sf_dir):
    rows = _patched(spark, sf_dir)[0]
    return rows.select("line", F.get("indices", F.lit(4)).alias("code"), F.get("tokens", F.lit(4)).alias("token"))


@query(
    "patch_layer5_counters",
    PATCH_SQL
    + """SELECT count(*)::BIGINT AS target_total, count(*) FILTER (WHERE NOT good)::BIGINT AS target_bad,
count(*) FILTER (WHERE good AND new_e IS NULL)::BIGINT AS target_missing, count(*) FILTER (WHERE good AND new_e <> e)::BIGINT AS target_changed FROM j""",
)
def patch_layer5_counters(spark, sf_dir):
    return _patched(spark, sf_dir)[1]


@query(
    "concat_and_inject",
    f"""WITH n AS (SELECT count(*) AS n FROM documents), u AS (
SELECT doc_id AS idx, 'station' AS domain, source AS name FROM documents UNION ALL
SELECT p_partkey + n, 'video', p_brand FROM part, n), c AS ({ORDER_CODES_SQL})
SELECT u.idx::BIGINT AS idx, u.domain, u.name, c1 || ',' || c2 AS sid FROM u JOIN c ON c.idx = u.idx""",
)
def concat_and_inject(spark, sf_dir):
    station = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("name"))
    video = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("name"))
    items = joins.concat_domains(station, video, names=("station", "video"))
    codes = order_codes(spark, sf_dir).select("idx", F.array("c1", "c2").alias("codes"))
    out = joins.inject_codes(items, joins.keep_in(codes, items), levels=2)
    return out.select("idx", "domain", "name", F.array_join(F.col("sid").cast("array<string>"), ",").alias("sid"))


@query(
    "inject_every_row",
    f"""WITH c AS ({ORDER_CODES_SQL}) SELECT idx, o_orderpriority AS name, c1 || ',' || c2 || ',' || c3 AS sid FROM orders JOIN c ON o_orderkey = idx""",
)
def inject_every_row(spark, sf_dir):
    """Items and codes as they are, nothing left out first: the job itself holds that rows match one to one."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("name"))
    codes = order_codes(spark, sf_dir).select("idx", F.array("c1", "c2", "c3").alias("codes"))
    out = joins.inject_codes(items, codes, levels=3)
    return out.select("idx", "name", F.array_join(F.col("sid").cast("array<string>"), ",").alias("sid"))


@query(
    "alignment_gaps",
    "SELECT doc_id AS idx, source AS id, lang AS other_id FROM documents WHERE source IS DISTINCT FROM lang",
)
def alignment_gaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.select(F.col("doc_id").alias("idx"), F.col("source").alias("id"))
    b = docs.select(F.col("doc_id").alias("idx"), F.col("lang").alias("id"))
    return joins.check_alignment(a, b, full=True)


@query(
    "alignment_spot_check",
    """WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id AS idx, source AS id, lang AS other_id FROM documents, n WHERE doc_id IN (0, n // 2, n - 1)""",
)
def alignment_spot_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.select(F.col("doc_id").alias("idx"), F.col("source").alias("id"))
    return joins.check_alignment(a, docs.select(F.col("doc_id").alias("idx"), F.col("lang").alias("id")))


@query(
    "vectors_by_offset",
    f"""WITH codes AS ({ORDER_CODES_SQL}), k AS (SELECT count(*) AS total FROM codes),
f AS (SELECT c1, idx AS source_idx, row_number() OVER (ORDER BY idx) - 1 AS idx FROM codes WHERE domain = 'F'),
m AS (SELECT count(*) AS kept FROM f)
SELECT f.idx::BIGINT AS idx, source_idx, c1, o_custkey AS payload FROM f, k, m, orders WHERE o_orderkey = f.idx + total - kept""",
)
def vectors_by_offset(spark, sf_dir):
    codes = order_codes(spark, sf_dir).select("idx", "c1", "domain")
    kept = codes.where(F.col("domain") == "F").drop("domain")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("payload"))
    out = joins.align_offset(kept, rows, codes.count() - kept.count(), renumber=True)
    return out.select("idx", "source_idx", "c1", "payload")


@query(
    "labelled_documents",
    "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def labelled_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")


@query("row_count_check", "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS other_n FROM orders")
def row_count_check(spark, sf_dir):
    from quantaloom.operators.sampling import row_gap

    return row_gap(order_codes(spark, sf_dir), table(spark, sf_dir, "orders"))
