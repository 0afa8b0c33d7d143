"""Queries over catalogue text: cleaning, labels, tags, titles, canonical texts, field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantaloom.functions import text as X
from quantaloom.functions.fields import norm_sale, norm_year, pack_hardcode, years_ago
from quantaloom.plans.base import CATALOGUE_SQL, catalogue, query, table

# -- DuckDB forms ------------------------------------------------------------------------------


def t_text(c: str) -> str:
    return f"nullif(trim({c}), '')"


def t_artists(c: str) -> str:
    return f"array_to_string(list_slice(string_split({t_text(c)}, '、'), 1, 3), '、')"


def t_distinct(tokens: str) -> str:
    cleaned = f"list_filter(list_transform({tokens}, lambda x: trim(x)), lambda x: x <> '')"
    return cleaned


def t_merge(tokens: str) -> str:
    """Tokens in column ``t`` to the joined distinct list."""
    return (
        f"nullif(array_to_string(list_filter({tokens}, lambda x, i: "
        f"list_position(list_transform({tokens}, lambda y: lower(y)), lower(x)) = i), '、'), '')"
    )


VIDEO_TOKENS = t_distinct("regexp_split_to_array(llm_tag, '[、,;；]+')")
STATION_TOKENS = t_distinct(
    "list_concat(list_concat(string_split(coalesce(f_tags, ''), ','), string_split(coalesce(s_tags, ''), ',')), "
    "list_concat(string_split(coalesce(k_tags, ''), ','), string_split(coalesce(c_tags, ''), ',')))"
)


def t_key(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^0-9A-Za-z一-鿿]', '', 'g'))"


TITLE_SQL = f"""CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a
WHEN ({t_key('a')} <> '' AND contains({t_key('b')}, {t_key('a')})) OR ({t_key('b')} <> '' AND contains({t_key('a')}, {t_key('b')}))
THEN CASE WHEN length({t_key('b')}) > length({t_key('a')}) THEN b ELSE a END
WHEN lower(a) = lower(b) THEN a ELSE a || '、' || b END"""

PAY_SQL = "CASE upper(trim(pay_type)) WHEN 'PAY' THEN '付费' WHEN 'FREE' THEN '免费' END"
SALE_SQL = "CASE try_cast(trim(saletype) AS INT) WHEN 0 THEN '免费' WHEN 1 THEN '付费' WHEN 2 THEN '付费' END"


def t_labelled(pairs: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '{k}：“' || {v} || '”' END" for k, v in pairs)
    return f"CASE WHEN concat_ws('，', {parts}) <> '' THEN concat_ws('，', {parts}) || '。' ELSE '' END"


# columns prepared once so that the labelled text stays readable
PREPARED = f"""
SELECT *, {TITLE_SQL} AS v_title, {t_merge('video_tokens')} AS v_tags, {t_merge('station_tokens')} AS s_merged
FROM (SELECT *, {t_text('meta_main_name')} AS a, {t_text('meta_origin_name')} AS b,
      {VIDEO_TOKENS} AS video_tokens, {STATION_TOKENS} AS station_tokens,
      {t_artists('directors')} AS v_directors,
      {t_artists("coalesce(nullif(main_actors, ''), actors)")} AS v_actors, {t_artists('characters')} AS v_roles,
      {t_text('rec_tag_desc')} AS v_desc, {t_text('patchwall_ip_name')} AS v_ip, {PAY_SQL} AS v_pay,
      cast(publish_year AS VARCHAR) AS v_year, {SALE_SQL} AS s_pay,
      CASE trim(cp) WHEN 'Brand#1' THEN '一号' WHEN 'Brand#2' THEN '二号' ELSE {t_text('cp')} END AS s_cp,
      {t_text('name')} AS s_name, {t_text('mainname')} AS s_main, {t_text('subname')} AS s_sub,
      {t_text('"desc"')} AS s_desc, {t_text('br_name')} AS s_host
      FROM ({CATALOGUE_SQL}))"""
VIDEO_TEXT = t_labelled(
    [("标题", "v_title"), ("IP系列名", "v_ip"), ("标签", "v_tags"), ("付费状态", "v_pay"), ("出版时间", "v_year"),
     ("导演", "v_directors"), ("演员", "v_actors"), ("角色", "v_roles"), ("描述", "v_desc")]
)
STATION_TEXT = t_labelled(
    [("资源商", "s_cp"), ("原始标题", "s_name"), ("主标题", "s_main"), ("副标题", "s_sub"), ("描述", "s_desc"),
     ("主播", "s_host"), ("标签", "s_merged"), ("付费状态", "s_pay")]
)
DOMAIN_SQL = """CASE WHEN coalesce(nullif(domain, ''),
CASE WHEN json_valid(json_format) THEN nullif(json_extract_string(json_format, '$."垂域"'), '') END,
CASE WHEN json_valid(json_format) THEN nullif(json_extract_string(json_format, '$.domain'), '') END)
IN ('电台', 'station') THEN 'station' ELSE 'video' END"""

PROVIDERS = {"Brand#1": "一号", "Brand#2": "二号"}


@query(
    "clean_text",
    f"SELECT idx, {t_text('meta_origin_name')} AS origin, {t_text('subname')} AS subname, "
    f"nullif(array_to_string({t_distinct('string_split(k_tags, chr(44))')}, '、'), '') AS list_text FROM ({CATALOGUE_SQL})",
)
def clean_text(spark, sf_dir):
    df = catalogue(spark, sf_dir)
    return df.select(
        "idx",
        X.to_text(F.col("meta_origin_name")).alias("origin"),
        X.to_text(F.col("subname")).alias("subname"),
        X.list_to_text(F.split("k_tags", ",")).alias("list_text"),
    )


@query("payment_labels", f"SELECT idx, {SALE_SQL} AS sale_label, {PAY_SQL} AS pay_label FROM ({CATALOGUE_SQL})")
def payment_labels(spark, sf_dir):
    df = catalogue(spark, sf_dir)
    return df.select(
        "idx", X.saletype_label(F.col("saletype")).alias("sale_label"), X.paytype_label(F.col("pay_type")).alias("pay_label")
    )


@query("top_artists", f"SELECT idx, {t_artists('directors')} AS artists FROM ({CATALOGUE_SQL})")
def top_artists(spark, sf_dir):
    return catalogue(spark, sf_dir).select("idx", X.top_artists(F.col("directors")).alias("artists"))


@query("merge_tags_video", f"SELECT idx, v_tags AS tags FROM ({PREPARED})")
def merge_tags_video(spark, sf_dir):
    return catalogue(spark, sf_dir).select("idx", X.merge_tags(F.col("llm_tag")).alias("tags"))


@query("merge_tags_station", f"SELECT idx, s_merged AS tags FROM ({PREPARED})")
def merge_tags_station(spark, sf_dir):
    cols = [F.col(c) for c in ("f_tags", "s_tags", "k_tags", "c_tags")]
    return catalogue(spark, sf_dir).select("idx", X.merge_tags(*cols, sep=",").alias("tags"))


@query("resolve_title", f"SELECT idx, v_title AS title FROM ({PREPARED})")
def resolve_title(spark, sf_dir):
    title = X.resolve_title(F.col("meta_main_name"), F.col("meta_origin_name"))
    return catalogue(spark, sf_dir).select("idx", title.alias("title"))


@query("video_text", f"SELECT idx, {VIDEO_TEXT} AS text_format FROM ({PREPARED})")
def video_text(spark, sf_dir):
    df = catalogue(spark, sf_dir)
    return df.select("idx", X.video_text(df).alias("text_format"))


@query("station_text", f"SELECT idx, {STATION_TEXT} AS text_format FROM ({PREPARED})")
def station_text(spark, sf_dir):
    df = catalogue(spark, sf_dir)
    return df.select("idx", X.station_text(df, PROVIDERS).alias("text_format"))


@query("resolve_domain", f"SELECT idx, {DOMAIN_SQL} AS kind FROM ({CATALOGUE_SQL})")
def resolve_domain(spark, sf_dir):
    return catalogue(spark, sf_dir).select("idx", X.resolve_domain(F.col("domain"), F.col("json_format")).alias("kind"))


@query(
    "rebuild_text_format",
    f"SELECT idx, name, CASE WHEN {DOMAIN_SQL} = 'station' THEN {STATION_TEXT} ELSE {VIDEO_TEXT} END AS text_format FROM ({PREPARED})",
)
def rebuild_text_format(spark, sf_dir):
    return X.rebuild_text_format(catalogue(spark, sf_dir), PROVIDERS).select("idx", "name", "text_format")


@query(
    "video_text_from_json",
    f"SELECT idx, {VIDEO_TEXT} AS text_format FROM ({PREPARED})",
)
def video_text_from_json(spark, sf_dir):
    """The same texts from JSON records whose people fields are lists or strings, by turns."""
    from quantaloom.operators.records import item_columns, parse_records

    strings = ["meta_main_name", "meta_origin_name", "llm_tag", "rec_tag_desc", "patchwall_ip_name", "publish_year", "pay_type"]
    lists = ["directors", "main_actors", "actors", "characters"]
    df = catalogue(spark, sf_dir)
    people = F.struct(*[F.split(n, "、").alias(n) if n == "directors" else F.col(n) for n in lists])
    plain = F.struct(*lists)
    as_json = [F.to_json(F.struct(F.struct(*strings, p.alias("people")).alias("meta"))) for p in (people, plain)]
    rows = df.select("idx", F.when(F.col("idx") % 2 == 0, as_json[0]).otherwise(as_json[1]).alias("raw"))
    flat = item_columns(parse_records(rows), strings, holder="meta")
    flat = item_columns(flat.withColumn("rec", F.try_variant_get("rec", "$.meta.people", "variant")), [], lists)
    return flat.select("idx", X.video_text(flat).alias("text_format"))


def t_extract(label: str) -> str:
    return f"""CASE WHEN contains(text_format, '{label}：') THEN regexp_extract(text_format, '{label}：“([^”]*)', 1) END"""


MAIN_SQL = "nullif(regexp_extract(text_format, '主标题：[^，。,]*'), '')"


@query(
    "extract_fields",
    f"""SELECT idx, {t_extract('标签')} AS tags, {t_extract('副标题')} AS subname, {MAIN_SQL} AS main_title,
CASE WHEN contains(text_format, '标签：') THEN '' END AS literal_tags FROM ({CATALOGUE_SQL})""",
)
def extract_fields(spark, sf_dir):
    c = F.col("text_format")
    return catalogue(spark, sf_dir).select(
        "idx",
        X.extract_field(c, "tags").alias("tags"),
        X.extract_field(c, "subname").alias("subname"),
        X.extract_field(c, "main_title").alias("main_title"),
        X.extract_field(c, "tags", literal=True).alias("literal_tags"),
    )


@query(
    "resolve_main_name",
    f"SELECT idx, coalesce({MAIN_SQL}, nullif(meta_main_name, ''), nullif(meta_origin_name, ''), nullif(name, '')) AS main_name FROM ({CATALOGUE_SQL})",
)
def resolve_main_name(spark, sf_dir):
    df = catalogue(spark, sf_dir)
    return df.select("idx", X.resolve_main_name(df).alias("main_name"))


@query(
    "prepare_station_texts",
    f"""SELECT idx, coalesce(nullif(name, ''), nullif(mainname, ''), nullif(rawname, '')) AS text_name,
coalesce(nullif({t_extract('副标题')}, ''), subname) AS text_subname, {t_extract('标签')} AS text_tags,
text_format AS text_text_format, json_format AS text_json_format FROM ({CATALOGUE_SQL})""",
)
def prepare_station_texts(spark, sf_dir):
    out = X.prepare_texts(catalogue(spark, sf_dir), domain="station")
    return out.select("idx", *["text_" + f for f in X.EMBEDDED_FIELDS["station"]])


@query(
    "prepare_video_texts_long",
    f"""WITH p AS (SELECT idx, coalesce({MAIN_SQL}, nullif(meta_main_name, ''), nullif(meta_origin_name, ''), nullif(name, '')) AS main_name,
text_format, json_format FROM ({CATALOGUE_SQL}))
SELECT idx, 'main_name' AS field, main_name AS text FROM p UNION ALL
SELECT idx, 'text_format', text_format FROM p UNION ALL SELECT idx, 'json_format', json_format FROM p""",
)
def prepare_video_texts_long(spark, sf_dir):
    fields = X.EMBEDDED_FIELDS["video"]
    return X.texts_long(X.prepare_texts(catalogue(spark, sf_dir), fields), ["idx"], fields)


def t_whole(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN try_cast(trim({c}) AS BIGINT) END"


def t_sale(c: str) -> str:
    return f"""CASE upper(trim({c})) WHEN 'FREE' THEN 1 WHEN 'PAY' THEN 2 ELSE
coalesce(CASE WHEN regexp_matches(trim({c}), '^[0-9]+$') THEN try_cast(trim({c}) AS BIGINT) END, 0) END"""


@query(
    "embedding_side_fields",
    f"""SELECT idx, (CASE upper(trim(pay_type)) WHEN 'PAY' THEN 1 WHEN 'FREE' THEN 2 ELSE coalesce({t_whole('pay_type')}, 0) END)::BIGINT AS pay,
coalesce(greatest(0, 2026 - publish_year), 0)::BIGINT AS years_ago FROM ({CATALOGUE_SQL})""",
)
def embedding_side_fields(spark, sf_dir):
    return catalogue(spark, sf_dir).select(
        "idx",
        norm_sale(F.col("pay_type"), "embed").alias("pay"),
        years_ago(F.col("publish_year")).cast("bigint").alias("years_ago"),
    )


@query(
    "sale_and_year",
    f"""SELECT idx, ({t_sale('saletype')})::BIGINT AS sale, ({t_sale('pay_type')})::BIGINT AS pay, publish_year::BIGINT AS year,
coalesce({t_whole('subname')}, 0)::BIGINT AS not_a_year FROM ({CATALOGUE_SQL})""",
)
def sale_and_year(spark, sf_dir):
    return catalogue(spark, sf_dir).select(
        "idx",
        norm_sale(F.col("saletype")).alias("sale"),
        norm_sale(F.col("pay_type"), "writer").alias("pay"),
        norm_year(F.col("publish_year")).alias("year"),
        norm_year(F.col("subname")).alias("not_a_year"),
    )


@query(
    "packed_metadata",
    f"""SELECT packed, count(*)::BIGINT AS n FROM (SELECT
((((CASE WHEN 2035 - publish_year BETWEEN 0 AND 125 THEN 2035 - publish_year ELSE 0 END)::INT & 127) << 2) | least({t_sale('saletype')}, 3)::INT)::INT AS packed
FROM ({CATALOGUE_SQL})) GROUP BY packed""",
)
def packed_metadata(spark, sf_dir):
    code = pack_hardcode(norm_sale(F.col("saletype")), norm_year(F.col("publish_year")))
    return catalogue(spark, sf_dir).groupBy(code.alias("packed")).agg(F.count("*").alias("n"))


_VALUES = "list_filter(list_transform(regexp_split_to_array(genre_types, '[;,；、|]+'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "multi_values",
    f"""SELECT idx, len({_VALUES})::INT AS n_values, coalesce({_VALUES}[1], '(缺失)') AS first_value,
coalesce(nullif(trim(pay_type), ''), '(缺失)') AS pay FROM ({CATALOGUE_SQL})""",
)
def multi_values(spark, sf_dir):
    return catalogue(spark, sf_dir).select(
        "idx",
        F.size(X.split_values(F.col("genre_types"))).alias("n_values"),
        X.scalar_or_missing(F.col("genre_types")).alias("first_value"),
        X.scalar_or_missing(F.col("pay_type")).alias("pay"),
    )


@query(
    "tag_overlap",
    f"""WITH p AS (SELECT idx, string_split(f_tags, ',') AS f, {t_distinct("string_split(s_tags, ',')")} AS s FROM ({CATALOGUE_SQL})),
q AS (SELECT idx, f, list_transform(s, lambda x: lower(x)) AS s FROM p)
SELECT idx, len(list_intersect(f, s))::INT AS shared, len(list_distinct(list_concat(f, s)))::INT AS together, list_has_any(f, s) AS any_shared FROM q""",
)
def tag_overlap(spark, sf_dir):
    f = X.clean_values(F.split("f_tags", ","))
    s = F.transform(X.clean_values(F.split("s_tags", ",")), F.lower)
    return catalogue(spark, sf_dir).select(
        "idx",
        F.size(F.array_intersect(f, s)).alias("shared"),
        F.size(F.array_union(f, s)).alias("together"),
        F.arrays_overlap(f, s).alias("any_shared"),
    )


@query(
    "document_texts",
    """SELECT doc_id, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') IS NOT NULL AS has_text,
length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::INT AS n_chars, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '其他' END AS kind FROM documents""",
)
def document_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cleaned = X.strip(F.col("text"))
    return docs.select(
        "doc_id",
        X.to_text(F.col("text")).isNotNull().alias("has_text"),
        F.length(cleaned).alias("n_chars"),
        F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("其他").alias("kind"),
    )
