"""Text columns: cleaning, labels, tag merging, title choice and the canonical item text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separator between list items, the tag and multi-value separators, and the
# placeholder of an absent scalar.
LIST_SEPARATOR = "、"
TAG_SEPARATORS = "、,;；"
VALUE_SEPARATORS = ";,；、|"
MISSING_SCALAR = "(缺失)"

# Labels of the canonical texts, in output order.
VIDEO_LABELS = ["标题", "IP系列名", "标签", "付费状态", "出版时间", "导演", "演员", "角色", "描述"]
STATION_LABELS = ["资源商", "原始标题", "主标题", "副标题", "描述", "主播", "标签", "付费状态"]

# Payment labels, domain names and the fields embedded per domain.
PAID, FREE = "付费", "免费"
STATION_NAMES = ["电台", "station"]
VIDEO_NAMES = ["视频", "video"]
EMBEDDED_FIELDS = {
    "station": ["name", "subname", "tags", "text_format", "json_format"],
    "video": ["main_name", "text_format", "json_format"],
}

# How title, subtitle and tags are found inside a canonical text.
MAIN_TITLE_PATTERN = "(主标题：[^，。,]*)"
QUOTED_PATTERN = "{label}：(?:“([^”]*)”?|([^“，。,][^，。,]*))"
FIELD_LABELS = {"tags": "标签", "subname": "副标题"}


# What counts as white space at the ends of a text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, including the ideographic space."""
    return F.trim(c.cast("string"), F.lit(WHITE_SPACE))


def fold(c: Column) -> Column:
    """Caseless form of a string, also for letters that grow when upper-cased."""
    return F.lower(F.upper(c))


def to_text(c: Column) -> Column:
    """Trimmed string, null when blank."""
    return F.nullif(strip(c), F.lit(""))


def list_to_text(c: Column) -> Column:
    """Join the non-blank items of an array with the ideographic comma; null when none is left."""
    items = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(items, LIST_SEPARATOR), F.lit(""))


def saletype_label(c: Column) -> Column:
    n = strip(c).try_cast("int")
    return F.when(n == 0, FREE).when(n.isin(1, 2), PAID)


def paytype_label(c: Column) -> Column:
    s = F.upper(strip(c))
    return F.when(s == "PAY", PAID).when(s == "FREE", FREE)


def top_artists(c: Column, n: int = 3) -> Column:
    s = to_text(c)
    return F.array_join(F.slice(F.split(s, LIST_SEPARATOR), 1, n), LIST_SEPARATOR)


def split_any(c: Column, separators: str) -> Column:
    """Split on any of several characters; blanks between neighbours stay for the caller to drop.

    Mapping them to one comma first keeps the split off the regular-expression engine.
    """
    return F.split(F.translate(c.cast("string"), separators, "," * len(separators)), ",")


def distinct_folded(items: Column) -> Column:
    """Drop later items equal to an earlier one up to case; order and first spelling are kept."""
    keyed = F.transform(items, lambda x: F.struct(x.alias("v"), fold(x).alias("k")))
    first = let(
        keyed,
        lambda t: let(t["k"], lambda k: F.filter(t, lambda x, i: F.array_position(k, x["k"]) == i + 1)),
    )
    return first["v"]


def merge_tags(*cs: Column, sep: str = TAG_SEPARATORS) -> Column:
    """Split each column on the characters of ``sep``, trim, drop blanks and case-insensitive repeats, rejoin."""
    return merge_tag_lists(*[split_any(c, sep) for c in cs])


def merge_tag_lists(*cs: Column) -> Column:
    """As ``merge_tags`` for columns that already hold arrays."""
    empty = F.array().cast("array<string>")
    tokens = F.transform(F.concat(*[F.coalesce(c, empty) for c in cs]), strip)
    kept = distinct_folded(F.filter(tokens, lambda x: x.isNotNull() & (x != "")))
    return F.nullif(F.array_join(kept, LIST_SEPARATOR), F.lit(""))


def resolve_title(*titles: Column) -> Column:
    """One title out of several.

    When one title contains another (letters, digits and CJK only, caseless) the longest survives,
    the earliest among equals; otherwise the distinct titles are joined.
    """
    cleaned = F.filter(F.array(*[to_text(t) for t in titles]), lambda x: x.isNotNull())
    keyed = F.transform(
        cleaned,
        lambda x, i: F.struct(
            i.alias("pos"), x.alias("title"), fold(F.regexp_replace(x, "[^0-9A-Za-z一-鿿]", "")).alias("key")
        ),
    )

    def choose(t: Column) -> Column:
        contained = F.exists(
            t,
            lambda a: F.exists(t, lambda b: (a["pos"] != b["pos"]) & (a["key"] != "") & F.contains(b["key"], a["key"])),
        )
        by_length = F.transform(t, lambda a: F.struct((-F.length(a["key"])).alias("n"), a["pos"], a["title"]))
        joined = F.array_join(distinct_folded(t["title"]), LIST_SEPARATOR)
        return F.when(F.size(t) == 0, None).when(contained, F.array_min(by_length)["title"]).otherwise(joined)

    return let(keyed, choose)


def labelled(pairs: list[tuple[str, Column]]) -> Column:
    """``label：“value”`` joined by full-width commas and closed by a full stop; empty when no value is."""
    body = F.concat_ws("，", *[F.concat(F.lit(k + "：“"), v, F.lit("”")) for k, v in pairs])
    return let(body, lambda t: F.when(t != "", F.concat(t, F.lit("。"))).otherwise(F.lit("")))


def _col(df: DataFrame, name: str) -> Column:
    """The column, or a null string where the record layout lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _text(df: DataFrame, name: str) -> Column:
    if name in df.columns and df.schema[name].dataType.typeName() == "array":
        return list_to_text(F.col(name))
    return to_text(_col(df, name))


def _first_filled(df: DataFrame, *names: str) -> Column:
    """Text of the first field that is neither absent nor empty."""
    out = None
    for name in reversed(names):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            filled = F.size(F.col(name)) > 0
        else:
            filled = _col(df, name).isNotNull() & (_col(df, name).cast("string") != "")
        out = F.when(filled, _text(df, name)).otherwise(out) if out is not None else _text(df, name)
    return out


def _tags(df: DataFrame, names: list[str], sep: str) -> Column:
    arrays = []
    for name in names:
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            arrays.append(F.col(name).cast("array<string>"))
        else:
            arrays.append(split_any(_col(df, name), sep))
    return merge_tag_lists(*arrays)


def video_text(df: DataFrame) -> Column:
    values = {
        "标题": resolve_title(_text(df, "meta_main_name"), _text(df, "meta_origin_name")),
        "导演": top_artists(_text(df, "directors")),
        "演员": top_artists(_first_filled(df, "main_actors", "actors")),
        "角色": top_artists(_text(df, "characters")),
        "标签": _tags(df, ["llm_tag"], TAG_SEPARATORS),
        "描述": _text(df, "rec_tag_desc"),
        "IP系列名": _text(df, "patchwall_ip_name"),
        "出版时间": _text(df, "publish_year"),
        "付费状态": paytype_label(_col(df, "pay_type")),
    }
    return labelled([(k, values[k]) for k in VIDEO_LABELS])


def station_text(df: DataFrame, providers: dict[str, str] | None = None) -> Column:
    """``providers`` maps provider codes to names; an unmapped code stands for itself."""
    raw = _col(df, "cp").cast("string")
    provider = to_text(raw)
    if providers:
        table = F.create_map(*[F.lit(x) for kv in providers.items() for x in kv])
        provider = F.coalesce(F.try_element_at(table, strip(raw)), provider)
    values = {
        "资源商": provider,
        "原始标题": _text(df, "name"),
        "主标题": _text(df, "mainname"),
        "副标题": _text(df, "subname"),
        "描述": _text(df, "desc"),
        "主播": _text(df, "br_name"),
        "标签": _tags(df, ["f_tags", "s_tags", "k_tags", "c_tags"], ","),
        "付费状态": saletype_label(_col(df, "saletype")),
    }
    return labelled([(k, values[k]) for k in STATION_LABELS])


def resolve_domain(domain: Column, json_format: Column) -> Column:
    """``station`` or ``video``, from the record or from its JSON text; video when unknown."""
    parsed = F.try_parse_json(json_format)
    inner = [
        F.nullif(F.try_variant_get(parsed, '$["垂域"]', "string"), F.lit("")),
        F.nullif(F.try_variant_get(parsed, '$["domain"]', "string"), F.lit("")),
    ]
    found = F.coalesce(F.nullif(domain.cast("string"), F.lit("")), *inner)
    return F.when(F.coalesce(found.isin(*STATION_NAMES), F.lit(False)), "station").otherwise("video")


def text_format(df: DataFrame, domain: str | None = None, providers: dict[str, str] | None = None) -> Column:
    """The canonical text of each record, by its own domain unless one is named."""
    if domain == "video":
        return video_text(df)
    if domain == "station":
        return station_text(df, providers)
    kind = resolve_domain(_col(df, "domain"), _col(df, "json_format"))
    return F.when(kind == "station", station_text(df, providers)).otherwise(video_text(df))


def rebuild_text_format(df: DataFrame, providers: dict[str, str] | None = None) -> DataFrame:
    """Overlay the rebuilt canonical text; every other field stays as it is."""
    return df.withColumn("text_format", text_format(df, providers=providers))


def extract_field(c: Column, name: str, literal: bool = False) -> Column:
    """Tags, subtitle or main title found inside a canonical text; null when the label is absent.

    ``literal=True`` keeps the historical behaviour in which tags and subtitle match as empty.
    """
    if name == "main_title":
        return F.when(c.rlike(MAIN_TITLE_PATTERN), F.regexp_extract(c, MAIN_TITLE_PATTERN, 1))
    label = FIELD_LABELS[name]
    if literal:
        return F.when(c.contains(label + "："), F.lit(""))
    pattern = QUOTED_PATTERN.format(label=label)
    found = F.concat(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))
    return F.when(c.contains(label + "："), found)


def filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def resolve_main_name(df: DataFrame) -> Column:
    """First non-empty of: title inside the text, main name, original name, name."""
    return F.coalesce(
        filled(extract_field(_col(df, "text_format"), "main_title")),
        filled(_col(df, "meta_main_name")),
        filled(_col(df, "meta_origin_name")),
        filled(_col(df, "name")),
    )


def prepare_texts(
    df: DataFrame, fields: list[str] | None = None, domain: str = "video", rebuild: bool = False, literal: bool = False
) -> DataFrame:
    """One ``text_<field>`` column per embedded field; non-string fields give null."""
    out = []
    for field in fields or EMBEDDED_FIELDS[domain]:
        if field == "text_format" and rebuild:
            value = text_format(df)
        elif field == "main_name":
            value = resolve_main_name(df)
        elif field == "name" and domain == "station":
            value = F.coalesce(*[filled(_col(df, n)) for n in ("name", "mainname", "rawname")])
        elif field == "tags":
            value = extract_field(_col(df, "text_format"), "tags", literal)
        elif field == "subname":
            inner = filled(extract_field(_col(df, "text_format"), "subname", literal))
            value = F.coalesce(inner, _col(df, "subname"))
        elif field in df.columns and df.schema[field].dataType.typeName() != "string":
            value = F.lit(None).cast("string")
        else:
            value = _col(df, field)
        out.append(value.alias("text_" + field))
    return df.select("*", *out)


def texts_long(df: DataFrame, id_cols: list[str], fields: list[str]) -> DataFrame:
    """Long form ``(ids…, field, text)`` of ``prepare_texts`` output, for one encoder pass over all fields."""
    wide = df.select(*id_cols, *[F.col("text_" + f).alias(f) for f in fields])
    return wide.unpivot(id_cols, fields, "field", "text")


def split_values(c: Column) -> Column:
    """Multi-valued string to an array of trimmed, non-blank values; empty array for null."""
    parts = F.filter(F.transform(split_any(c, VALUE_SEPARATORS), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def clean_values(c: Column) -> Column:
    """The same for a column that already holds an array."""
    parts = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(parts, F.array().cast("array<string>"))


def scalar_or_missing(c: Column) -> Column:
    return F.coalesce(F.try_element_at(split_values(c), F.lit(1)), F.lit(MISSING_SCALAR))
