"""Whole records: parsing, overlaying codes, changing layouts, classifying and validating rows.

A record is a VARIANT column ``rec``; known fields are read from it by path, the rest travels along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.codes import format_sid, parse_sid, replace_level, trim_levels
from quantaloom.functions.fields import (
    UNKNOWN_YEAR,
    first_present,
    get_path,
    json_path,
    packed_code,
    sale_of_variant,
)
from quantaloom.functions.text import VIDEO_NAMES

# Field names the writers and the record classifier look for.
WRITER_SALE_KEYS = ["saletype", "pay_type", "paytype", "sale_type"]
VIDEO_KEYS = [
    "meta_origin_name",
    "meta_main_name",
    "video_type",
    "pay_type",
    "directors",
    "main_actors",
    "genre_types",
    "characters",
    "actors",
]
STATION_KEYS = ["cpId", "f_tags", "s_tags", "k_tags"]
WRAPPER_KEYS = ["idx", "id", "domain", "meta", "meta_json", "text_format", "json_format"]


def parse_records(df: DataFrame, raw: str = "raw", strict: bool = True) -> DataFrame:
    """Adds ``rec``; strict fails on malformed text, otherwise such rows get null."""
    parsed = F.parse_json(F.col(raw)) if strict else F.try_parse_json(F.col(raw))
    return df.withColumn("rec", parsed)


def field(rec: Column, *keys: str, as_type: str = "string") -> Column:
    return F.try_variant_get(rec, json_path(*keys), as_type)


def _entries(v: Column) -> Column:
    empty = F.expr("cast(map() AS MAP<STRING, VARIANT>)")
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), empty)


def overlay(rec: Column, fields: dict[str, Column], precedence: str = "new") -> Column:
    """JSON text of the record with further fields at top level.

    ``new`` lets the further fields win over the record's own, ``meta`` the other way round.
    """
    own = _entries(rec)
    added = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("variant"))])
    if precedence == "new":
        own = F.map_filter(own, lambda k, _: ~k.isin(*fields))
    elif precedence == "meta":
        keys = F.map_keys(own)
        added = F.map_filter(added, lambda k, _: ~F.array_contains(keys, k))
    else:
        raise ValueError(f"unknown precedence {precedence!r}")
    return F.to_json(F.map_concat(own, added))


def writer_fields(rec: Column, meta_first: bool = True) -> tuple[Column, Column]:
    """``saletype`` and ``publish_year`` as the writers put them: strings, with defaults.

    ``meta_first`` looks inside ``meta`` before the record. The other writer looks at the record first
    and leaves ``saletype`` null when there is none.
    """
    holders = ("meta", "") if meta_first else ("", "meta")
    if meta_first:
        sale, year = [
            F.coalesce(*[first_present(rec, keys, holders=(h,)) for h in holders])
            for keys in (WRITER_SALE_KEYS, ["publish_year"])
        ]
    else:
        sale = first_present(rec, ["saletype", "sale_type", "pay_type", "paytype"], holders=holders)
        year = first_present(rec, ["publish_year"], holders=holders)
    code = sale_of_variant(sale, "writer").cast("string")
    if not meta_first:
        code = F.when(sale.isNotNull(), code)
    return code, F.coalesce(F.try_variant_get(year, "$", "string"), F.lit(UNKNOWN_YEAR))


def format_b(items: DataFrame, codes: DataFrame, meta_first: bool = True, style: str = "letters", **style_args) -> DataFrame:
    """Items (``idx, rec, …``) with their codes: ``indices, tokens, sid, saletype, publish_year``."""
    sale, year = writer_fields(F.col("rec"), meta_first)
    tokens = format_sid(F.col("codes"), style, **style_args)
    joined = items.join(codes.select("idx", "codes"), "idx")
    return joined.select(
        *items.columns,
        F.col("codes").alias("indices"),
        tokens.alias("tokens"),
        tokens.alias("sid"),
        sale.alias("saletype"),
        year.alias("publish_year"),
    )


def subspace_sids(df: DataFrame, per_part: int, parts: int = 2) -> DataFrame:
    """Adds ``sid_subspace1…`` with the tokens of each part."""
    cols = [F.slice("tokens", i * per_part + 1, per_part).alias(f"sid_subspace{i + 1}") for i in range(parts)]
    return df.select("*", *cols)


def meta_json_fields(rec: Column) -> Column:
    """``meta_json`` of the composite-code writer: existing values win, then top level, then ``meta``."""
    values = []
    for key, default in (("saletype", "0"), ("publish_year", UNKNOWN_YEAR)):
        found = F.coalesce(field(rec, "meta_json", key), field(rec, key), field(rec, "meta", key), F.lit(default))
        values += [F.lit(key), found.cast("variant")]
    added = F.create_map(*values)
    own = _entries(field(rec, "meta_json", as_type="variant"))
    rest = F.map_filter(own, lambda k, _: ~k.isin("saletype", "publish_year"))
    return F.to_json(F.map_concat(rest, added))


def indices_to_sid(df: DataFrame) -> DataFrame:
    """``indices`` becomes ``sid``, a string ``idx`` an integer, a null ``meta_json`` its nested copy.

    Needs ``idx, indices, meta_json, rec``; a non-integer idx or a missing list fails the job.
    """
    text = F.col("idx").cast("string")
    number = text.try_cast("bigint")
    idx = F.when(number.isNotNull() | text.isNull(), number).otherwise(
        F.raise_error(F.concat(F.lit("idx is no integer: "), text))
    )
    sid = F.when(F.col("indices").isNotNull(), F.col("indices")).otherwise(F.raise_error(F.lit("indices missing")))
    nested = F.to_json(F.try_variant_get("rec", json_path("meta", "meta_json"), "map<string,variant>"))
    changed = {
        "idx": idx.alias("idx"),
        "indices": sid.alias("sid"),
        "meta_json": F.coalesce("meta_json", nested).alias("meta_json"),
    }
    return df.select(*[changed.get(c, F.col(c)) for c in df.columns])


def trim_frame(df: DataFrame, n: int = 4, column: str = "indices", strict: bool = False) -> DataFrame:
    return df.withColumn(column, trim_levels(F.col(column), n, strict))


def normalize_meta(df: DataFrame, strict: bool = False) -> DataFrame:
    """The layout with ``meta`` as JSON text, from records where it is text or an object.

    An object loses its wrapper keys; ``meta_json``, ``text_format`` and ``json_format`` are lifted out
    of it unless the record has its own.
    """
    rec = F.col("rec")
    meta = F.try_variant_get(rec, '$["meta"]', "variant")
    kind = F.schema_of_variant(meta)
    inner = F.map_filter(_entries(meta), lambda k, _: ~k.isin(*WRAPPER_KEYS))
    text = F.when(kind == "STRING", field(rec, "meta")).when(kind.startswith("OBJECT"), F.to_json(inner))
    indices = field(rec, "indices", as_type="array<int>")

    def lifted(key: str, as_type: str = "string") -> Column:
        own = field(rec, key, as_type=as_type)
        nested = F.when(kind.startswith("OBJECT"), field(rec, "meta", key, as_type=as_type))
        return F.coalesce(own, nested)

    def needed(c: Column, name: str) -> Column:
        return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(name + " missing"))) if strict else c

    meta_json = F.to_json(lifted("meta_json", "map<string,variant>"))
    return df.select(
        needed(field(rec, "idx"), "idx").alias("idx"),
        needed(field(rec, "id"), "id").alias("id"),
        needed(field(rec, "domain"), "domain").alias("domain"),
        (needed(text, "meta") if strict else F.coalesce(text, F.lit("{}"))).alias("meta"),
        needed(meta_json, "meta_json").alias("meta_json"),
        needed(lifted("text_format"), "text_format").alias("text_format"),
        needed(lifted("json_format"), "json_format").alias("json_format"),
        needed(indices, "indices").alias("indices"),
        field(rec, "sid", as_type="array<string>").alias("sid"),
    )


def build_records(items: DataFrame, ref: DataFrame, levels: int = 5) -> DataFrame:
    """Meta-string records from raw items (``idx, domain, raw, rec``) and codes (``idx, indices, meta_json``).

    ``meta_json`` is a string map; a missing year is spelled out. Unmatched rows fail the job.
    """
    from quantaloom.operators.joins import attach

    joined = attach(items, ref.select("idx", "indices", "meta_json"), strict=True)
    known = F.map_contains_key("meta_json", "publish_year")
    filled = F.when(known, F.col("meta_json")).otherwise(
        F.map_concat("meta_json", F.create_map(F.lit("publish_year"), F.lit(UNKNOWN_YEAR)))
    )
    message = F.concat(F.lit(f"expected {levels} codes and meta_json at row "), F.col("idx").cast("string"))
    good = (F.size("indices") == levels) & F.col("meta_json").isNotNull()
    return joined.select(
        F.col("idx").cast("string").alias("idx"),
        field(F.col("rec"), "id").alias("id"),
        "domain",
        F.col("raw").alias("meta"),
        filled.alias("meta_json"),
        field(F.col("rec"), "text_format").alias("text_format"),
        field(F.col("rec"), "json_format").alias("json_format"),
        F.when(good, F.col("indices")).otherwise(F.raise_error(message)).alias("sid"),
    )


def fix_layer5(df: DataFrame, layout: str = "legacy_b") -> DataFrame:
    """Recompute the fifth code (and token) from the record's own metadata; adds ``changed``.

    Needs ``rec, indices, tokens``. Rows with fewer than five codes stay as they are.
    """
    fresh = packed_code(F.col("rec"), layout)
    token = F.concat(F.lit("<e_"), fresh.cast("string"), F.lit(">"))
    long_enough = F.coalesce(F.size("indices") >= 5, F.lit(False))
    tokens_too = long_enough & F.coalesce(F.size("tokens") >= 5, F.lit(False))
    changed = (long_enough & ~F.get("indices", F.lit(4)).eqNullSafe(fresh)) | (
        tokens_too & ~F.get("tokens", F.lit(4)).eqNullSafe(token)
    )
    out = {
        "indices": F.when(long_enough, replace_level(F.col("indices"), 5, fresh)).otherwise(F.col("indices")),
        "tokens": F.when(tokens_too, replace_level(F.col("tokens"), 5, token)).otherwise(F.col("tokens")),
    }
    return df.select(*[out[c].alias(c) if c in out else c for c in df.columns], changed.alias("changed"))


def record_codes(df: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``codes`` from ``indices``, ``tokens`` or ``sid`` of each record, whichever is filled first."""
    return df.withColumn("codes", F.coalesce(*[_listed_codes(n, strict) for n in ("indices", "tokens", "sid")]))


def _listed_codes(name: str, strict: bool) -> Column:
    """Codes in one list field of the record, held as numbers or as tokens; null when empty or absent."""
    numbers = field(F.col("rec"), name, as_type="array<int>")
    tokens = field(F.col("rec"), name, as_type="array<string>")
    # a token read as a number is a null inside the list
    numeric = (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(numeric, numbers).when(F.size(tokens) > 0, parse_sid(tokens, strict))


def item_columns(df: DataFrame, strings: list[str], lists: list[str] = (), holder: str | None = None) -> DataFrame:
    """Typed columns of the record's known fields, from the record itself or from a nested object.

    Fields in ``lists`` may hold a list or a single string and become arrays either way.
    """
    rec = F.col("rec")
    at = (holder,) if holder else ()
    out = [field(rec, *at, n).alias(n) for n in strings]
    for n in lists:
        single = field(rec, *at, n)
        # an empty string is an empty list, so that fallbacks still see it as unfilled
        alone = F.when(single == "", F.array().cast("array<string>")).when(single.isNotNull(), F.array(single))
        out.append(F.coalesce(field(rec, *at, n, as_type="array<string>"), alone).alias(n))
    kept = [c for c in df.columns if c not in {*strings, *lists}]
    return df.select(*kept, *out)


def filter_domain(df: DataFrame, name: str, domain: str = "domain") -> DataFrame:
    return df.where(F.col(domain) == name)


def is_video(rec: Column) -> Column:
    """Domain word inside ``json_format`` decides; otherwise the fields the record has; otherwise video."""
    text = field(rec, "json_format")
    inner = F.coalesce(F.try_parse_json(text), field(rec, "json_format", as_type="variant"))
    word = F.try_variant_get(inner, '$["垂域"]', "string")
    keys = F.map_keys(_entries(rec))

    def has_any(names: list[str]) -> Column:
        return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))

    by_keys = F.when(has_any(VIDEO_KEYS), True).when(has_any(STATION_KEYS), False).otherwise(True)
    return F.when(word.isNotNull(), word.isin(*VIDEO_NAMES)).otherwise(by_keys)


def code_validity(df: DataFrame, min_len: int, domains: list[str], domain: str = "domain", indices: str = "indices"):
    """Rows of known domains with long enough code lists, and one row of counters for the rest."""
    known = F.col(domain).isin(*domains)
    enough = F.coalesce(F.size(indices) >= min_len, F.lit(False))
    stats = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(domain).isNull()).alias("missing_domain"),
        F.count_if(known & ~enough).alias("missing_indices"),
    )
    return df.where(known & enough), stats
