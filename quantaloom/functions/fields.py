"""Record fields: fallback chains over semi-structured records, metadata normalisation and packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantaloom.functions.text import STATION_NAMES, VIDEO_NAMES, let, strip

# Layout of the packed metadata code.
PACK_YEAR_ORIGIN = 2035
PACK_MAX_BUCKET = 125
PACK_MAX = 511
REFERENCE_YEAR = 2026
UNKNOWN_YEAR = "未知"
MISSING_DOMAIN = "__missing__"
SALE_KEYS = ["saletype", "sale_type", "pay_type", "paytype"]


def json_path(*keys: str) -> str:
    """Variant path of nested object keys."""
    for key in keys:
        if '"' in key or "\\" in key:
            raise ValueError(f"key cannot be addressed: {key!r}")
    return "$" + "".join(f'["{k}"]' for k in keys)


def get_path(v: Column, path: str, as_type: str = "string") -> Column:
    """Value at a dotted path; null when a hop is absent, null or not an object."""
    return F.try_variant_get(v, json_path(*[k for k in path.split(".") if k]), as_type)


def has_key(v: Column, *keys: str) -> Column:
    """True when the key exists, even with a JSON null."""
    return F.try_variant_get(v, json_path(*keys), "variant").isNotNull()


def _filled(v: Column) -> Column:
    """True for a value that is neither null nor empty: no zero, false, blank string, empty list or object."""
    text = F.try_variant_get(v, "$", "string")
    empty = F.when(F.schema_of_variant(v) == "STRING", text == "").otherwise(
        text.isin("false", "[]", "{}") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    )
    return ~F.is_variant_null(v) & ~empty


def first_present(
    v: Column, keys: list[str], rule: str = "presence", holders: tuple[str, ...] = ("", "meta")
) -> Column:
    """First of ``keys`` inside each holder object in turn, as a VARIANT; ``""`` is the record itself.

    ``presence`` and ``presence_default`` stop at the first existing key even when its value is null
    (the caller's default then applies); ``nonnull`` skips nulls; ``truthy`` skips empty values too.
    """
    paths = [(h, k) if h else (k,) for h in holders for k in keys]
    found = [F.try_variant_get(v, json_path(*p), "variant") for p in paths]
    if rule in ("presence", "presence_default"):
        return let(F.coalesce(*found), lambda x: F.when(~F.is_variant_null(x), x))
    if rule == "nonnull":
        kept = F.filter(F.array(*found), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    elif rule == "truthy":
        kept = F.filter(F.array(*found), lambda x: x.isNotNull() & _filled(x))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.try_element_at(kept, F.lit(1))


def domain_of(v: Column, key: str = "domain") -> Column:
    """Domain of a VARIANT record, keeping unknown names; ``__missing__`` when there is none."""
    inner = F.try_parse_json(F.try_variant_get(v, json_path("json_format"), "string"))
    named = F.nullif(F.try_variant_get(inner, json_path(key), "string"), F.lit(""))
    found = F.coalesce(
        F.try_variant_get(v, json_path(key), "string"),
        F.try_variant_get(v, json_path("meta", key), "string"),
        named,
        F.try_variant_get(inner, json_path("垂域"), "string"),
    )
    return let(
        found,
        lambda d: F.when(d.isin(*VIDEO_NAMES), "video")
        .when(d.isin(*STATION_NAMES), "station")
        .otherwise(F.coalesce(d, F.lit(MISSING_DOMAIN))),
    )


def _whole(c: Column) -> Column:
    """Integer of a string, by the rules of a plain integer literal with outer blanks allowed."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def norm_sale(c: Column, variant: str = "pack", numeric: bool = False) -> Column:
    """Sale type as INT.

    ``pack`` and ``writer``: FREE=1, PAY=2, digit strings as they are; a numeric input is truncated for
    ``pack`` and limited to 0, 1, 2 for ``writer``. ``embed``: PAY=1, FREE=2, any whole number as it is.
    """
    zero = F.lit(0).cast("bigint")
    if numeric:
        n = F.coalesce(c.try_cast("bigint"), zero)
        return F.when(n.isin(0, 1, 2), n).otherwise(zero) if variant == "writer" else n
    s = F.upper(strip(c))
    if variant == "embed":
        return F.when(s == "PAY", 1).when(s == "FREE", 2).otherwise(F.coalesce(_whole(c), zero)).cast("bigint")
    digits = F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))
    return F.when(s == "FREE", 1).when(s == "PAY", 2).otherwise(F.coalesce(digits, zero)).cast("bigint")


def _by_kind(v: Column, of_string: Callable[[Column], Column], of_number: Callable[[Column], Column]) -> Column:
    """Apply the rule for strings or the one for numbers to a VARIANT value; null counts as 0."""
    return let(
        v,
        lambda x: F.when(x.isNull() | F.is_variant_null(x), F.lit(0).cast("bigint"))
        .when(F.schema_of_variant(x) == "STRING", of_string(F.try_variant_get(x, "$", "string")))
        .otherwise(of_number(F.try_variant_get(x, "$", "double"))),
    )


def sale_of_variant(v: Column, variant: str = "pack") -> Column:
    """``norm_sale`` of a VARIANT value, which knows whether it is a string or a number."""
    return _by_kind(v, lambda s: norm_sale(s, variant), lambda n: norm_sale(n, variant, numeric=True))


def norm_year(c: Column, numeric: bool = False) -> Column:
    return F.coalesce(c.try_cast("bigint") if numeric else _whole(c), F.lit(0).cast("bigint"))


def year_of_variant(v: Column) -> Column:
    return _by_kind(v, norm_year, lambda n: norm_year(n, numeric=True))


def years_ago(c: Column, ref_year: int = REFERENCE_YEAR) -> Column:
    """Age in years, never negative; 0 when the year is missing or no number."""
    return F.coalesce(F.greatest(F.lit(0).cast("bigint"), F.lit(ref_year).cast("bigint") - _whole(c)), F.lit(0))


def pack_hardcode(sale: Column, year: Column, layout: str = "v9") -> Column:
    """Sale type and year in one small integer.

    ``v9``: 7-bit year bucket above 2-bit sale type; ``legacy_a``: 6-bit clipped year above sale type;
    ``legacy_b``: sale type above 6-bit clipped year.
    """
    sale = F.coalesce(sale.cast("bigint"), F.lit(0))
    year = F.coalesce(year.cast("bigint"), F.lit(0))

    def clip(c: Column, hi: int) -> Column:
        return F.least(F.greatest(c, F.lit(0)), F.lit(hi))

    if layout == "v9":
        bucket = F.lit(PACK_YEAR_ORIGIN) - year
        bucket = F.when(bucket.between(0, PACK_MAX_BUCKET), bucket).otherwise(F.lit(0))
        packed = F.shiftleft(bucket.bitwiseAND(127), 2).bitwiseOR(clip(sale, 3))
        return F.least(packed, F.lit(PACK_MAX)).cast("int")
    if layout == "legacy_a":
        return F.shiftleft(clip(year, 63), 2).bitwiseOR(clip(sale, 2)).cast("int")
    if layout == "legacy_b":
        return F.shiftleft(clip(sale, 3), 6).bitwiseOR(clip(year, 63)).cast("int")
    raise ValueError(f"unknown layout {layout!r}")


def unpack_hardcode(c: Column) -> Column:
    """``struct(sale, bucket, year)`` of a ``v9`` code; bucket 0 also stands for unknown years."""
    bucket = F.shiftright(c, 2).bitwiseAND(127)
    return F.struct(
        c.bitwiseAND(3).cast("int").alias("sale"),
        bucket.cast("int").alias("bucket"),
        (F.lit(PACK_YEAR_ORIGIN) - bucket).cast("int").alias("year"),
    )


def packed_code(v: Column, layout: str = "v9") -> Column:
    """Packed metadata code of a VARIANT record."""
    if layout == "legacy_b":
        sale = first_present(v, ["saletype"], holders=("", "meta", "meta_json"))
        year = first_present(v, ["publish_year"], holders=("", "meta", "meta_json"))
        return pack_hardcode(year_of_variant(sale), year_of_variant(year), layout)
    sale = first_present(v, ["saletype"] if layout == "legacy_a" else SALE_KEYS, "presence_default")
    year = first_present(v, ["publish_year"], "presence_default")
    return pack_hardcode(sale_of_variant(sale), year_of_variant(year), layout)
