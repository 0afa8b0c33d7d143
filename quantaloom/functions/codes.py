"""Codes, tokens and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of a token.
TOKEN_PATTERN = r"^<([a-zA-Z]+)_(-?\d+)>$"


def _letter(i: Column) -> Column:
    return F.char(F.lit(97) + i)


def format_sid(c: Column, style: str = "letters", per_part: int | None = None) -> Column:
    """Codes to tokens: ``<a_7>,<b_1>…``, or ``<a1_7>,<a2_1>,<b1_3>…`` with ``per_part`` levels per subspace."""
    if style == "letters":
        return F.transform(c, lambda x, i: F.concat(F.lit("<"), _letter(i), F.lit("_"), x.cast("string"), F.lit(">")))
    if style == "subspace":
        if not per_part:
            raise ValueError("per_part is needed for subspace tokens")
        return F.transform(
            c,
            lambda x, i: F.concat(
                F.lit("<"),
                _letter((i / per_part).cast("int")),
                (i % per_part + 1).cast("string"),
                F.lit("_"),
                x.cast("string"),
                F.lit(">"),
            ),
        )
    raise ValueError(f"unknown style {style!r}")


def parse_token(t: Column, strict: bool = True) -> Column:
    """Code of one token. Strict raises on any other shape; lenient reads what follows the last ``_``."""
    if strict:
        code = F.regexp_extract(t, TOKEN_PATTERN, 2).try_cast("int")
        return F.when(t.rlike(TOKEN_PATTERN), code).otherwise(
            F.raise_error(F.concat(F.lit("not a level token: "), F.coalesce(t, F.lit("null"))))
        )
    return F.regexp_replace(F.substring_index(t, "_", -1), ".$", "").try_cast("int")


def parse_sid(c: Column, strict: bool = True) -> Column:
    return F.transform(c, lambda t: parse_token(t, strict))


def require_levels(c: Column, levels: int) -> Column:
    """The codes, or a failed job when a row has another number of levels."""
    message = F.concat(F.lit(f"expected {levels} codes, got "), F.coalesce(F.size(c).cast("string"), F.lit("null")))
    return F.when(F.size(c) == levels, c).otherwise(F.raise_error(message))


def prefix(c: Column, level: int) -> Column:
    return F.slice(c, 1, level)


def prefix_text(tokens: Column, level: int) -> Column:
    return F.array_join(F.slice(F.coalesce(tokens, F.array().cast("array<string>")), 1, level), "")


def trim_levels(c: Column, n: int = 4, strict: bool = False) -> Column:
    """First ``n`` levels; null passes through unless strict, which also rejects shorter lists."""
    if not strict:
        return F.slice(c, 1, n)
    return F.when(F.size(c) >= n, F.slice(c, 1, n)).otherwise(
        F.raise_error(F.lit(f"codes missing or shorter than {n}"))
    )


def replace_level(c: Column, level: int, value: Column) -> Column:
    """Replace the code at a 1-based level; shorter arrays stay as they are."""
    return F.when(F.size(c) >= level, F.transform(c, lambda x, i: F.when(i == level - 1, value).otherwise(x))).otherwise(c)


def unpack_bits(c: Column, nbits: int | list[int], levels: int | None = None) -> Column:
    """Little-endian bit fields of one packed integer as an array of codes."""
    widths = [nbits] * int(levels) if isinstance(nbits, int) else list(nbits)
    packed, shift, out = c.cast("bigint"), 0, []
    for width in widths:
        out.append(F.shiftrightunsigned(packed, shift).bitwiseAND((1 << width) - 1).cast("int"))
        shift += width
    return F.array(*out)
