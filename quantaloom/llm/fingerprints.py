"""Document fingerprints by winnowing, in column functions only.

A text in lower case is cut into tokens: single ideographs, kana and Thai letters, and other runs of at most 24
non-space characters. Hashes of ``K`` consecutive tokens roll over the text (each is made of the hashes of its two
halves, so a step costs one combination per position). In every window of ``W`` consecutive hashes the least is
chosen, of equal ones the rightmost, and kept with its position. A run of W + K - 1 equal tokens in two texts
therefore always gives a common hash, and a match shorter than K tokens never does.

A hash and its position travel in one long: 36 bits of hash above 28 bits that fall with the position, so the
least long is the least hash and, among equals, the rightmost.

Defined results: a null text counts as empty; an empty text (or one of white space) has no hashes, and two such
texts have likeness 1; a text with fewer than K tokens is one gram, with fewer than W grams one window. Equal
texts have equal fingerprints. Rows are handled one by one, so repeated rows get the same result each; the
neighbour functions order equal doc_ids by text and null doc_ids last. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.llm.common import let, pairwise

K = 4  # tokens in a gram
W = 4  # grams in a window
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
TOKEN = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,24}}"
POSITION_BITS = 28
LAST_POSITION = (1 << POSITION_BITS) - 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _power_of_two(value: int, name: str) -> int:
    if value < 1 or value & (value - 1):
        raise ValueError(f"{name} must be a power of two, not {value}")
    return value


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen grams of a text in the order of their positions, as packed longs."""
    k, w = _power_of_two(k, "k"), _power_of_two(w, "w")

    def grams(hashes: Column, size: int) -> Column:
        if size < k:
            return let(pairwise(hashes, size, F.xxhash64), lambda h: grams(h, size * 2))
        whole = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - F.lit(k - 1), F.least(F.size(hashes), F.lit(1))))
        packed = F.transform(
            whole,
            lambda h, i: h.bitwiseAND(F.lit(~LAST_POSITION)).bitwiseOR((F.lit(LAST_POSITION) - i).cast("long")),
        )
        return let(packed, lambda p: least(p, 1))

    def least(values: Column, size: int) -> Column:
        if size < w:
            return let(pairwise(values, size, lambda a, b: F.least(a, b)), lambda v: least(v, size * 2))
        n = F.size(values)
        return F.array_distinct(F.slice(values, F.lit(1), F.greatest(n - F.lit(w - 1), F.least(n, F.lit(1)))))

    return let(F.transform(tokens(text), lambda t: F.xxhash64(t)), lambda h: grams(h, 1))


def hashes(packed: Column) -> Column:
    return F.transform(packed, lambda p: F.shiftright(p, POSITION_BITS))


def positions(packed: Column) -> Column:
    return F.transform(packed, lambda p: F.lit(LAST_POSITION) - p.bitwiseAND(F.lit(LAST_POSITION)))


def digest(packed: Column) -> Column:
    """One string for the whole fingerprint: hashes and positions."""
    return F.sha2(F.array_join(packed.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash lists; 1 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: doc_id, grams (array of hash and position)."""
    packed = documents.select("doc_id", winnow(F.col("text"), k, w).alias("packed"))
    pairs = F.transform(
        "packed",
        lambda p: F.struct(
            F.shiftright(p, POSITION_BITS).alias("hash"),
            (F.lit(LAST_POSITION) - p.bitwiseAND(F.lit(LAST_POSITION))).cast("int").alias("position"),
        ),
    )
    return packed.select("doc_id", pairs.alias("grams"))


# -- the next document in descending order of doc_id ------------------------------------------------


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"cast({v} AS BIGINT)" for v in values) + ")")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below an id, found in two steps of about sqrt(len) comparisons; null ids: -1."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(_longs(bounds[::step]), lambda b: b <= doc_id))  # bounds[0] is the least id
    fine = F.filter(F.slice(_longs(bounds), (coarse - 1) * step + 1, F.lit(step)), lambda b: b <= doc_id)
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise((coarse - 1) * step + F.size(fine) - 1)


def with_neighbours(documents: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, bucket, guest) so that each row and its successor share a bucket, and their window.

    Ids are cut into ranges of about equal row counts. The first row of a range (in descending order) is also
    sent, as a guest, to the range before it, and the very first to the last range; texts move once. Only the
    bounds and one id per range reach the driver.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(buckets)]
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 100_000).alias("b")).first()
    bounds = sorted({found["least"], *(b for b in found["b"] or [] if b >= found["least"])}) if found["least"] is not None else []
    placed = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    heads = {r["bucket"]: r["head"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)  # ascending ids; -1 holds the null ids, which come last
    host = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    width = len(bounds) + 2
    head_of = _longs([heads.get(b) or 0 for b in range(-1, width)])
    host_of = _longs([host.get(b, 0) for b in range(-1, width)])
    at = F.col("bucket") + 1
    is_head = F.col("doc_id").isNull() | (F.col("doc_id") == F.get(head_of, at))
    homes = F.array(F.struct(F.col("bucket").cast("long").alias("bucket"), F.lit(False).alias("guest")))
    visits = F.array(F.struct(F.get(host_of, at).alias("bucket"), F.lit(True).alias("guest")))
    rows = placed.select("doc_id", "text", F.explode(F.when(is_head, F.concat(homes, visits)).otherwise(homes)).alias("p"))
    rows = rows.select("doc_id", "text", "p.bucket", "p.guest")
    window = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return rows, window


def edited_fingerprints(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each text beside a copy whose last third is replaced by the start of the next text.

    Returns doc_id, n_chars, edited, packed, edited_packed, near_edited, near_next.
    """
    rows, window = with_neighbours(documents)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.lead("text").over(window), F.lit(1), third))
    rows = rows.select("doc_id", "text", "bucket", "guest", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("packed", winnow(F.col("text"), k, w)).withColumn("own", hashes(F.col("packed")))
    rows = rows.withColumn("next", F.lead("own").over(window)).where(~F.col("guest"))
    rows = rows.withColumn("edited_packed", winnow(F.col("edited"), k, w)).withColumn("edited_own", hashes(F.col("edited_packed")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "packed",
        "edited_packed",
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
