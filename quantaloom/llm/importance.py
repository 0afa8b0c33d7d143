"""Importance resampling: documents are drawn in proportion to how much likelier the target makes their words.

Features are the runs of 1 to ``n`` consecutive words, hashed to ``buckets``. Raw and target texts are counted once, in
arrays of one number per bucket, and a document's weight is the floored mean of its features' log-likelihood gains in
thousandths. Adding Gumbel noise from a hash of doc_id turns "the highest scores" into a weighted sample without
replacement, the same on every run.

The k highest scores are not found by a sort. Random rows of the open interval become pivot keys, one pass counts
exactly how many keys lie before and at each of them, and the interval shrinks to the gap that holds the k-th key. Only
the winners are sorted, over range partitions, and ranked.

Defined results: a null or empty text and one without words has no features, weight 0, and is never drawn while
``least_words`` is above 0; a null doc_id is hashed as an empty text and ties go to it last; of repeated rows each is a
row of its own, and ties that doc_id doesn't settle go by the order in which the rows were scored and stored; an empty
table gives no rows; an empty target leaves the buckets' smoothed weights. Texts of any length are cut into words a block at a time.
A column of ``documents`` named like a result (n_features, weight, score, rank) is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantaloom.llm.common import fresh
from quantaloom.operators.ranking import rank_within
from quantaloom.session import cut

BUCKETS, RUN, LEAST_WORDS, SEED = 10_000, 2, 20, 7
PIVOTS = 24
STEP = 1 << 20  # bytes of a text that are cut into words at a time
RESULT = ["n_features", "weight", "score", "rank"]
#: A-Z in lower case; all other ASCII but digits and letters parts words
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_buckets(text: bytes | None, n: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of the text: how many words begin in it, and the buckets of the runs that end in it.

    The checksum of a run continues that of the run without its last word.
    """
    data, at, carry = (text or b"").translate(WORD_BYTES), 0, []
    while at < len(data):
        end = data.find(b" ", at + STEP) + 1 or len(data)
        own = data[at:end].split()
        words, at, found = carry + own, end, []
        sums = list(map(crc32, words))
        for k in range(1, n + 1):
            if k > 1:
                sums = list(map(crc32, words[k - 1 :], map(crc32, repeat(b" "), sums)))
            found.append(np.array(sums[max(0, len(carry) - k + 1) :], np.uint32))
        carry = words[len(words) - n + 1 :] if n > 1 else []
        yield len(own), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def count_features(texts: DataFrame, text: str = "text", n: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, at in feature_buckets(value.as_py(), n, buckets):
                    total += np.bincount(at, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "n": total[seen]})

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets at most
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, the log of its smoothed share of the target over that of the raw texts, in floored thousandths."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    ratio = [float(t + 1) * s_all / (float(s + 1) * t_all) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise in floored thousandths, from a hash of the key."""
    h = int(sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    documents: DataFrame, gain: np.ndarray, columns: list[str], doc_id: str = "doc_id", text: str = "text", seed: int = SEED, n: int = RUN
) -> DataFrame:
    """``columns`` of the documents, n_features, weight, score, and the number of words in a column of its own, the last."""
    kept = [c for c in columns if c not in RESULT]
    words, body, key = fresh(kept, "n_words"), fresh(kept, "body"), fresh(kept, "key")
    rows = documents.select(
        *kept, F.col(text).cast("binary").alias(body), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias(key)
    )
    schema = T.StructType([*rows.select(*kept).schema, *[T.StructField(c, T.LongType()) for c in (*RESULT[:3], words)]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, name in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                n_words = size = total = 0
                for own, at in feature_buckets(value.as_py(), n, len(gain)):
                    n_words, size, total = n_words + own, size + len(at), total + int(gain[at].sum())
                weight = total // size if size else 0
                out.append((size, weight, weight + noise(name.as_py(), seed), n_words))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            columns_ = [pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns_], schema.names)

    return rows.mapInArrow(score, schema)


def _literal(row: T.Row, kinds: T.StructType) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kinds])


def kth_key(rows: DataFrame, order: list[Column], k: int, seed: int = SEED, pivots: int = PIVOTS) -> Column:
    """The k-th smallest (from 1) of the rows' composite keys ``order``, as a literal. ``rows`` must have k rows or more.

    Each round draws random keys of the open interval and counts all rows of it before and at each of them.
    """
    keys = rows.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("key"))
    kinds, open_rows, left, turn = keys.schema["key"].dataType, keys, k, 0
    while True:
        draw = F.xxhash64("key", F.lit(seed * 1_000_003 + turn))
        drawn = [_literal(r["key"], kinds) for r in open_rows.orderBy(draw).limit(pivots).collect()]
        counts = [c for p in drawn for c in (F.count_if(F.col("key") < p), F.count_if(F.col("key") == p))]
        n = list(open_rows.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first())
        low, high, below = None, None, 0
        for before, at, pivot in sorted(zip(n[::2], n[1::2], drawn), key=lambda x: x[:2]):
            if left <= before:
                high = pivot
                break
            if left <= before + at:
                return pivot
            low, below = pivot, before + at
        left, turn = left - below, turn + 1
        if low is not None:
            open_rows = open_rows.where(F.col("key") > low)
        if high is not None:
            open_rows = open_rows.where(F.col("key") < high)


def draw(
    documents: DataFrame,
    target: DataFrame,
    percent: int = 25,
    columns: list[str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document: ``columns`` (all, if not given), n_features, weight, score and rank.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, those with the highest
    scores, ties to the smaller doc_id; rank counts them from 1 and is null for the others.
    """
    gain = gains(count_features(documents, text, n, buckets), count_features(target, text, n, buckets))
    rows = scored(documents, gain, columns or documents.columns, doc_id, text, seed, n)
    words = rows.columns[-1]
    tie, own, null = (fresh([*rows.columns, "rank"], c) for c in ("tie", "own", "null"))
    if doc_id not in rows.columns:
        raise ValueError(f"columns must hold {doc_id}")
    # stored, so that a row keeps its place among equal ones
    rows = cut(rows.withColumn(tie, F.monotonically_increasing_id()).withColumn(own, -F.col("score")).withColumn(null, F.col(doc_id).isNull()))
    order = [F.col(c) for c in (own, null, doc_id, tie)]
    result = [c for c in rows.columns if c not in (words, tie, own, null)]
    able = rows.where(F.col(words) >= least_words)
    k = able.count() * percent // 100
    if k == 0:
        return rows.select(*result, F.lit(None).cast("long").alias("rank"))
    last = kth_key(able, order, k, seed)
    wins = (F.col(words) >= least_words) & (F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]) <= last)
    winners = rank_within(rows.where(wins), [], [c.asc() for c in order], "rank")
    return winners.select(*result, "rank").unionByName(rows.where(~wins).select(*result, F.lit(None).cast("long").alias("rank")))
