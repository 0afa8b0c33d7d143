"""Language identification by prediction by partial matching (PPM) over bytes.

Every language has a context tree: counts of each byte after each context of up to ``ORDER`` bytes, gathered over all
training texts by Spark and then frozen. A byte's code length follows escape method C without exclusion: in a context
with n counts of q distinct bytes, a byte seen c times costs -log2(c / (n + q)); otherwise the escape
-log2(q / (n + q)) is paid and the next shorter context is asked, down to the empty one and then 1/256 for each byte;
an unseen context costs nothing and passes on. A text's code length under a language is the exact sum over its bytes,
and the language with the shortest one is predicted; the score is its share when code lengths per ``TEMPER`` bytes are
turned into weights.

The trees of all languages are folded into one table: a row for each distinct byte sequence of at most ORDER + 1 bytes
that training met, with its code length and its escape in every language, so that scoring looks up each position once
and falls back to shorter sequences only where no language has met the longer one. Every sequence that training met is
kept. A table of more than ``entries`` sequences is divided by the two bytes before the last one: each block holds its
own sequences of three bytes and more and all shorter ones, gives the code lengths of the places with these two bytes,
and is read from the shared folder when its turn comes; the sums over all blocks are exact.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing was learned; ties go
to the first language in order; texts without a language teach nothing; repeated rows count again. Other columns are
ignored. Whole texts are read, in steps of bounded size.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.llm.common import shared_folder
from quantaloom.session import cut

ORDER = 3
ENTRIES = 1_000_000  # sequences in a block for up to four languages
TEMPER = 64
STEP = 1 << 22  # bytes in one pass


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """For each place the number of the ``size`` bytes that end there, zeros before the beginning."""
    out = data.astype(np.uint32)
    for back in range(1, size):
        shifted = np.zeros(len(data), np.uint32)
        shifted[back:] = data[:-back] if back < len(data) else 0
        out |= shifted << np.uint32(8 * back)
    return out


def count_sequences(documents: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """How often each sequence of order + 1 bytes ends a place, by language: lang, code, n.

    Texts are joined by order zero bytes, so that the first bytes of a text have the zero context.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            code, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return code, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                languages = np.array(rows.column(1).to_pylist(), object)
                texts = rows.column(0).to_pylist()
                for name in set(languages):
                    own = (b"\0" * order).join(t for t, x in zip(texts, languages) if x == name)
                    for at in range(0, len(own), STEP):
                        lead = min(at, order)
                        codes = _codes(np.frombuffer(own[at - lead : at + STEP], np.uint8), order + 1)[lead:]
                        codes = np.sort(codes)
                        edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                        parts = held.setdefault(name, [])
                        parts.append((codes[edge], np.diff(np.r_[edge, len(codes)])))
                        if len(parts) > 16:
                            held[name] = [merged(parts)]
        for name, parts in held.items():
            code, n = merged(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(code)), "code": code.astype(np.int64), "n": n})

    known = documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(text) != ""))
    rows = known.select(F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInArrow(count, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Trees:
    """Frozen code lengths of all languages, by order: sorted codes, bits of the last byte, escape of the context.

    A block has ``short``, the (lang, code, n) of all sequences of two bytes, and ``own``, which tells for each pair of
    bytes whether the places that follow it are counted here.
    """

    def __init__(self, languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray, order: int = ORDER, short=None, own: np.ndarray | None = None) -> None:
        self.languages, self.order, self.own = languages, order, own
        k = len(languages)
        long = lang, code, n
        empty = np.full((256, k), 8.0)  # below the empty context every byte costs eight bits
        below = (np.arange(256, dtype=np.uint32), empty)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, order + 2):
            mask = np.uint32((1 << (8 * size)) - 1)
            lang, code, n = short if short is not None and size < 3 else long
            codes, where = np.unique(code.astype(np.uint32) & mask, return_inverse=True)
            counts = np.zeros((len(codes), k))
            np.add.at(counts, (where, lang), n)
            contexts, of = np.unique(codes >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            bits = -np.log2(np.maximum(counts, 1) / np.maximum(total + kinds, 1)[of])
            shorter = below[1][np.searchsorted(below[0], codes & (mask >> np.uint32(8)) if size > 1 else codes)]
            bits = np.where(counts > 0, bits, escape[of] + shorter)
            self.levels.append((codes, bits.astype(np.float32), contexts, escape.astype(np.float32)))
            below = (codes, bits)

    def ready(self) -> "Trees":
        """Index the codes by their first bytes: a dense table gives a row of slots, and the last byte a slot."""
        if not hasattr(self, "dense"):
            self.dense = []
            for size, (codes, _, contexts, _) in enumerate(self.levels, 1):
                row = np.full(1 << (8 * (size - 1)), -1, np.int32)
                row[contexts] = np.arange(len(contexts))
                symbols = np.unique(codes & np.uint32(255))
                column = np.full(256, len(symbols), np.int32)
                column[symbols] = np.arange(len(symbols))
                slot = np.full((len(contexts) + 1, len(symbols) + 1), -1, np.int32)
                slot[row[codes >> np.uint32(8)], column[codes & np.uint32(255)]] = np.arange(len(codes))
                self.dense.append((row, column, slot.ravel(), len(symbols) + 1))
        return self

    @staticmethod
    def _add(out: np.ndarray, doc: np.ndarray, values: np.ndarray, at: np.ndarray, use: np.ndarray) -> None:
        """out[doc] += values[at] where ``use``; doc is sorted, so sums run over stretches."""
        doc, at = doc[use], at[use]
        if not len(doc):
            return
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for k in range(values.shape[1]):
            part = np.ascontiguousarray(values[:, k]).take(at).astype(np.float64)
            out[doc[edge], k] += np.add.reduceat(part, edge)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its share, for texts that are not empty."""
        return choose(self.bits(texts), texts)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of the texts in all languages; in a block, of the places that belong to it."""
        gap = b"\0" * self.order
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        begin = 0
        while begin < len(texts):  # whole texts up to STEP bytes, or one longer text in pieces
            end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), STEP, side="right")))
            if end == begin + 1:
                own = gap + texts[begin]
                for at in range(self.order, len(own), STEP):
                    piece = np.frombuffer(own[at - self.order : at + STEP], np.uint8)
                    total[begin] += self._body(piece, np.array([0]))[0]
            else:
                data = np.frombuffer(b"".join(gap + t for t in texts[begin:end]), np.uint8)
                lengths = size[begin:end] + self.order
                total[begin:end] = self._body(data, np.cumsum(lengths) - lengths)
            begin = end
        return total

    def _body(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code lengths without the gap bytes that lead each text."""
        lead = starts[:, None] + np.arange(self.order)
        keep = np.ones(len(data), bool)
        keep[lead.ravel()] = False
        codes = _codes(data, self.order + 1)[keep]
        lengths = np.diff(np.r_[starts, len(data)]) - self.order
        doc = np.repeat(np.arange(len(starts)), lengths)
        if self.own is not None:
            here = self.own[(codes >> np.uint32(8)) & np.uint32(0xFFFF)]
            codes, doc = codes[here], doc[here]
        return self._bits_of(codes, doc, len(starts))

    def _bits_of(self, codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.languages)))
        for level in range(self.order + 1, 0, -1):
            (row, column, slot, width), (_, values, _, escapes) = self.dense[level - 1], self.levels[level - 1]
            own = codes & np.uint32((1 << (8 * level)) - 1) if level < 4 else codes
            context = row.take(own >> np.uint32(8))
            found = slot.take(np.where(context < 0, len(slot) // width - 1, context) * width + column.take(own & np.uint32(255)))
            hit = found >= 0
            self._add(out, doc, values, found, hit)
            codes, doc, context = codes[~hit], doc[~hit], context[~hit]
            self._add(out, doc, escapes, context, context >= 0)
            if not len(codes):
                return out
        return out + np.bincount(doc, minlength=n)[:, None] * 8.0


def choose(total: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The language with the shortest code length and its share."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    gain = (total - total.min(1, keepdims=True)) / np.maximum(size, 1)[:, None] * TEMPER
    return total.argmin(1), 1 / np.exp2(-np.minimum(gain, 1000)).sum(1)


class Blocks:
    """Trees in blocks, files of the shared folder; one at a time is in memory."""

    def __init__(self, languages: list[str], paths: list[str]) -> None:
        self.languages, self.paths = languages, paths

    def ready(self) -> "Blocks":
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        from pyarrow.fs import FileSystem

        total = np.zeros((len(texts), len(self.languages)))
        for path in self.paths:
            fs, name = FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                total += pickle.loads(f.read()).ready().bits(texts)
        return choose(total, texts)


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, entries: int = ENTRIES, order: int = ORDER) -> Trees | Blocks | None:
    """Trees from all documents with a language that are not held out; None where there are none.

    Counts are summed by Spark and all are kept. The driver builds a block of about ``entries`` sequences at a time
    (fewer with more than four languages).
    """
    counts = cut(count_sequences(documents.where(~held_out(F.col("doc_id"))), "text", "lang", order))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    most = max(1, 4 * entries // max(4, len(languages)))  # sequences times languages stay bounded in a block
    before = F.shiftright("code", 8).bitwiseAND(0xFFFF)  # the two bytes before the last: 65,536 values at most
    sizes = counts.select("code").distinct().groupBy(before.alias("pair")).count().orderBy("pair").toPandas()

    def arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = rows.select("lang", "code", "n").toPandas()
        lang = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
        return lang, got["code"].to_numpy(), got["n"].to_numpy(float)

    if sizes["count"].sum() <= most or order < 2:  # two-byte sequences are never divided
        return Trees(languages, *arrays(counts), order)
    block = (sizes["count"].cumsum() - sizes["count"]) // most
    block_of = np.full(1 << 16, block.iloc[0])  # pairs that training has not met are counted in the first block
    block_of[sizes["pair"]] = block
    short = arrays(counts.groupBy("lang", F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("n").alias("n")))
    folder = shared_folder(documents.sparkSession, "languages")
    paths = []
    for b, pairs in sizes["pair"].groupby(block):
        long = arrays(counts.where(before.between(int(pairs.min()), int(pairs.max()))))
        paths.append(_keep(Trees(languages, *long, order, short, block_of == b), folder))
    return Blocks(languages, paths)


def _keep(trees: Trees, folder: str) -> str:
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"block-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(cloudpickle.dumps(trees))
    return f"{folder}/{name}"


def predict(documents: DataFrame, trees: Trees | Blocks | None, text: str = "text") -> Column:
    """A column (lang_pred, score) for a text column.

    The model travels with its code, so that executors need no copy of this package; a task rebuilds it once.
    """
    shape = "lang_pred string, score double"
    if trees is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trees))

    @F.pandas_udf(shape)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(sent.value).ready()
        for texts in batches:
            best, share = model.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": [model.languages[i] for i in best], "score": share})

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    asked = F.when(letters, F.col(text).cast("binary")).otherwise(F.lit(b""))
    found = predicted(asked)
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(letters, found).otherwise(none)
