"""Quality rules: lines that many documents of a host share are removed, and documents that lose too much are rejected.

A line is hashed after A-Z went to lower case, digits to 0 and runs of white space to one space. For each host and line
the distinct documents are counted (copies of one text count once). A line goes where more than ``least`` documents and
more than ``share`` of the host's documents have it: a rule that reads the same at any size of a host. A document is
depleted, and rejected, if more than ``lost`` of its words were in such lines.

The base rules look at one document: too few words, or too many words in repeated windows of three.

Pre-aggregation comes before each shuffle, and the joins deal a hot host, line or group of copies to many tasks.

Defined results: null and empty texts have no words and fail the base rules; a null host is a host of its own; repeated
rows are copies, each with the same verdict; lines without words are never counted or removed; an empty table
gives no rows; other columns are ignored, or kept by ``clean``. A text's words are held in memory at once. Lines and
texts are told apart by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.llm.common import fresh, salted_join, slices
from quantaloom.session import cut

LEAST_WORDS, REPEATED = 50, 50  # base rules: words; percent of words in repeated windows
LEAST_DOCUMENTS, SHARE, LOST = 10, 0.01, 0.5
SYMBOLS = b"#*$%&|<>"
FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(split: list[list[bytes]]) -> np.ndarray:
    """For each text, its words in windows of three words that it has twice or more."""
    n = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array(chain.from_iterable(split), pa.large_binary()).dictionary_encode()
    word, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1
    if len(word) < 3:
        return np.zeros(len(split), np.int64)
    text = np.repeat(np.arange(len(split)), n)
    at = np.flatnonzero(text[2:] == text[:-2])
    key, held = text[at], float(len(split))
    for j in range(3):
        if held * size >= 2.0**62:  # number the windows so far anew, so that the next word fits
            key = np.unique(key, return_inverse=True)[1]
            held = float(len(at) + 1)
        key, held = key * size + word[at + j], held * size
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    start = at[times[which] > 1]
    inside = np.zeros(len(word) + 2, bool)
    for j in range(3):
        inside[start + j] = True
    return np.bincount(text[inside[: len(word)]], minlength=len(split))


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(FOLD).split())


def _lines(data: bytes) -> tuple[int, dict[bytes, int]]:
    """Lines equal to an earlier one, and the words of each distinct normalised line."""
    seen, again, words = set(), 0, {}
    for line in data.split(b"\n"):
        plain = normalised(line)
        if plain:
            again += line in seen
            seen.add(line)
            digest = md5(plain).digest()
            words[digest] = words.get(digest, 0) + plain.count(b" ") + 1
    return again, words


def measured(documents: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per document: doc_id, host (a key that is never null), digest of the text, the base facts, and its lines:
    hash and words of each distinct one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = rows.column("text").to_pylist()
                split = [t.split() for t in texts]
                repeated = _repeated(split)
                facts, line, in_line = [], [], []
                for t, words in zip(texts, split):
                    again, lines = _lines(t)
                    points = len(t.decode("utf-8", "replace"))
                    symbols = sum(t.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
                    facts.append((len(words), points - len(t) + sum(map(len, words)), symbols, again))
                    line.append(list(lines))
                    in_line.append(list(lines.values()))
                numbers = np.column_stack([np.array(facts, np.int64), repeated])
                columns = [pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(len(FACTS))]
                digest = pa.array([md5(t).digest() for t in texts], pa.binary())
                own = [digest, *columns, pa.array(line, pa.list_(pa.binary())), pa.array(in_line, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("host"), *own], ["doc_id", "host", "digest", *FACTS, "lines", "in_line"])

    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    rows = documents.select(F.col(doc_id).alias("doc_id"), _host(host).alias("host"), body)
    kind = rows.schema["doc_id"].dataType.simpleString()
    facts = ", ".join(f"{c} long" for c in FACTS)
    return rows.mapInArrow(run, f"doc_id {kind}, host string, digest binary, {facts}, lines array<binary>, in_line array<long>")


def _host(host: str):
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def shared_lines(measures: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The lines above the limits (host, line, documents), and all distinct lines (host, line, digest, words)."""
    one = F.explode(F.arrays_zip("lines", "in_line")).alias("l")
    lines = measures.select("host", "digest", one).select("host", "digest", F.col("l.lines").alias("line"), F.col("l.in_line").alias("words"))
    lines = cut(lines.groupBy("host", "line", "digest").agg(F.max("words").alias("words")))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > least)
    texts = measures.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    judged = salted_join(often, texts, ["host"], F.col("line")).where(F.col("documents") > F.col("of_host") * share)
    return judged.select("host", "line", "documents"), lines


def verdicts(measures: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """For each text (host, digest) with lines above the limits: removed_words and removed_lines (hashes)."""
    often, lines = shared_lines(measures, least, share)
    hits = salted_join(lines, often.select("host", "line"), ["host", "line"], F.col("digest"))
    return hits.groupBy("host", "digest").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))


def judge(
    documents: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    least: int = LEAST_DOCUMENTS,
    share: float = SHARE,
    lost: float = LOST,
) -> DataFrame:
    """Per document: doc_id, host (as a key), digest, the base facts, base_failed, removed_words, removed_lines, kept."""
    measures = cut(measured(documents, doc_id, host, text))
    facts, gone = measures.drop("lines", "in_line"), verdicts(measures, least, share)
    rows = salted_join(facts, gone, ["host", "digest"], F.monotonically_increasing_id(), "left")
    rows = rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    kept = ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * lost)
    rows = rows.withColumn("base_failed", failed).withColumn("kept", kept)
    return rows.select("doc_id", "host", "digest", *FACTS, "base_failed", "removed_words", "removed_lines", "kept")


def clean(documents: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The documents that are kept, all columns, without the lines above the limits."""
    taken = documents.columns
    names = {c: fresh(taken, f"line_{c}") for c in ("host", "digest", "gone")}
    # a text has one verdict on a host
    judged = judge(documents, doc_id, host, text, **limits).where("kept").groupBy("host", "digest").agg(F.first("removed_lines").alias("gone"))
    judged = judged.select(*[F.col(c).alias(names[c]) for c in judged.columns])
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    keyed = documents.withColumn(names["host"], _host(host)).withColumn(names["digest"], digest)
    joined = salted_join(keyed, judged, [names["host"], names["digest"]], F.monotonically_increasing_id()).select(*taken, names["gone"])
    place = taken.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, lines in zip(batch.column(place), batch.column(len(taken))):
                t, without = value.as_py(), set(lines.as_py() or ())
                if t is not None and without:
                    t = "\n".join(x for x in t.split("\n") if md5(normalised(x.encode())).digest() not in without)
                texts.append(t)
            columns = [*batch.columns[: len(taken)]]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, taken)

    return joined.mapInArrow(run, documents.schema)
