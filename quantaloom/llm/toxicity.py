"""Toxicity: a convolutional classifier of words, trained in numpy, applied as a vectorised column function.

Words (runs of bytes other than ASCII punctuation and white space, A-Z in lower case) are hashed twice into tables of
``BUCKETS`` vectors, and a word's embedding is the sum of its two vectors, so that a word that shares one bucket with
another still differs from it. Filters of ``WIDTHS`` words slide over a text, each keeps its largest response, and a
logistic layer reads these. Words that training never met have the zero vector, and so no effect.

Training takes every labelled id that is not held out, and one text of each (that with the least digest, if an id has
several). The ids are dealt by hash to workers, about ``TEXTS`` to each (beyond ``WORKERS`` of them, to that many); in a
round each worker passes over its texts from the common model, a chunk at a time, and what the workers changed is
averaged, a bucket's vector over those that met it. The first component of a bucket starts at the log odds of all
texts with it. One fifth of the ids is kept back to calibrate a threshold for each language, from counts of all their
responses in steps of 1 / ``STEPS``. Which language a text is scored as comes from
its own bytes, never from a column: training learns how often each letter's bytes occur in the texts of each language,
and a text goes to the language that makes its letters likeliest. A score is the sigmoid of the distance to the group's threshold, so 0.5 is
the calibrated threshold everywhere; a language with fewer than ``MIN_CALIBRATION`` examples of either label uses the
common one. Whole texts are scored, a bounded number of texts at a time.

Defined results: null and empty texts have no words and all get one score; labels that are null or without a document
are ignored, of repeated labels the larger counts; repeated rows get the same score each and change no model; null languages teach no
profile, and texts without letters use the common threshold; without labels of both kinds every
score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.llm.common import gathered, release, slices
from quantaloom.session import cut

BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 4  # of each width
TEXTS, WORKERS = 4_000, 64
BROADCAST_IDS = 1 << 22
SEEN, ROUNDS = 24_000, 4  # few texts are passed over 20 times, until so many are seen; many texts in so many rounds
BATCH, CHUNK, BLOCK = 64, 256, 1 << 14
STEPS, HIGHEST = 256, 64  # the responses that calibration counts
MIN_CALIBRATION = 10
PAD = max(WIDTHS) - 1
# bytes that a language profile counts: letters in lower case and all bytes beyond ASCII
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
SEPARATE = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b < 33 or b == 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _letters(texts: list[str]) -> np.ndarray:
    """How often each byte value occurs among the letters of each text."""
    out = np.zeros((len(texts), 256))
    for row, text in zip(out, texts):
        held = text.encode("utf-8", "surrogatepass").translate(LOWER, NO_LETTERS)
        row[:] = np.bincount(np.frombuffer(held, np.uint8), minlength=256)
    return out


def _word_index(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; the words of all texts as numbers of these, PAD paddings after each (one more after an empty
    text); starts; word counts."""
    split = [t.encode("utf-8", "surrogatepass").translate(SEPARATE).split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array(chain.from_iterable(split), pa.large_binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    size = np.maximum(n, 1) + PAD
    starts = np.cumsum(size) - size
    flat = np.full(int(size.sum()), len(words), np.int64)
    flat[np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n)] = coded.indices.to_numpy(zero_copy_only=False)
    return words, flat, starts, n


def _buckets(words: list[bytes]) -> np.ndarray:
    first = np.fromiter((crc32(w) for w in words), np.int64, len(words))
    second = np.fromiter((crc32(w, 0x5BD1E995) for w in words), np.int64, len(words))
    return np.stack([first % BUCKETS, (second >> 7) % BUCKETS + BUCKETS], 1)


class Model:
    """Embeddings of the buckets that training met, filters, the logistic layer and thresholds."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.columns = [(w, j) for w in WIDTHS for j in range(w)]
        self.table = np.zeros((2 * BUCKETS, DIM), np.float32)
        self.filters = rng.normal(0, 0.5, (DIM, len(self.columns) * FILTERS)).astype(np.float32)
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.float32(-2.0)
        self.thresholds: dict[str, float] = {}
        self.languages: list[str] = []
        self.profiles = np.zeros((0, 256))
        self.trained = False

    def _embed(self, buckets: np.ndarray) -> np.ndarray:
        return np.concatenate([self.table[buckets].sum(1), np.zeros((1, DIM), np.float32)])

    def _responses(self, embedded: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Filter responses for a window that begins at each place."""
        tables = (embedded @ self.filters).reshape(len(embedded), len(self.columns), FILTERS)
        out = np.empty((len(WIDTHS), len(flat), FILTERS), np.float32)
        padded = np.concatenate([flat, np.full(PAD, len(embedded) - 1)])
        for c, (w, j) in enumerate(self.columns):
            part = np.ascontiguousarray(tables[:, c]).take(padded[j : j + len(flat)], axis=0, mode="clip")
            if j:
                out[WIDTHS.index(w)] += part
            else:
                out[WIDTHS.index(w)] = part
        return out

    def _pooled(self, embedded: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The largest responses between each pair of edges, rectified."""
        responses = self._responses(embedded, flat)
        most = [np.maximum.reduceat(np.concatenate([r, r[-1:]]), edges)[::2] for r in responses]
        return np.maximum(np.concatenate(most, 1) + self.bias, 0)

    def logits(self, texts: list[str]) -> np.ndarray:
        words, flat, starts, n = _word_index(texts)
        edges = np.stack([starts, starts + np.maximum(n, 1)], 1).ravel()
        return self._pooled(self._embed(_buckets(words)), flat, edges) @ self.out + self.offset

    def start(self, hits: np.ndarray, seed: int = 7) -> None:
        """Vectors for the buckets of the training texts; ``hits`` are the clean and the toxic texts with each, and in
        all (the last row). The first component starts at the shrunk log odds."""
        met = np.flatnonzero(hits[:-1].sum(1))
        self.table[met] = np.random.default_rng(seed).normal(0, 0.02, (len(met), DIM))
        prior, weight = max(hits[-1, 1] / hits[-1].sum(), 1e-6), 20.0
        odds = np.log((hits[met, 1] + weight * prior) / ((hits[met].sum(1) + weight) * prior))
        self.table[met, 0] += np.clip(odds, -3, 3) / 4
        self.trained = True

    def epoch(self, chunks: Iterable[tuple[list[str], np.ndarray]], state: dict, rng: np.random.Generator) -> np.ndarray:
        """Steps over the texts and labels, chunk by chunk; how many steps met each bucket, and the texts (last)."""
        met = np.zeros(2 * BUCKETS + 1)
        for texts, labels in chunks:
            words, flat, starts, n = _word_index(texts)
            buckets = np.concatenate([_buckets(words), np.zeros((1, 2), np.int64)])
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                met[self._step(order[b : b + BATCH], flat, starts, n, buckets, labels, state)] += 1
            met[-1] += len(texts)
        return met

    def _step(self, docs, flat, starts, n, buckets, labels, state, rate: float = 0.1) -> np.ndarray:
        size = np.maximum(n[docs], 1) + PAD
        at = np.cumsum(size) - size
        places = np.concatenate([np.arange(starts[d], starts[d] + s) for d, s in zip(docs, size)])
        places = np.minimum(places, len(flat) - 1)
        used, own = np.unique(flat[places], return_inverse=True)
        pad = len(buckets) - 1
        vectors = np.where((used == pad)[:, None], 0, self.table[buckets[used]].sum(1)).astype(np.float32)
        embedded = np.concatenate([vectors, np.zeros((1, DIM), np.float32)])
        responses = np.concatenate(self._responses(embedded, own), 1) + self.bias
        best = np.stack([responses[a : a + s - PAD].argmax(0) + a for a, s in zip(at, size)])
        pooled = np.maximum(responses[best, np.arange(responses.shape[1])], 0)
        miss = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.offset, -30, 30))) - labels[docs]
        miss = (miss / len(docs)).astype(np.float32)
        back = miss[:, None] * self.out * (pooled > 0)
        grads = {"out": miss @ pooled, "bias": back.sum(0), "filters": np.zeros_like(self.filters)}
        rows, steps = [], []
        for c, (w, j) in enumerate(self.columns):
            k = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
            cols = slice(c * FILTERS, (c + 1) * FILTERS)
            row, g = own[best[:, k] + j], back[:, k]
            grads["filters"][:, cols] = np.einsum("bfd,bf->df", embedded[row], g)
            rows.append(row.ravel())
            steps.append((g[:, :, None] * self.filters[:, cols].T[None]).reshape(-1, DIM))
        row, step = np.concatenate(rows), np.concatenate(steps)
        live = (used[row] != pad) & (np.abs(step).sum(1) > 0)
        total = np.zeros((len(used), DIM), np.float32)
        np.add.at(total, row[live], step[live])
        touched = np.flatnonzero(np.abs(total).sum(1))
        for side in (0, 1):
            b = buckets[used[touched], side]
            np.add.at(state["table"], b, total[touched] ** 2)
            np.add.at(self.table, b, -0.2 * rate * total[touched] / np.sqrt(state["table"][b]))
        for k, g in grads.items():
            state[k] += g**2
            setattr(self, k, getattr(self, k) - 0.3 * rate * g / np.sqrt(state[k]))
        self.offset -= np.float32(rate * miss.sum())
        return np.unique(buckets[used[touched]])

    def learn_languages(self, texts: list[str], languages: list[str | None]) -> None:
        """Log shares of letter bytes in the texts of each language."""
        self.set_profiles(_letters_by_language(texts, languages))

    def set_profiles(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        shares = [(counts[g] + 1.0) / (counts[g] + 1.0).sum() for g in self.languages]
        self.profiles = np.log(np.array(shares)).reshape(-1, 256)

    def groups(self, texts: list[str]) -> list[str]:
        """The language of each text; "" without letters or known languages."""
        letters = _letters(texts)
        if not self.languages:
            return [""] * len(texts)
        best = (letters @ self.profiles.T).argmax(1)
        return [self.languages[i] if some else "" for i, some in zip(best, letters.any(1))]

    def calibrate(self, groups: np.ndarray, logits: np.ndarray, labels: np.ndarray, times: np.ndarray) -> None:
        """Per language, the threshold with the fewest errors, halfway to the next logit that occurs."""
        self.thresholds = {"*": _threshold(logits, labels, times)}
        for g in self.languages:
            own = groups == g
            if min(times[own & (labels == 1)].sum(), times[own & (labels == 0)].sum()) >= MIN_CALIBRATION:
                self.thresholds[g] = _threshold(logits[own], labels[own], times[own])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        line = np.array([self.thresholds.get(g, self.thresholds["*"]) for g in self.groups(texts)])
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - line, -30, 30).astype(np.float64)))

    def compact(self) -> dict:
        met = np.flatnonzero(np.abs(self.table).sum(1))
        kept = {k: v for k, v in self.__dict__.items() if k != "table"}
        return kept | {"met": met.astype(np.int32), "vectors": self.table[met]}

    @classmethod
    def of(cls, parts: dict) -> "Model":
        model = cls()
        model.__dict__.update({k: v for k, v in parts.items() if k not in ("met", "vectors")})
        model.table[parts["met"]] = parts["vectors"]
        return model


def _threshold(logits: np.ndarray, labels: np.ndarray, times: np.ndarray | int = 1) -> float:
    x, at = np.unique(logits.astype(float), return_inverse=True)
    toxic, clean = (np.bincount(at, (labels == y) * times, minlength=len(x)) for y in (1, 0))
    # errors when the first i are called clean: toxic ones among them, clean ones among the rest
    errors = np.r_[0, np.cumsum(toxic)] + clean.sum() - np.r_[0, np.cumsum(clean)]
    best = np.flatnonzero(errors == errors.min())
    i = int(best[len(best) // 2])
    edges = np.r_[x[:1] - 1, (x[1:] + x[:-1]) / 2, x[-1:] + 1]
    return float(edges[i]) if len(x) else 0.0


def _letters_by_language(texts: list[str], languages: list[str | None]) -> dict[str, np.ndarray]:
    counts: dict[str, np.ndarray] = {}
    for text, language in zip(texts, languages):
        if language is not None:
            counts[language] = counts.get(language, 0.0) + _letters([text])[0]
    return counts


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


PACKED = pa.schema([("text", pa.large_string()), ("lang", pa.string()), ("toxic", pa.int8()), ("later", pa.bool_())])
KINDS = ["clean", "toxic", "later_clean", "later_toxic"]


def _packed(documents: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """One partition per worker; a row is a compressed chunk of its labelled texts, with the texts of each kind."""
    workers = max(1, min(WORKERS, -(-count // TEXTS)))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        held = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)
        with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(held)
        counts = [sum(y == label and late == later for *_, y, late in rows) for later in (False, True) for label in (0, 1)]
        return pa.RecordBatch.from_pydict({"chunk": pa.array([sink.getvalue().to_pybytes()], pa.binary())} | {k: [n] for k, n in zip(KINDS, counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, of, toxic = [], 0, None, None
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, label, text, lang in zip(*(part.column(c).to_pylist() for c in ("doc_id", "toxic", "text", "lang"))):
                    if doc != of:
                        of, toxic = doc, None
                    if label is not None:  # comes before the texts of its id
                        toxic = label
                    elif toxic is not None:
                        rows.append((text, lang, int(toxic > 0), crc32(b"calibration%d" % doc) % 5 == 0))
                        toxic, size = None, size + len(text)  # other texts of the id are passed over
                        if len(rows) == CHUNK or size > 1 << 22:
                            yield pack(rows)
                            rows, size = [], 0
        if rows:
            yield pack(rows)

    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("digest", F.md5("text"))
    if count <= BROADCAST_IDS:  # texts without a label need not move; of more ids they move and are passed over
        texts = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    labels = known.select("doc_id", "toxic", *[F.lit(None).cast("string").alias(c) for c in ("text", "lang", "digest")])
    both = texts.unionByName(labels).repartition(workers, "doc_id")
    both = both.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.col("toxic").isNull(), "digest", "lang")
    kinds = ", ".join(f"{k} long" for k in KINDS)
    return cut(both.select("doc_id", "toxic", "text", "lang").mapInArrow(run, f"chunk binary, {kinds}"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str | None], np.ndarray, np.ndarray]]:
    """Texts, languages, labels and whether they are kept back, chunk by chunk."""
    for batch in batches:
        for chunk in batch.column("chunk"):
            held = pa.ipc.open_stream(chunk.as_buffer()).read_all().to_pydict()
            yield held["text"], held["lang"], np.array(held["toxic"], np.int64), np.array(held["later"], bool)


def _rows(chunks: Iterable[tuple], later: bool | None) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels of the rows that are kept back, those that are not, or (None) all."""
    for texts, _, toxic, late in chunks:
        own = np.flatnonzero((late == later) if later is not None else np.ones(len(late), bool))
        if len(own):
            yield [texts[i] for i in own], toxic[own]


SUMS = "worker int, name string, block int, at binary, sums binary"


def _sent(name: str, at: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of an array, in blocks."""
    for block in np.unique(at // BLOCK):
        own = at // BLOCK == block
        held = [[TaskContext.get().partitionId()], [name], [int(block)], [at[own].astype(np.int64).tobytes()], [values[own].astype(np.float64).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held, (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["worker", "name", "block", "at", "sums"])


def _summed(sent: DataFrame, width: dict[str, int], default: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The sums over all workers, name by name and block by block; added in the workers' order."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("worker").to_pylist()
        name, block = rows[0]["name"], rows[0]["block"]
        columns = width.get(name, default)
        total, met = np.zeros((BLOCK, columns)), np.zeros(BLOCK, bool)
        for row in rows:
            at = np.frombuffer(row["at"], np.int64) - block * BLOCK
            total[at] += np.frombuffer(row["sums"]).reshape(-1, columns)
            met[at] = True
        at = np.flatnonzero(met)
        held = {"worker": pa.array([0], pa.int32()), "name": [name], "block": pa.array([block], pa.int32())}
        return pa.table(held | {"at": pa.array([(at + block * BLOCK).tobytes()], pa.binary()), "sums": pa.array([total[at].tobytes()], pa.binary())})

    for row in gathered(sent.groupBy("name", "block").applyInArrow(add, SUMS)):
        yield row["name"], np.frombuffer(row["at"], np.int64), np.frombuffer(row["sums"]).reshape(-1, width.get(row["name"], default))


def _statistics(packed: DataFrame, later: bool | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Clean and toxic training texts with each bucket (and in all), and letter counts by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, letters = np.zeros((2 * BUCKETS + 1, 2)), {}
        for chunk in _chunks(batches):
            for language, counts in _letters_by_language(*chunk[:2]).items():
                letters[language] = letters.get(language, 0.0) + counts
            for texts, toxic in _rows([chunk], later):
                words, flat, starts, n = _word_index(texts)
                buckets = _buckets(words)
                for start, count, y in zip(starts, n, toxic):
                    hits[np.unique(buckets[np.unique(flat[start : start + count])]), y] += 1
                    hits[-1, y] += 1
        met = np.flatnonzero(hits.sum(1))
        yield from _sent("", met, hits[met])
        for language, counts in letters.items():
            yield from _sent("=" + language, np.arange(256), counts[:, None])

    hits, letters = np.zeros((2 * BUCKETS + 1, 2)), {}
    for name, at, sums in _summed(packed.mapInArrow(run, SUMS), {"": 2}, 1):
        if name:
            letters[name[1:]] = sums[:, 0]
        else:
            hits[at] = sums
    return hits, letters


SMALL = ("filters", "bias", "out")


def _round(packed: DataFrame, model: Model, state: dict, turn: int, later: bool | None) -> None:
    """One pass of every worker over its texts, and the mean of what they changed."""
    spark = packed.sparkSession
    met = np.flatnonzero(np.abs(model.table).sum(1))
    shared = spark.sparkContext.broadcast((model.compact(), met.astype(np.int32), state["table"][met], {k: state[k] for k in SMALL}))
    sizes = [getattr(model, k).size for k in SMALL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, met, of_table, small = shared.value
        own = Model.of(parts)
        held = {"table": np.full(own.table.shape, 1e-6, np.float32)} | {k: v.copy() for k, v in small.items()}
        held["table"][met] = of_table
        for k in SMALL:
            setattr(own, k, getattr(own, k).copy())
        steps = own.epoch(_rows(_chunks(batches), later), held, np.random.default_rng([7, turn, TaskContext.get().partitionId()]))
        if not steps[-1]:
            return
        at = np.flatnonzero(steps[:-1])
        vectors = np.concatenate([own.table[at], held["table"][at]], 1).astype(np.float64)
        yield from _sent("table", at, np.concatenate([np.ones((len(at), 1)), vectors], 1) * steps[at][:, None])
        flat = np.concatenate([getattr(own, k).ravel() for k in SMALL] + [held[k].ravel() for k in SMALL] + [[own.offset]])
        yield from _sent("small", np.arange(1), (np.r_[1.0, flat] * steps[-1])[None])

    for name, at, sums in _summed(packed.mapInArrow(run, SUMS), {"table": 1 + 2 * DIM}, 2 + 2 * sum(sizes)):
        mean = (sums[:, 1:] / sums[:, :1]).astype(np.float32)
        if name == "table":
            model.table[at], state["table"][at] = mean[:, :DIM], mean[:, DIM:]
        else:
            pieces = np.split(mean[0], np.cumsum(sizes * 2))
            for k, value, second in zip(SMALL, pieces, pieces[len(SMALL) :]):
                setattr(model, k, value.reshape(getattr(model, k).shape))
                state[k] = second.reshape(state[k].shape)
            model.offset = np.float32(pieces[-1][0])
    shared.unpersist()


def _calibrate(packed: DataFrame, model: Model, later: bool | None) -> None:
    shared = packed.sparkSession.sparkContext.broadcast(model.compact())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for texts, toxic in _rows(_chunks(batches), later):
            step = np.floor(np.clip(own.logits(texts).astype(float), -HIGHEST, HIGHEST) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.groups(texts), pa.string()), pa.array(step), pa.array(toxic)], ["group", "step", "toxic"])

    found = packed.mapInArrow(run, "group string, step long, toxic long").groupBy("group", "step", "toxic").count().toPandas()
    middle = (found["step"].to_numpy() + 0.5) / STEPS
    model.calibrate(found["group"].to_numpy(object), middle, found["toxic"].to_numpy(), found["count"].to_numpy())
    shared.unpersist()


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled texts that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    packed = _packed(documents, known, known.count())
    release(documents.sparkSession)
    clean, toxic, late_clean, late_toxic = (n or 0 for n in packed.agg(*[F.sum(k) for k in KINDS]).first())
    model = Model()
    if not clean + late_clean or not toxic + late_toxic:
        return model
    apart = min(clean, toxic, late_clean, late_toxic) > 0  # else all rows serve both ends
    hits, letters = _statistics(packed, False if apart else None)
    model.set_profiles(letters)
    model.start(hits)
    state = {k: np.full(getattr(model, k).shape, 1e-6, np.float32) for k in ("table", *SMALL)}
    for turn in range(min(20, max(ROUNDS, SEEN // int(hits[-1].sum())))):
        _round(packed, model, state, turn, False if apart else None)
        release(documents.sparkSession)
    _calibrate(packed, model, True if apart else None)
    return model


def score(model: Model, documents: DataFrame, text: str = "text") -> Column:
    """The score of a text column as a column; the model (a few MB) is broadcast."""
    parts = documents.sparkSession.sparkContext.broadcast(model.compact())
    held: list[Model] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Model.of(parts.value))
        done, rows, size = [], [], 0  # some texts at a time, to bound memory
        for text in texts:
            if rows and (len(rows) == CHUNK or size + len(text) > 1 << 20):
                done.append(held[0].scores(rows))
                rows, size = [], 0
            rows.append(text)
            size += len(text)
        return pd.Series(np.concatenate([*done, held[0].scores(rows)]) if rows else [], dtype=float)

    return scored(F.coalesce(F.col(text), F.lit("")))


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns kept, whose score is below 0.5."""
    return documents.where(score(model, documents) < 0.5)
