"""Codebook training as distributed jobs: residual, product, rotated and subspace quantizers, EMA upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.vectors import add, as_double, scale, subvector
from quantaloom.operators.assign import (
    _extend,
    _schema,
    code_stats,
    encode,
    list_array,
    load_levels,
    matrix,
    nearest,
    nearest_rows,
    opened,
    share,
)
from quantaloom.operators.sampling import balanced_sample, dedup_vectors, finite_rows, sample_rows
from quantaloom.operators.sums import dimension, vector_sum
from quantaloom.session import BROADCAST_LIMIT, cut

CODEBOOK = "level int, code int, centroid array<double>"

# Largest rotation the driver decomposes: 4096 squared doubles are 128 MB.
MAX_ROTATION = 4096

# Bytes of vectors, as doubles, that a task turns, encodes or sums up at a time.
PIECE = 1 << 20


def codebook_frame(df: DataFrame, centroids: np.ndarray, level: int = 1) -> DataFrame:
    rows = [(level, code, [float(x) for x in c]) for code, c in enumerate(centroids)]
    return df.sparkSession.createDataFrame(rows, CODEBOOK)


def training_rows(
    df: DataFrame, max_samples: int | None = None, seed: int = 0, dedup: bool = True, vector: str = "embedding", idx: str = "idx"
) -> DataFrame:
    """Finite rows without exact copies; all of them unless the caller asks for a sample."""
    rows = finite_rows(df.select(idx, vector), vector)
    if max_samples is not None:
        rows = sample_rows(rows, max_samples, seed, idx)
    return dedup_vectors(rows, vector, idx) if dedup else rows


def fit_codebook(
    df: DataFrame,
    k: int,
    iters: int = 10,
    seed: int = 0,
    max_samples: int | None = None,
    dedup: bool = True,
    vector: str = "embedding",
    idx: str = "idx",
    level: int = 1,
    dim: int | None = None,
    prepared: bool = False,
) -> DataFrame:
    """K-means codebook of exactly ``k`` centroids.

    With fewer rows than ``k`` the centroids are rows drawn with replacement; without any valid row they
    are random normal. Empty clusters are refilled from the rows. ``prepared`` rows are used as they are: a
    caller that trains several codebooks cleans and materialises its rows once.
    """
    rows = df.select(idx, vector) if prepared else cut(training_rows(df, max_samples, seed, dedup, vector, idx))
    rng = np.random.default_rng(seed)
    n = rows.count()
    if n == 0:
        return codebook_frame(df, rng.normal(size=(k, dim or dimension(df, vector))), level)

    def draw(count: int) -> np.ndarray:
        # at most `count` rows leave the cluster
        picked = sample_rows(rows, count, seed, idx).orderBy(idx).select(vector).collect()
        pool = np.array([r[0] for r in picked], dtype=np.float64)
        return pool[rng.integers(0, len(pool), size=count)]

    if n < k:
        return codebook_frame(df, draw(k), level)
    features = rows.select(array_to_vector(as_double(F.col(vector))).alias("features")).persist()
    model = KMeans(k=k, maxIter=iters, seed=seed).fit(features)
    features.unpersist()
    centers = np.array(model.clusterCenters())
    if len(centers) < k:
        centers = np.concatenate([centers, draw(k - len(centers))])
    return codebook_frame(df, centers, level)


def subtract_nearest(df: DataFrame, codebook: DataFrame, vector: str) -> DataFrame:
    """The vector column replaced by what its nearest centroid leaves."""
    out = encode(df, codebook, vector, residual=True)
    return out.select(*[F.col("residual").alias(c) if c == vector else F.col(c) for c in df.columns])


def fit_rq(
    df: DataFrame,
    sizes: list[int],
    iters: int = 10,
    seed: int = 0,
    max_samples: int | None = None,
    dedup: bool = True,
    vector: str = "embedding",
    idx: str = "idx",
    prepared: bool = False,
) -> DataFrame:
    """Residual codebooks, level by level; sizes must be powers of two.

    Rows are cleaned once; each level trains on what the levels above leave of them.
    """
    for size in sizes:
        if size < 1 or size & (size - 1):
            raise ValueError(f"codebook size {size} is not a power of two")
    rest = df.select(idx, vector) if prepared else cut(training_rows(df, max_samples, seed, dedup, vector, idx))
    books = None
    for l, size in enumerate(sizes, start=1):
        book = fit_codebook(rest, size, iters, seed + l - 1, vector=vector, idx=idx, level=l, prepared=True)
        books = book if books is None else books.unionByName(book)
        if l < len(sizes):
            rest = cut(subtract_nearest(rest, book, vector))
    return books


def fit_rq_balanced(
    df: DataFrame,
    sizes: list[int],
    domains: tuple[str, str],
    per_domain: int | None = None,
    seed: int = 0,
    literal: bool = False,
    iters: int = 10,
    vector: str = "embedding",
    idx: str = "idx",
    domain: str = "domain",
) -> DataFrame:
    """Residual codebooks seeded from equally many rows of two domains.

    ``literal`` trains every level on the sample itself instead of on residuals.
    """
    sample = balanced_sample(df, domains, per_domain, seed, idx, domain).select(idx, vector)
    if not literal:
        return fit_rq(sample, sizes, iters, seed, None, True, vector, idx)
    sample = cut(training_rows(sample, None, seed, True, vector, idx))
    books = None
    for l, size in enumerate(sizes, start=1):
        book = fit_codebook(sample, size, iters, seed, vector=vector, idx=idx, level=l, prepared=True)
        books = book if books is None else books.unionByName(book)
    return books


def split_parts(df: DataFrame, m: int, vector: str = "embedding", dim: int | None = None) -> list[DataFrame]:
    """The ``m`` contiguous parts of each vector, one frame per part; a tail is dropped."""
    width = (dim or dimension(df, vector)) // m
    return [df.withColumn(vector, subvector(F.col(vector), i, width)) for i in range(m)]


def fit_pq(
    df: DataFrame, m: int, k: int, iters: int = 10, seed: int = 0, max_samples: int | None = None,
    vector: str = "embedding", idx: str = "idx", prepared: bool = False,
) -> DataFrame:
    """One codebook per part of the vector: ``part, level, code, centroid``; rows are cleaned once, as whole vectors."""
    whole = df.select(idx, vector) if prepared else cut(training_rows(df, max_samples, seed, True, vector, idx))
    books = None
    for part, rows in enumerate(split_parts(whole, m, vector), start=1):
        book = fit_codebook(rows, k, iters, seed + part, vector=vector, idx=idx, prepared=True)
        book = book.select(F.lit(part).alias("part"), "*")
        books = book if books is None else books.unionByName(book)
    return books


def pieces(batch: pa.RecordBatch, vector: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``PIECE`` bytes of vectors (or one longer vector)."""
    column = batch.column(vector)
    width = 8 * len(column.flatten()) // max(len(column), 1)
    step = max(PIECE // max(width, 1), 1)
    for at in range(0, max(batch.num_rows, 1), step):
        yield batch.slice(at, step)


def _part_coder(
    df: DataFrame, codebook: DataFrame, rotation: np.ndarray | None, limit: int
) -> Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """What a task opens to get, for a matrix of vectors, the codes of all parts and the decoded vectors."""
    parts = [r[0] for r in codebook.select("part").distinct().orderBy("part").collect()]
    # the bound holds for the parts together
    stacks = [load_levels(codebook.where(F.col("part") == p), limit // len(parts)) for p in parts]
    shared = [share(df, stack) for stack in stacks]
    turned = df.sparkSession.sparkContext.broadcast(rotation)
    width = stacks[0][0].dim

    def ready() -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        books, turn = [opened(s) for s in shared], turned.value

        def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = x if turn is None else x @ turn.T
            codes, decoded = [], np.zeros((len(x), width * len(books)))
            for i, stack in enumerate(books):
                at = slice(i * width, (i + 1) * width)
                rest = x[:, at].copy()
                for level in stack:
                    best, _ = nearest_rows(rest, level)
                    codes.append(level.codes[best])
                    rest -= level.take(best)
                decoded[:, at] = x[:, at] - rest
            return np.stack(codes, 1), decoded

        return code

    return ready


def encode_parts(
    df: DataFrame,
    codebook: DataFrame,
    vector: str = "embedding",
    rotation: np.ndarray | None = None,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Codes of every part side by side, in one narrow pass: adds ``codes`` and ``decoded``.

    ``codebook`` has ``part, level, code, centroid``; each part is encoded residually over its levels.
    ``decoded`` is in the (rotated) space the codebooks live in.
    """
    ready = _part_coder(df, codebook, rotation, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ready()
        for batch in batches:
            for piece in pieces(batch, vector):
                codes, decoded = code(matrix(piece.column(vector)))
                yield _extend(piece, {"codes": list_array(codes, pa.int32()), "decoded": list_array(decoded, pa.float64())})

    return df.mapInArrow(run, _schema(df, "codes array<int>", "decoded array<double>"))


def rotate(df: DataFrame, rotation: np.ndarray, vector: str = "embedding") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rotation)
    at = df.columns.index(vector)
    fields = [
        f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in df.schema.fields
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, vector):
                turned = list_array(matrix(piece.column(vector)) @ shared.value.T, pa.float64())
                columns = [turned if i == at else c for i, c in enumerate(piece.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return df.mapInArrow(run, ", ".join(fields))


def cross_moment(df: DataFrame, a: str, b: str) -> np.ndarray:
    """Sum over rows of the outer product of two vector columns, added up in the cluster row by row."""
    da, db = dimension(df, a), dimension(df, b)
    if max(da, db) > MAX_ROTATION:
        raise ValueError(f"a moment of {da}×{db} is beyond the driver bound")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for piece in pieces(batch, a):
                yield matrix(piece.column(a), da), matrix(piece.column(b), db)

    return _moment(df.select(a, b), pairs, da, db)


def _moment(df: DataFrame, pairs: Callable, da: int, db: int) -> np.ndarray:
    """The sum of the outer products of the rows of all ``pairs`` of matrices that a task makes of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((da, db))
        for x, y in pairs(batches):
            total += x.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(da, dtype=np.int32)), list_array(total, pa.float64())], names=["i", "v"]
        )

    partial = df.mapInArrow(run, "i int, v array<double>")
    rows = vector_sum(partial, ["i"], "v", db).orderBy("i").collect()
    return np.array([r["vec_sum"] for r in rows])


def decoded_moment(
    df: DataFrame, codebook: DataFrame, vector: str = "embedding", rotation: np.ndarray | None = None, limit: int = BROADCAST_LIMIT
) -> np.ndarray:
    """``cross_moment`` of what ``encode_parts`` decodes and the vectors: coded and summed up in the same worker.

    Two Python steps of one task would each hold a worker process.
    """
    dim = dimension(df, vector)
    if dim > MAX_ROTATION:
        raise ValueError(f"a moment of {dim}×{dim} is beyond the driver bound")
    ready = _part_coder(df, codebook, rotation, limit)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        code = ready()
        for batch in batches:
            for piece in pieces(batch, vector):
                x = matrix(piece.column(vector), dim)
                yield code(x)[1], x

    return _moment(df.select(vector), pairs, dim, dim)


def fit_opq(
    df: DataFrame, m: int, k: int, niter: int = 5, iters: int = 10, seed: int = 0,
    max_samples: int | None = None, vector: str = "embedding", idx: str = "idx", prepared: bool = False,
) -> tuple[np.ndarray, DataFrame]:
    """Rotation and product codebooks that lower the quantization error together.

    Alternates product training in the rotated space with the orthogonal Procrustes solution between the
    rows and their reconstruction. Apply with ``encode_parts(…, rotation=…)``. The rotation is solved on the
    driver, for vectors of at most ``MAX_ROTATION`` components.
    """
    rows = df.select(idx, vector) if prepared else cut(training_rows(df, max_samples, seed, True, vector, idx))
    dim = dimension(rows, vector)
    if dim % m:
        raise ValueError(f"{dim} components do not split into {m} parts")
    rotation = np.eye(dim)
    for _ in range(niter):
        book = fit_pq(rotate(rows, rotation, vector), m, k, iters, seed, vector=vector, idx=idx, prepared=True)
        left, _, right = np.linalg.svd(decoded_moment(rows, book, vector, rotation))
        rotation = left @ right
    return rotation, fit_pq(rotate(rows, rotation, vector), m, k, iters, seed, vector=vector, idx=idx, prepared=True)


def fit_rq_pq(
    df: DataFrame, sizes: list[int], m: int = 2, k: int = 1024, niter: int = 5, iters: int = 10, seed: int = 0,
    max_samples: int | None = None, vector: str = "embedding", idx: str = "idx",
) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Residual levels, then a rotated product quantizer on what they leave."""
    rows = cut(training_rows(df, max_samples, seed, True, vector, idx))
    book = fit_rq(rows, sizes, iters, seed, vector=vector, idx=idx, prepared=True)
    rest = cut(subtract_nearest(rows, book, vector))
    rotation, parts = fit_opq(rest, m, k, niter, iters, seed, vector=vector, idx=idx, prepared=True)
    return book, rotation, parts


def encode_rq_pq(
    df: DataFrame, book: DataFrame, rotation: np.ndarray, parts: DataFrame, vector: str = "embedding"
) -> DataFrame:
    """Composite codes: the residual levels followed by one code per part."""
    first = encode(df, book, vector, residual=True).withColumnRenamed("codes", "__rq").drop("sq_error")
    second = encode_parts(first, parts, "residual", rotation)
    return second.select(*df.columns, F.concat("__rq", "codes").alias("codes"))


def fit_subspace_rq(
    df: DataFrame, m: int, sizes: list[int], iters: int = 10, seed: int = 0, max_samples: int | None = None,
    rotation: np.ndarray | None = None, vector: str = "embedding", idx: str = "idx",
) -> DataFrame:
    """Independent residual codebooks per part: ``part, level, code, centroid``."""
    rows = cut(training_rows(df, max_samples, seed, True, vector, idx))
    rows = rows if rotation is None else rotate(rows, rotation, vector)
    books = None
    for part, one in enumerate(split_parts(rows, m, vector), start=1):
        book = fit_rq(one, sizes, iters, seed + 100 * part, vector=vector, idx=idx, prepared=True)
        book = book.select(F.lit(part).alias("part"), "*")
        books = book if books is None else books.unionByName(book)
    return books


def ema_state(codebook: DataFrame) -> DataFrame:
    """Running statistics a codebook starts from: counts one, sums the centroids themselves."""
    return codebook.select("code", F.lit(1.0).alias("count"), as_double(F.col("centroid")).alias("sum"), "centroid")


def _smoothed(count, total, k, eps: float):
    """Cluster sizes with Laplace smoothing, so that an unused code never divides by zero."""
    return (count + eps) / (total + k * eps) * total


def ema_update(state: DataFrame, stats: DataFrame, decay: float = 0.99, eps: float = 1e-5, mode: str = "ema") -> DataFrame:
    """New ``code, count, sum, centroid`` after one batch of ``code, n, vec_sum`` statistics.

    ``ema`` averages counts and sums over batches and divides them; ``post`` moves each centroid towards
    its batch mean, so codes the batch did not use shrink towards zero.
    """
    dim = F.size("centroid")
    zero = F.array_repeat(F.lit(0.0), dim)
    joined = state.join(stats.select("code", F.col("n").alias("__n"), F.col("vec_sum").alias("__sum")), "code", "left")
    joined = joined.withColumn("__n", F.coalesce(F.col("__n").cast("double"), F.lit(0.0)))
    joined = joined.withColumn("__sum", F.coalesce("__sum", zero))
    keep = 1.0 - decay
    if mode == "ema":
        joined = joined.withColumn("count", F.col("count") * decay + F.col("__n") * keep)
        mixed = add(scale(F.col("sum"), F.lit(decay)), scale(F.col("__sum"), F.lit(keep)))
        joined = joined.withColumn("sum", mixed)
        weight = "count"
    elif mode == "post":
        weight = "__n"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    totals = joined.agg(F.sum(weight).alias("__total"), F.count("*").alias("__k")).withColumn("__one", F.lit(1))
    joined = joined.withColumn("__one", F.lit(1)).join(F.broadcast(totals), "__one")
    share = _smoothed(F.col(weight), F.col("__total"), F.col("__k"), eps)
    mean = F.zip_with(F.col("sum" if mode == "ema" else "__sum"), F.array_repeat(share, dim), lambda s, w: s / w)
    if mode == "ema":
        centroid = mean
    else:
        centroid = add(scale(F.col("centroid"), F.lit(decay)), scale(mean, F.lit(keep)))
    return joined.select("code", "count", "sum", centroid.alias("centroid"))


def ema_step(
    state: DataFrame, batch: DataFrame, decay: float = 0.99, eps: float = 1e-5, mode: str = "ema", vector: str = "embedding",
    idx: str = "idx",
) -> DataFrame:
    """Assign a batch to the current centroids and fold its statistics into the state."""
    book = state.select(F.lit(1).alias("level"), "code", "centroid")
    dim = dimension(state, "centroid")
    return ema_update(state, code_stats(nearest(batch, book, vector), vector, dim), decay, eps, mode)


def materialize_codebook(weights: DataFrame, basis: DataFrame, level: int = 1) -> DataFrame:
    """Codebook of a factored layer: ``weights(code, basis_id, weight)`` times ``basis(basis_id, vector)``."""
    dim = dimension(basis, "vector")
    scaled = weights.join(basis, "basis_id").select("code", scale(F.col("vector"), F.col("weight")).alias("v"))
    return vector_sum(scaled, ["code"], "v", dim, name="centroid").select(F.lit(level).alias("level"), "code", "centroid")
