"""Assigning codes: nearest centroid, residual encoding, decoding and batch-balanced assignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.session import BROADCAST_LIMIT, shared_root

# Entries of the distance block a task holds at a time.
BLOCK = 4_000_000


@dataclass(frozen=True)
class Level:
    """Codes (ascending) of one level with their centroids, held as one array or read slice by slice.

    Beyond the broadcast bound only the codes are shipped. ``slices`` then names the first position and the folder of
    each slice in shared storage, and a task holds one slice at a time.
    """

    codes: np.ndarray
    centroids: np.ndarray | None = None
    slices: tuple[tuple[int, str], ...] = ()
    width: int = 0
    kept: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def dim(self) -> int:
        return self.width if self.centroids is None else self.centroids.shape[1]

    @property
    def nbytes(self) -> int:
        return self.codes.nbytes + (0 if self.centroids is None else self.centroids.nbytes)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Position of the first centroid and the centroids, slice by slice."""
        if self.centroids is not None:
            yield 0, self.centroids
        for start, folder in self.slices:
            if folder not in self.kept:
                self.kept.clear()
                self.kept[folder] = _read_slice(folder)
            yield start, self.kept[folder]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The centroids at these positions."""
        if self.centroids is not None:
            return self.centroids[at]
        out = np.empty((len(at), self.dim))
        for start, part in self.parts():
            inside = (at >= start) & (at < start + len(part))
            if inside.any():
                out[inside] = part[at[inside] - start]
        return out


def _read_slice(folder: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    table = dataset.dataset(path, filesystem=system, format="parquet").to_table(columns=["code", "centroid"])
    return matrix(table.sort_by("code")["centroid"])


def share(df: DataFrame, levels: list[Level]) -> Broadcast:
    """Ship levels as plain arrays; ``opened`` makes levels of them again inside a task."""
    return df.sparkSession.sparkContext.broadcast([(x.codes, x.centroids, x.slices, x.width) for x in levels])


def opened(shared: Broadcast) -> list[Level]:
    return [Level(*parts) for parts in shared.value]


def codebook_bytes(codebook: DataFrame) -> int:
    row = codebook.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).head()
    return int(row["n"] or 0) * (int(row["d"] or 0) + 2) * 8


def load_levels(codebook: DataFrame, limit: int = BROADCAST_LIMIT) -> list[Level]:
    """The levels of a codebook of any size, in order.

    Within ``limit`` bytes the centroids come to the driver, to be shipped. A larger codebook is written to the
    shared folder in slices of a quarter of that, and only its codes come to the driver.
    """
    size = codebook_bytes(codebook)
    if size == 0:
        raise ValueError("empty codebook")
    rows = codebook.select(F.col("level").cast("int"), F.col("code").cast("int"), F.col("centroid").cast("array<double>"))
    held = size <= limit
    table = (rows if held else rows.drop("centroid")).toArrow()
    level, code = table["level"].to_numpy(), table["code"].to_numpy()
    centroids = np.array(table["centroid"].to_pylist(), dtype=np.float64) if held else None
    out = []
    for value in np.unique(level):
        at = np.flatnonzero(level == value)
        at = at[np.argsort(code[at], kind="stable")]
        codes = code[at].astype(np.int32)
        one = rows.where(F.col("level") == int(value)).select("code", "centroid")
        out.append(Level(codes, centroids[at]) if held else _sliced(one, codes, limit // 4))
    return out


def _sliced(level: DataFrame, codes: np.ndarray, slice_bytes: int) -> Level:
    """Writes one level to the shared folder, cut by code into slices of at most ``slice_bytes`` (or one centroid)."""
    spark = level.sparkSession
    dim = int(level.agg(F.max(F.size("centroid"))).head()[0])
    step = max(slice_bytes // (8 * dim), 1)
    starts = range(0, len(codes), step)
    firsts = F.lit([int(codes[i]) for i in starts])
    folder = f"{shared_root(spark)}/codebook-{uuid.uuid4().hex}"
    numbered = level.withColumn("slice", F.size(F.filter(firsts, lambda first: first <= F.col("code"))) - 1)
    numbered.repartition(len(starts), "slice").write.partitionBy("slice").parquet(folder)
    return Level(codes, None, tuple((start, f"{folder}/slice={i}") for i, start in enumerate(starts)), dim)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as a DOUBLE matrix; all vectors must be present and of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if column.null_count or (n and len(flat) % n) or (dim is not None and len(flat) != n * dim):
        raise ValueError(f"vectors must be present and of equal length{'' if dim is None else f' {dim}'}")
    return flat.reshape(n, -1)


def list_array(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1), type=kind))


def distances(x: np.ndarray, level: Level) -> np.ndarray:
    own = (x * x).sum(1)[:, None]
    blocks = [own + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T) for _, c in level.parts()]
    return blocks[0] if len(blocks) == 1 else np.concatenate(blocks, axis=1)


def nearest_rows(x: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Position and squared distance of the nearest centroid per row; ties go to the lowest code."""
    best, error = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for first, part in level.parts():
        at, dist = _nearest_in(x, part)
        better = dist < error
        best[better], error[better] = at[better] + first, dist[better]
    return best, error


def _nearest_in(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = np.empty(len(x), dtype=np.int64)
    step = max(BLOCK // max(len(c), 1), 1)
    for start in range(0, len(x), step):
        part = x[start : start + step]
        d = (part * part).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (part @ c.T)
        low = d.min(1)
        pick = d.argmin(1)
        # the expanded form loses digits: settle near ties on plain differences
        near = d <= (low + 1e-9 * (1.0 + np.abs(low)))[:, None]
        for i in np.flatnonzero(near.sum(1) > 1):
            rivals = np.flatnonzero(near[i])
            exact = ((part[i] - c[rivals]) ** 2).sum(1)
            pick[i] = rivals[exact.argmin()]
        best[start : start + step] = pick
    diff = x - c[best]
    return best, (diff * diff).sum(1)


def _schema(df: DataFrame, *extra: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join(fields + list(extra))


def _extend(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        list(batch.columns) + list(columns.values()), names=list(batch.schema.names) + list(columns)
    )


def encode_levels(df: DataFrame, levels: list[Level], vector: str = "embedding", residual: bool = False) -> DataFrame:
    """Residual codes of each row against broadcast levels, in one narrow pass."""
    shared = share(df, levels)
    dim = levels[0].dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = opened(shared)
        for batch in batches:
            rest = matrix(batch.column(vector), dim).copy()
            codes = np.empty((len(rest), len(stack)), dtype=np.int32)
            error = np.zeros(len(rest))
            for l, level in enumerate(stack):
                best, error = nearest_rows(rest, level)
                codes[:, l] = level.codes[best]
                rest -= level.take(best)
            columns = {"codes": list_array(codes, pa.int32()), "sq_error": pa.array(error)}
            if residual:
                columns["residual"] = list_array(rest, pa.float64())
            yield _extend(batch, columns)

    extra = ["codes array<int>", "sq_error double"] + (["residual array<double>"] if residual else [])
    return df.mapInArrow(run, _schema(df, *extra))


def encode(
    df: DataFrame,
    codebook: DataFrame,
    vector: str = "embedding",
    pack: Column | None = None,
    residual: bool = False,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Residual encoding: adds ``codes``, ``sq_error`` (of the last level) and optionally ``residual``.

    ``pack`` appends a metadata code. A codebook beyond ``limit`` bytes is read slice by slice.
    """
    out = encode_levels(df, load_levels(codebook, limit), vector, residual)
    return out if pack is None else out.withColumn("codes", F.concat("codes", F.array(pack.cast("int"))))


def nearest(df: DataFrame, codebook: DataFrame, vector: str = "embedding", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Nearest centroid of a one-level codebook of any size: adds ``code`` and ``sq_dist``; ties go to the lowest code."""
    level = load_levels(codebook, limit)[0]
    shared = share(df, [level])
    dim = level.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (book,) = opened(shared)
        for batch in batches:
            best, dist = nearest_rows(matrix(batch.column(vector), dim), book)
            yield _extend(batch, {"code": pa.array(book.codes[best]), "sq_dist": pa.array(dist)})

    return df.mapInArrow(run, _schema(df, "code int", "sq_dist double"))


def decode(
    df: DataFrame, codebook: DataFrame, upto: int | None = None, codes: str = "codes", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Sum of the centroids named by the codes of the first ``upto`` levels, as ``decoded``.

    The code -1 stands for no code and adds nothing.
    """
    levels = load_levels(codebook, limit)
    dim = levels[0].dim
    levels = levels if upto is None else levels[:upto]
    shared = share(df, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = matrix(batch.column(codes)).astype(np.int64) if batch.num_rows else np.zeros((0, 0), np.int64)
            total = np.zeros((batch.num_rows, dim))
            for l, level in enumerate(opened(shared)):
                column = picked[:, l] if batch.num_rows else picked.reshape(-1)
                at = np.clip(np.searchsorted(level.codes, column), 0, len(level.codes) - 1)
                unknown = (level.codes[at] != column) & (column != -1)
                if unknown.any():
                    raise ValueError(f"code {column[unknown][0]} is not in level {l + 1}")
                total += np.where((column == -1)[:, None], 0.0, level.take(at))
            yield _extend(batch, {"decoded": list_array(total, pa.float64())})

    return df.mapInArrow(run, _schema(df, "decoded array<double>"))


def residual(
    df: DataFrame,
    codebook: DataFrame,
    upto: int | None = None,
    vector: str = "embedding",
    codes: str = "codes",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """What the first ``upto`` levels leave of each vector, as ``residual``."""
    from quantaloom.functions.vectors import subtract

    decoded = decode(df, codebook, upto, codes, limit)
    return decoded.select(*df.columns, subtract(F.col(vector), F.col("decoded")).alias("residual"))


def code_stats(df: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """Count and vector sum of the rows assigned to each code."""
    from quantaloom.operators.sums import dimension, vector_sum

    return vector_sum(df, ["code"], vector, dim or dimension(df, vector), [("n", F.count("*"))])


def recon_error(df: DataFrame, a: str, b: str, loss: str = "mse", quant_weight: float = 1.0) -> DataFrame:
    """Mean error over all elements, with the commitment term (a mean square) and the weighted total."""
    from quantaloom.functions.vectors import as_double, sq_l2

    gaps = F.zip_with(as_double(F.col(a)), as_double(F.col(b)), lambda x, y: F.abs(x - y))
    absolute = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
    sums = df.agg(
        F.sum(absolute).alias("abs"), F.sum(sq_l2(F.col(a), F.col(b))).alias("sq"), F.sum(F.size(a)).alias("elements")
    )
    recon = F.col("abs") / F.col("elements") if loss == "l1" else F.col("sq") / F.col("elements")
    commitment = F.col("sq") / F.col("elements")
    return sums.select(
        recon.alias("recon"), commitment.alias("commitment"), (recon + quant_weight * commitment).alias("total")
    )


def balanced_batch(d: np.ndarray, epsilon: float, iters: int, center: str) -> np.ndarray:
    """Column picked per row by entropic transport towards equal column mass."""
    if center == "global":
        middle = (d.max() + d.min()) / 2
        scaled = (d - middle) / (d.max() - middle + 1e-5)
    elif center == "row":
        lowered = d - d.min(1, keepdims=True)
        scaled = lowered / (lowered.max(1, keepdims=True) + 1e-8)
    else:
        raise ValueError(f"unknown centring {center!r}")
    kernel = np.exp(-scaled / epsilon)
    columns = np.ones(d.shape[1])
    # only the column scaling can change which column of a row is largest
    for _ in range(iters):
        rows = 1.0 / (len(d) * (kernel @ columns))
        columns = 1.0 / (d.shape[1] * (rows @ kernel))
    plan = kernel * columns
    if not np.isfinite(plan).all():
        raise ValueError("transport plan is not finite")
    return plan.argmax(1)


def sinkhorn_batch(
    df: DataFrame,
    codebook: DataFrame,
    eps: list[float],
    iters: int = 100,
    batch_size: int = 2048,
    center: str = "global",
    vector: str = "embedding",
    idx: str = "idx",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Residual codes where each level with a positive epsilon balances its codes inside a mini-batch.

    A batch is ``idx div batch_size``; idx must be dense, so no group exceeds the batch size.
    """
    levels = load_levels(codebook, limit)
    if len(eps) != len(levels):
        raise ValueError("one epsilon per level is needed")
    shared = share(df, levels)
    dim = levels[0].dim

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > batch_size:
            raise ValueError("row numbers repeat: a batch holds more rows than its size")
        table = table.sort_by(idx)
        rest = matrix(table[vector], dim).copy()
        stack = opened(shared)
        codes = np.empty((len(rest), len(stack)), dtype=np.int32)
        for l, level in enumerate(stack):
            if eps[l] > 0:
                best = balanced_batch(distances(rest, level), eps[l], iters, center)
            else:
                best, _ = nearest_rows(rest, level)
            codes[:, l] = level.codes[best]
            rest -= level.take(best)
        return table.drop_columns(["batch"]).append_column("codes", list_array(codes, pa.int32()))

    batched = df.withColumn("batch", F.floor(F.col(idx) / batch_size))
    return batched.groupBy("batch").applyInArrow(run, _schema(df, "codes array<int>"))
