"""Vectors from Parquet or from row-major matrix files, and to such files, on any file system that ``pyarrow.fs`` reads."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.operators.assign import list_array, matrix

# Bytes of a matrix file that a task reads at a time, or holds before it writes them.
RANGE_BYTES = 32 * 1024 * 1024


def read_vectors(
    spark: SparkSession, path: str, vector: str = "embedding", idx: str = "idx", max_rows: int | None = None
) -> DataFrame:
    """``idx, embedding ARRAY<FLOAT>``; a ``.npy`` path names one matrix file."""
    if str(path).endswith(".npy"):
        return read_npy(spark, path, max_rows)
    df = spark.read.parquet(path).select(F.col(idx).alias("idx"), F.col(vector).cast("array<float>").alias("embedding"))
    return df if max_rows is None else df.where(F.col("idx") < max_rows)


def _file_system(path: str):
    """File system and path there; a plain path is a file of the machine (a shared mount on a cluster)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


def _header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, number type and first data byte of a matrix file."""
    fs, name = _file_system(path)
    with fs.open_input_file(name) as f:
        start = f.read(1 << 12)
        head = io.BytesIO(start)
        version = np.lib.format.read_magic(head)
        size = int.from_bytes(start[8 : 10 if version == (1, 0) else 12], "little")
        if len(start) < head.tell() + size + 4:
            head = io.BytesIO(start + f.read(size))
            np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(head)
    if len(shape) != 2 or (by_column and min(shape) > 1):
        raise ValueError(f"expected a row-major matrix, got shape {shape} in {path}")
    return shape, kind, head.tell()


def read_npy(spark: SparkSession, paths: str | list[str], max_rows: int | None = None) -> DataFrame:
    """``idx, embedding`` of matrix files, numbered on from file to file in the order given.

    The driver reads the headers only; tasks read disjoint ranges of rows, each from its own place in a file.
    """
    pieces, total, width = [], 0, None
    for path in [paths] if isinstance(paths, str) else list(paths):
        (n, dim), kind, offset = _header(path)
        if n and width not in (None, dim):
            raise ValueError(f"expected {width} components, got {dim} in {path}")
        width = dim if n else width
        n = n if max_rows is None else max(min(n, max_rows - total), 0)
        step = max(RANGE_BYTES // max(dim * kind.itemsize, 1), 1)
        row = dim * kind.itemsize
        pieces += [(path, offset + a * row, total + a, min(step, n - a), dim, kind.str) for a in range(0, n, step)]
        total += n
    schema = "path string, offset bigint, first bigint, n bigint, dim bigint, kind string"
    ranges = spark.createDataFrame(pieces, schema)
    if pieces:
        ranges = ranges.repartitionByRange(min(len(pieces), 4096), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype(r["kind"])
                fs, name = _file_system(r["path"])
                with fs.open_input_file(name) as f:
                    f.seek(r["offset"])
                    data = f.read(r["n"] * r["dim"] * kind.itemsize)
                block = np.frombuffer(data, kind).reshape(r["n"], r["dim"]).astype(np.float32)
                at = pa.array(np.arange(r["first"], r["first"] + r["n"], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([at, list_array(block, pa.float32())], names=["idx", "embedding"])

    return ranges.mapInArrow(run, "idx bigint, embedding array<float>")


def write_npy(df: DataFrame, folder: str, vector: str = "embedding", idx: str = "idx") -> list[str]:
    """The vectors as float32 matrix files in the order of ``idx``; the paths in that order, as ``read_npy`` takes them.

    Rows are range-partitioned by ``idx``. A task holds one file's rows (``RANGE_BYTES``) at a time, and each attempt
    writes under names of its own, of which those that finished tasks return are listed.
    """
    rows = df.select(F.col(idx).cast("bigint").alias("idx"), F.col(vector).cast("array<float>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)

        def store(first: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            name = f"part-{first}-{uuid.uuid4().hex}.npy"
            block = np.ascontiguousarray(np.concatenate(parts), dtype="<f4")
            with fs.open_output_stream(f"{root}/{name}") as out:
                head = {"descr": "<f4", "fortran_order": False, "shape": block.shape}
                start = io.BytesIO()
                np.lib.format.write_array_header_1_0(start, head)
                out.write(start.getvalue())
                out.write(block.data.cast("B"))
            return pa.RecordBatch.from_pydict({"first": [first], "path": [f"{folder}/{name}"]})

        parts, size, first = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column(0)[0].as_py() if first is None else first
            parts.append(matrix(batch.column(1)).astype("<f4"))
            size += parts[-1].nbytes
            if size >= RANGE_BYTES:
                yield store(first, parts)
                parts, size, first = [], 0, None
        if parts:
            yield store(first, parts)

    ordered = rows.repartitionByRange("idx").sortWithinPartitions("idx")
    done = ordered.mapInArrow(run, "first bigint, path string").collect()  # a row per file
    return [r["path"] for r in sorted(done, key=lambda r: r["first"])]
