"""Text to vectors through a caller's encoder, and dense-layer scoring from given weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.operators.assign import _extend, _schema, list_array, matrix
from quantaloom.session import BROADCAST_LIMIT

Encoder = Callable[[list[str]], np.ndarray]

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda x: np.maximum(x, 0.0),
    "tanh": np.tanh,
    "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
    "leakyrelu": lambda x: np.where(x > 0, x, 0.01 * x),
    "none": lambda x: x,
}


def embed(
    df: DataFrame, fields: list[str], encoder: Encoder, dim: int, batch_size: int = 32, prefix: str = "emb_"
) -> DataFrame:
    """One ``emb_<field>`` vector per text field; missing and blank texts give the zero vector.

    The encoder gets lists of at most ``batch_size`` texts and returns one row per text, used as it is.
    """

    def vectors(column: pa.Array) -> np.ndarray:
        texts = column.to_pylist()
        out = np.zeros((len(texts), dim), dtype=np.float32)
        at = [i for i, t in enumerate(texts) if t is not None and t.strip()]
        for start in range(0, len(at), batch_size):
            rows = at[start : start + batch_size]
            out[rows] = np.asarray(encoder([texts[i] for i in rows]), dtype=np.float32)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _extend(batch, {prefix + f: list_array(vectors(batch.column(f)), pa.float32()) for f in fields})

    return df.mapInArrow(run, _schema(df, *[f"{prefix}{f} array<float>" for f in fields]))


def dense_score(
    df: DataFrame,
    weights: list[tuple[np.ndarray, np.ndarray]],
    activation: str = "relu",
    vector: str = "embedding",
    name: str = "scored",
) -> DataFrame:
    """Vectors passed through dense layers ``(out×in weights, bias)``; no activation after the last."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"unknown activation {activation!r}")
    if sum(w.nbytes + b.nbytes for w, b in weights) > BROADCAST_LIMIT:
        raise ValueError("weights are beyond the broadcast bound")
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = shared.value
        for batch in batches:
            x = matrix(batch.column(vector))
            for i, (w, b) in enumerate(layers):
                x = x @ np.asarray(w, dtype=np.float64).T + b
                if i + 1 < len(layers):
                    x = ACTIVATIONS[activation](x)
            yield _extend(batch, {name: list_array(x, pa.float64())})

    return df.mapInArrow(run, _schema(df, f"{name} array<double>"))
