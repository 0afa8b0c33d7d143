"""Encoding an unbounded source with a fixed codebook, and folding mini-batches into a codebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quantaloom.operators.assign import encode_levels, load_levels
from quantaloom.operators.training import ema_state, ema_step
from quantaloom.session import BROADCAST_LIMIT


def encode_stream(
    stream: DataFrame, codebook: DataFrame, vector: str = "embedding", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Stateless residual encoding of a streaming frame; the codebook is read once at start."""
    return encode_levels(stream, load_levels(codebook, limit), vector)


class CodebookUpkeep:
    """EMA codebook kept as one Parquet folder per mini-batch under a state folder.

    A batch reads the newest state before it and writes its own folder, so a batch that runs again after
    a failure starts from the same state and replaces only its own output. Only the ``KEPT`` newest states stay:
    Spark runs again at most the batch after the last one it has committed, so older ones are never read. The
    folder that is listed at a batch thus holds the same few names however long the stream runs.
    """

    KEPT = 3

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        codebook: DataFrame,
        decay: float = 0.99,
        eps: float = 1e-5,
        mode: str = "ema",
        vector: str = "embedding",
        idx: str = "idx",
    ):
        self.spark, self.folder = spark, folder
        self.decay, self.eps, self.mode = decay, eps, mode
        self.vector, self.idx = vector, idx
        if not self._ids() and not self._written(-1):
            ema_state(codebook).write.mode("overwrite").parquet(self._path(-1))

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/batch={batch_id:012d}" if batch_id >= 0 else f"{self.folder}/start"

    def _at(self, name: str):
        """A path and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, batch_id: int) -> bool:
        path, fs = self._at(self._path(batch_id) + "/_SUCCESS")
        return fs.exists(path)

    def _ids(self) -> list[int]:
        """Batches whose state is whole, oldest first."""
        root, fs = self._at(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [i for i in sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=")) if self._written(i)]

    def state(self, before: int | None = None) -> DataFrame:
        """Newest state, or the newest one older than batch ``before``."""
        held = self._ids()
        ids = [i for i in held if before is None or i < before]
        if before and len(held) >= self.KEPT and not ids:
            raise ValueError(f"the states before batch {before} are gone; the oldest kept is of batch {held[0]}")
        return self.spark.read.parquet(self._path(ids[-1] if ids else -1))

    def codebook(self) -> DataFrame:
        return self.state().select(F.lit(1).alias("level"), "code", "centroid")

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        updated = ema_step(self.state(before=batch_id), batch, self.decay, self.eps, self.mode, self.vector, self.idx)
        updated.write.mode("overwrite").parquet(self._path(batch_id))
        for old in self._ids()[: -self.KEPT]:
            path, fs = self._at(self._path(old))
            fs.delete(path, True)

    def attach(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.fold)
