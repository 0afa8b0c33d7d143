"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
TASK_ROWS, LEAST_TASKS = 5_000, 8  # narrow rows that are worth a task, and the fewest tasks of a packed frame


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairwise(values: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(values[i], values[i + step]) for every i; the second is null past the end."""
    return let(values, lambda a: F.transform(a, lambda x, i: combine(x, F.get(a, i + F.lit(step)))))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case and nothing else; words without capitals skip the slow translation."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, ASCII_UPPER, ASCII_LOWER))


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that is not taken yet (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quantaloom-")


def shared_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, and no copy in one executor's memory."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than these fill: a small frame leaves few files behind.

    Each file of a checkpoint or shuffle takes a block on disk, and may cost a process that sets its mode.
    """
    return df.coalesce(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS))


def gathered(df: DataFrame) -> Iterator[Row]:
    """The rows of a frame of bounded size, a part at a time.

    Each part is a job of its own, which the driver remembers, so there are few of them at any number of shuffle partitions.
    """
    return df.repartition(LEAST_TASKS).toLocalIterator()


def release(spark: SparkSession) -> None:
    """Removes the shuffle files of finished rounds: Spark does so once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique: a key that many left rows share goes to ``salts`` tasks.

    ``spread`` deals the left rows of a key to these tasks; each row of the right side is sent to all of them.
    """
    salt = fresh([*left.columns, *right.columns], "salt")
    dealt = left.withColumn(salt, F.pmod(F.hash(spread), F.lit(salts)))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def slices(batch: pa.RecordBatch, column: str, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows and about ``size`` bytes of ``column``; a longer text is a piece."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = taken = 0
    for i, n in enumerate(length.tolist()):
        if i > at and (i - at == rows or taken + n > size):
            yield batch.slice(at, i - at)
            at, taken = i, 0
        taken += n
    if batch.num_rows > at:
        yield batch.slice(at)
