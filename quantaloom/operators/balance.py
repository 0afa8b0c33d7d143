"""Capacity-constrained assignment of a whole table to codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions.vectors import as_double
from quantaloom.operators.assign import (
    BLOCK,
    Level,
    distances,
    load_levels,
    matrix,
    opened,
    residual,
    share,
)
from quantaloom.operators.sums import vector_sum
from quantaloom.session import BROADCAST_LIMIT, cut

# Percentile, share and floor of the temperature estimate.
TAU_PERCENTILE, TAU_SHARE, TAU_FLOOR = 90, 0.1, 1e-6
BINS, FEW_VALUES = 65_536, 10_000


def _nth(df: DataFrame, column: str, n: int, low: float, high: float) -> float:
    """The n-th smallest value (from 0) of a column that lies between ``low`` and ``high``.

    Bin counts narrow the interval down until few values are left; only those are sorted.
    """
    own = df.where(F.col(column).between(low, high))
    count = own.count()
    while count > FEW_VALUES and low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")
        ends = [F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")]
        for r in sorted(own.groupBy(bin_).agg(*ends).collect()):
            if n < r["n"]:
                break
            n -= r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high, count = r["low"], r["high"], r["n"]
        own = own.where(F.col(column).between(low, high))
    return low if low == high else sorted(r[0] for r in own.select(column).collect())[n]


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column; the mean of the two middle values for an even count."""
    ends = df.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).head()
    if not ends["n"]:
        return None
    middle = {(ends["n"] - 1) // 2, ends["n"] // 2}
    values = [_nth(df, column, m, ends["low"], ends["high"]) for m in middle]
    return sum(values) / len(values)


def estimate_tau(
    df: DataFrame, codebook: DataFrame, vector: str = "residual", idx: str = "idx", limit: int = BROADCAST_LIMIT
) -> float:
    """A tenth of the median, over all rows, of the 90th percentile of distances above the row minimum."""
    level = load_levels(codebook, limit)[0]
    shared = share(df, [level])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (book,) = opened(shared)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = distances(matrix(batch.column(vector)), book)
            spread = np.percentile(d - d.min(1, keepdims=True), TAU_PERCENTILE, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(spread)], names=["spread"])

    spreads = cut(df.select(idx, vector).mapInArrow(run, "spread double"))
    return max((exact_median(spreads, "spread") or 0.0) * TAU_SHARE, TAU_FLOOR)


def capacities(n: int, k: int) -> np.ndarray:
    """Equal shares of ``n`` rows over ``k`` codes; the first codes take the remainder."""
    out = np.full(k, n // k, dtype=np.int64)
    out[: n % k] += 1
    return out


def _blocks(x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    step = max(BLOCK // max(k, 1), 1)
    for start in range(0, len(x), step):
        yield x[start : start + step]


def _log_plan(x: np.ndarray, level: Level, potential: np.ndarray, tau: float) -> np.ndarray:
    """Log share each code gets of each row under the column potentials."""
    score = potential[None, :] - distances(x, level) / tau
    top = score.max(1, keepdims=True)
    return score - top - np.log(np.exp(score - top).sum(1, keepdims=True))


def column_potentials(
    df: DataFrame, level: Level, target: np.ndarray, tau: float, iters: int, vector: str
) -> np.ndarray:
    """Log column scalings that bring the plan's column mass to ``target``.

    Only one number per code lives outside the tasks; each step sums the plan's columns, per batch
    first, and no plan is ever stored.
    """
    spark = df.sparkSession
    k = len(level.codes)
    shared = share(df, [level])
    potential = np.zeros(k)
    goal = np.log(np.maximum(target, 1e-300))
    n = float(target.sum())
    for _ in range(iters):
        scaled = spark.sparkContext.broadcast(potential)

        def run(batches: Iterator[pa.RecordBatch], scaled=scaled) -> Iterator[pa.RecordBatch]:
            (book,) = opened(shared)
            total = np.zeros(k)
            for batch in batches:
                for part in _blocks(matrix(batch.column(vector)), k):
                    total += np.exp(_log_plan(part, book, scaled.value, tau)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["mass"])

        mass = np.array(vector_sum(df.select(vector).mapInArrow(run, "mass array<double>"), [], "mass", k).head()[0])
        potential = potential + goal - np.log(np.maximum(mass, 1e-300))
        if np.abs(mass - target).sum() < 1e-9 * n:
            break
    return potential


# A code admits rows from a key on: 64 bits of the score in order, then 64 bits of a seeded hash of the row number.
TOP, HALF = (1 << 128) - 1, (1 << 64) - 1
BIN_BITS = 10


class Cutoffs:
    """Per code, the key from which rows are let in, and a bound above the key at which its room ends."""

    def __init__(self, room: np.ndarray):
        self.low = [0 if r > 0 else TOP for r in room.tolist()]
        self.high = [TOP] * len(room)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both halves of the lowest keys, and the bits by which a distance to them is shifted into a bin."""
        bits = [max((h - v - 1).bit_length() - BIN_BITS, 0) if h > v else 0 for v, h in zip(self.low, self.high)]
        upper, lower = [v >> 64 for v in self.low], [v & HALF for v in self.low]
        return np.array(upper, np.uint64), np.array(lower, np.uint64), np.array(bits, np.uint64)

    def lift(self, at: int, bin_: int) -> None:
        """Raise a code to the lower end of the bin that holds the last row it has room for."""
        low, bits = self.low[at], max((self.high[at] - self.low[at] - 1).bit_length() - BIN_BITS, 0)
        if bits == 0 and bin_ == 0:
            raise ValueError("row numbers must be unique")
        self.low[at] = low + (bin_ << bits)
        self.high[at] = min(low + ((bin_ + 1) << bits), TOP) if bin_ < 1 << BIN_BITS else TOP


def _ordered_bits(score: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the scores."""
    bits = (score + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _admitted(score: np.ndarray, tie: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    key = _ordered_bits(score)
    return (key > upper) | ((key == upper) & (tie >= lower))


def _bins(score: np.ndarray, tie: np.ndarray, upper: np.ndarray, lower: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bin of each admitted key above its code's lowest; all beyond the last bin share the one after it."""
    small, wide = np.uint64(64), bits >= 64
    rest = tie - lower
    over = _ordered_bits(score) - upper - (tie < lower)
    inner = np.clip(bits, 1, 63).astype(np.uint64)
    narrow = np.where(bits == 0, rest, (over << (small - inner)) | (rest >> inner))
    beyond = np.where(bits == 0, over, over >> inner)
    out = np.where(wide, over >> np.where(wide, bits - small, 0).astype(np.uint64), np.where(beyond > 0, HALF, narrow))
    return np.minimum(out, np.uint64(1 << BIN_BITS)).astype(np.int32)


def _candidates(
    df: DataFrame, level: Level, potential: np.ndarray, tau: float, cutoffs: Cutoffs, topk: int, vector: str, idx: str
) -> DataFrame:
    """At most ``topk`` codes that would admit each row, best first: ``idx, tie, picks array<struct<at, score>>``."""
    shared = share(df, [level])
    state = df.sparkSession.sparkContext.broadcast((potential, *cutoffs.arrays()))
    width = int(min(topk, len(level.codes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (book,), (scaled, upper, lower, _) = opened(shared), state.value
        for batch in batches:
            tie = batch.column("tie").to_numpy().view(np.uint64)
            places, scores, done = [], [], 0
            for part in _blocks(matrix(batch.column(vector)), len(book.codes)):
                plan = _log_plan(part, book, scaled, tau)
                own = tie[done : done + len(part), None]
                plan = np.where(_admitted(plan, own, upper[None, :], lower[None, :]), plan, -np.inf)
                done += len(part)
                # the best few without sorting all codes: picked in the order of codes, then by score
                order = np.sort(np.argpartition(-plan, width - 1, axis=1)[:, :width], axis=1)
                best = np.argsort(-np.take_along_axis(plan, order, 1), axis=1, kind="stable")
                order = np.take_along_axis(order, best, 1)
                places.append(order)
                scores.append(np.take_along_axis(plan, order, 1))
            if not places:
                continue
            at, score = np.concatenate(places).astype(np.int32), np.concatenate(scores)
            some = score > -np.inf
            offsets = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(at[some]), pa.array(score[some])], names=["at", "score"])
            picks = pa.ListArray.from_arrays(pa.array(offsets), items)
            yield pa.RecordBatch.from_arrays([batch.column(idx), batch.column("tie"), picks], names=[idx, "tie", "picks"])

    kind = df.schema[idx].dataType.simpleString()
    columns = f"`{idx}` {kind}, tie long, picks array<struct<at:int,score:double>>"
    return df.select(idx, "tie", vector).mapInArrow(run, columns)


def _asks(batch: pa.RecordBatch, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which rows are admitted anywhere, and the code, score and tie of the first pick that admits each of these."""
    picks = batch.column("picks")
    flat = picks.flatten()
    at, score = flat.field("at").to_numpy(), flat.field("score").to_numpy()
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(picks).to_numpy())
    tie = batch.column("tie").to_numpy().view(np.uint64)[row]
    usable = np.flatnonzero(_admitted(score, tie, upper[at], lower[at]))
    rows, first = np.unique(row[usable], return_index=True)
    found = usable[first]
    return rows, at[found], score[found], tie[found]


def _overfull(waiting: DataFrame, cutoffs: Cutoffs, room: np.ndarray) -> tuple[dict[int, int], int]:
    """The bin in which the room of each code that too many rows ask for ends, and the rows that no pick admits.

    One pass over the lists: counts per code and bin, summed from the best bin down inside a code (at most
    1,025 bins, whatever the rows). A row per code comes to the driver.
    """
    state = waiting.sparkSession.sparkContext.broadcast((*cutoffs.arrays(), room))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, lower, bits, left = state.value
        for batch in batches:
            rows, at, score, tie = _asks(batch, upper, lower)
            bins = _bins(score, tie, upper[at], lower[at], bits[at])
            cells, n = np.unique(at.astype(np.int64) * ((1 << BIN_BITS) + 1) + bins, return_counts=True)
            code, bin_ = np.divmod(cells, (1 << BIN_BITS) + 1)
            lost = batch.num_rows - len(rows)
            columns = [np.r_[code, -1], np.r_[left[code], 0], np.r_[bin_, 0], np.r_[n, lost]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["at", "room", "bin", "n"])

    counts = waiting.mapInArrow(run, "at long, room long, bin long, n long")
    counts = counts.groupBy("at", "room", "bin").agg(F.sum("n").alias("n"))
    code = Window.partitionBy("at")
    down = code.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.select("*", F.sum("n").over(code).alias("total"), F.sum("n").over(down).alias("upto"))
    ends = (F.col("total") > F.col("room")) & (F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("n") < F.col("room"))
    found = {r["at"]: r for r in summed.where((F.col("at") < 0) | ends).collect()}
    lost = found.pop(-1, None)
    return {at: r["bin"] for at, r in found.items()}, lost["n"] if lost else 0


def balance(
    df: DataFrame,
    codebook: DataFrame,
    iters: int = 30,
    tau: float | None = None,
    topk: int = 32,
    seed: int = 42,
    vector: str = "residual",
    idx: str = "idx",
    sizes: list[int] | None = None,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Assign every row to one code of a one-level codebook so that capacities hold exactly: ``idx, code``.

    Row preferences come from an entropic transport plan. Each code has a price, the least score it admits, and each
    row goes to the best code whose price it can pay; equal scores are told apart by a seeded hash of ``idx``, which
    must be unique. Prices start at nothing. Each round counts, in one pass over short lists, what every code is asked
    for by bins of the score, and raises the price of a code that is asked for too much to the lower end of the bin in
    which its room ends; bins get finer until the counts fit. No row is stored between rounds, and no group of rows
    meets in one task. The result is the stable one: no row and code would both gain by leaving their present partners.
    Rows whose lists are used up get fresh ones over the codes that still admit them.
    """
    level = load_levels(codebook, limit)[0]
    tie = F.xxhash64(F.lit(seed), F.col(idx)).alias("tie")
    rows = cut(df.select(idx, tie, as_double(F.col(vector)).alias(vector)))
    n, k = rows.count(), len(level.codes)
    room = capacities(n, k) if sizes is None else np.asarray(sizes, dtype=np.int64)
    if room.sum() < n:
        raise ValueError(f"capacities hold {room.sum()} of {n} rows")
    tau = tau if tau is not None else estimate_tau(rows, codebook, vector, idx, limit)
    potential = column_potentials(rows, level, room.astype(np.float64) * n / max(room.sum(), 1), tau, iters, vector)

    cutoffs = Cutoffs(room)
    waiting = cut(_candidates(rows, level, potential, tau, cutoffs, topk, vector, idx))
    while True:
        ends, lost = _overfull(waiting, cutoffs, room)
        for at, bin_ in ends.items():
            cutoffs.lift(at, bin_)
        if ends:
            continue
        if not lost:
            break
        listed, stuck = _parted(waiting, cutoffs, idx)
        again = rows.join(stuck, idx, "left_semi")
        waiting = cut(listed.unionByName(_candidates(again, level, potential, tau, cutoffs, topk, vector, idx)))
    return _placed(waiting, cutoffs, level.codes, idx)


def _parted(waiting: DataFrame, cutoffs: Cutoffs, idx: str) -> tuple[DataFrame, DataFrame]:
    """Lists that still admit their row, and the numbers of the rows without such a list."""
    state = waiting.sparkSession.sparkContext.broadcast(cutoffs.arrays())

    def keep(admitted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            upper, lower, _ = state.value
            for batch in batches:
                mask = np.full(batch.num_rows, not admitted)
                mask[_asks(batch, upper, lower)[0]] = admitted
                yield batch.filter(pa.array(mask))

        return waiting.mapInArrow(run, waiting.schema)

    return keep(True), keep(False).select(idx)


def _placed(waiting: DataFrame, cutoffs: Cutoffs, codes: np.ndarray, idx: str) -> DataFrame:
    """``idx, code``: the first pick that admits each row."""
    state = waiting.sparkSession.sparkContext.broadcast((*cutoffs.arrays(), codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, lower, _, names = state.value
        for batch in batches:
            rows, at, _, _ = _asks(batch, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column(idx).take(pa.array(rows)), pa.array(names[at])], names=[idx, "code"])

    return waiting.mapInArrow(run, f"`{idx}` {waiting.schema[idx].dataType.simpleString()}, code int")


def balance_last_level(
    df: DataFrame,
    codebook: DataFrame,
    vector: str = "embedding",
    codes: str = "codes",
    idx: str = "idx",
    limit: int = BROADCAST_LIMIT,
    **kw,
) -> DataFrame:
    """Re-assign only the last learned level of an encoded table under equal capacities.

    The prefix is subtracted once; the rows come back with ``codes`` changed at that level.
    """
    last = codebook.agg(F.max("level")).head()[0]
    left = residual(df, codebook, upto=last - 1, vector=vector, codes=codes, limit=limit)
    fresh = balance(left.select(idx, "residual"), codebook.where(F.col("level") == last), idx=idx, limit=limit, **kw)
    joined = df.join(fresh.withColumnRenamed("code", "__code"), idx)
    swapped = F.transform(codes, lambda c, i: F.when(i == last - 1, F.col("__code")).otherwise(c))
    return joined.select(*[swapped.alias(codes) if c == codes else F.col(c) for c in df.columns])
