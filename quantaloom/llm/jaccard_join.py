"""N-gram Jaccard join: a size-aware heavy-light join that finds the groups of near copies.

Two texts link when ``100 * intersection >= percent * union`` of their sets of word shingles. Sets are represented by
64-bit hashes of their shingles; equal sets form a class, and only classes are joined. Let d be the largest
symmetric difference that two linked sets of n and m shingles may have.

* Light sets (few shingles): all subsets of the fixed sizes that a partner can share are enumerated, at most a few
  hundred per set, and sets that share a subset and are small enough together link. The smallest holder of a subset
  links with every other holder that any holder links with, so each list needs one pass against its head.
* Heavy sets: shingles are dealt to a quarter more than 1 + d ranges of the hash, so that two linked sets agree on many
  ranges as a whole. Each range's content is the key of an inverted list. A set leaves out as many of its most frequent
  keys as the number of agreed ranges allows, which takes passages and phrases that many texts share out of the join.
  A list is scanned against its head first, then against a few others; what these do not settle (holders in other
  components) is compared within the list afterwards.
* The boundary between light and heavy is the size with the least total cost, from the counts of sets of each size:
  subsets for light sets; list entries, and one comparison's share of shingles, for heavy ones.

Candidate pairs are verified on the texts. Components come from alternating star contraction, which only takes
minima. Copies of a text are told apart from near copies before anything is compared; a task sends the keys of a set
once, however many copies it reads.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; a text with
fewer than ``k`` words is one shingle; repeated rows are copies; rows with null doc_id are joined too, and
component_id is the least doc_id that is not null (null if there is none). Other columns are ignored. Two different
sets of equal size are taken as equal only if 64-bit hashes of both agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.llm.common import fresh, packed, release, salted_join, slices
from quantaloom.session import broadcast_if_small, cut

LANE_GROWTH = 1.5
COMPARE_COST = 1.0  # cost of one shingle in a comparison, against one list entry
BLOOM_BITS, BLOOM_BLOCK = 1 << 25, 1 << 18
SEEN_SETS = 1 << 20
ROUNDS = 2  # further heads of a list before its open pairs are compared
MASK_WORDS = 32  # 64-bit words of the masks that rule out pairs inside a list
MASK = [f"m{i}" for i in range(MASK_WORDS + 5)]


# -- sets of shingles -----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = np.random.default_rng(1).integers(0, 2**63, 256).astype(np.uint64)  # a number per byte, capitals as small letters
BYTE[65:91] = BYTE[97:123]
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
STEP = 1 << 18  # bytes hashed at a time
PIECE = 1 << 20  # bytes of texts (or one longer text) whose sets a task holds at a time
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values of an array that may be sorted in place."""
    values.sort()
    keep = np.empty(len(values), bool)
    keep[:1] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and the words in each text.

    The hash of a word is a polynomial of its bytes, taken from running sums over the whole buffer.
    """
    text = b" ".join([t or b"" for t in texts]) + b" "
    hashes, starts, at = [], [], 0
    while at < len(text):  # a bounded number of bytes at a time, cut after a space
        cut_at = text.rfind(b" ", at, at + STEP) + 1 or text.find(b" ", at + STEP) + 1
        own, start = _word_hashes(np.frombuffer(text, np.uint8, cut_at - at, at))
        hashes.append(own)
        starts.append(start + at)
        at = cut_at
    limits = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), limits), prepend=0)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer that ends in a space."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE[data] * _power(BASE, len(data)), out=sums[1:])
        hashes = _mix((sums[end] - sums[start]) * _power(INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    return hashes, start


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    word, n = _words(texts)
    starts = np.cumsum(n) - n
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    rolled = np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            rolled = _mix(rolled * np.uint64(BASE) + padded[j : j + len(word)] + np.uint64(j + 1))
    out = []
    for at, count in zip(starts.tolist(), n.tolist()):
        if count >= k:
            out.append(_distinct(rolled[at : at + count - k + 1].copy()))
        elif count:
            with np.errstate(over="ignore"):
                h = np.zeros(1, np.uint64)
                for w in word[at : at + count]:
                    h = _mix(h * np.uint64(BASE) + w + np.uint64(977 + count))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_number(s: np.ndarray) -> int:
    """A signed 64-bit number for a whole set."""
    with np.errstate(over="ignore"):
        total = _mix(_mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(total.astype(np.int64)[0])


def links(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def least_common(total: int, percent: int) -> int:
    """The smallest intersection with which two sets of ``total`` shingles together can link."""
    return -(-percent * total // (100 + percent))


def largest_partner(n: int, percent: int) -> int:
    return 100 * n // percent


# -- keys -----------------------------------------------------------------------------------------------


def subset_sizes(n: int, percent: int) -> list[int]:
    """How many shingles a set of n may lack of a subset that it shares with a partner, for all partners."""
    low, high = -(-percent * n // 100), largest_partner(n, percent)
    return sorted({n - least_common(n + m, percent) for m in range(low, high + 1) if least_common(n + m, percent) <= min(n, m)})


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in subset_sizes(n, percent))


def lanes(n: int, percent: int) -> list[int]:
    """Numbers of hash ranges under which a set of n is listed: enough for its own size, and for larger partners."""

    def needed(size: int) -> int:  # no pair with a larger set of this size differs in as many shingles
        return 2 * size * (100 - percent) // (100 + percent) + 1

    parts, out = 2, []
    while not out or out[-1] < needed(largest_partner(n, percent)):
        if parts >= needed(n):
            out.append(parts)
        parts = int(parts * LANE_GROWTH) + 1
    return out


def ranges_of(parts: int) -> int:
    """Hash ranges of a lane for differences below ``parts``: a quarter more, so that linked sets agree on many."""
    return parts + parts // 4 + 3


def largest_difference(n: int, parts: int, percent: int) -> int:
    """Bounds the difference of a set of n from all partners that it meets in this lane."""
    top = largest_partner(n, percent)
    if percent < 100:
        top = min(top, (parts * (100 + percent) - 1) // (2 * (100 - percent)))
    return max(t - 2 * least_common(t, percent) for t in (n + top, n + top - 1))


def light_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the subsets; a subset's hash is a sum, so leaving shingles out is a subtraction."""
    out = []
    with np.errstate(over="ignore"):
        mixed = _mix(s)
        total = mixed.sum(dtype=np.uint64)
        for d in subset_sizes(len(s), percent):
            if d == 0:
                left = np.array([total])
            elif d == 1:
                left = total - mixed
            else:
                pick = np.array(list(combinations(range(len(s)), d)))
                left = total - mixed[pick].sum(1, dtype=np.uint64)
            out.append(_mix(left + np.uint64(len(s) - d) * np.uint64(0x9E3779B97F4A7C15)))
    return _distinct(np.concatenate(out))


def heavy_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key for each lane and hash range, the lane of each, and how many of the lane's keys may be left out.

    Linked sets agree on ``agreed`` ranges at least. Empty ranges, which all sets have in common, stay unlisted
    where a full one is sure to be among these; then as many of the other keys may go as leave one of them.
    """
    out, lane, spare = [], [], []
    with np.errstate(over="ignore"):
        mixed = _mix(s + np.uint64(0x632BE59BD9B4E019))
        for parts in lanes(len(s), percent):
            n = ranges_of(parts)
            agreed = n - largest_difference(len(s), parts, percent)
            width = np.uint64((1 << 64) // n + 1)
            at = (s // width).astype(np.int64)
            sums = np.zeros(n, np.uint64)
            edge = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            sums[at[edge]] = np.add.reduceat(mixed, edge)
            full = np.zeros(n, bool)
            full[at[edge]] = True
            left = agreed - 1 - int((~full).sum())
            listed = np.flatnonzero(full) if left >= 0 else np.arange(n)
            out.append(_mix(sums[listed] + _mix(listed.astype(np.uint64) + np.uint64(n << 32))))
            lane.append(np.full(len(listed), parts))
            spare.append(np.full(len(listed), max(left, 0)))
    return np.concatenate(out), np.concatenate(lane), np.concatenate(spare)


# -- candidates -----------------------------------------------------------------------------------------


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def describe(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, digest (md5 of the text), n (size of the set), node (the set's number; 0 without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", size=PIECE):
                sets = shingle_sets(rows.column("text").to_pylist(), k)
                n = pa.array([len(s) for s in sets], pa.int64())
                node = pa.array([set_number(s) if len(s) else 0 for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("digest"), n, node], ["doc_id", "digest", "n", "node"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.withColumn("digest", F.md5("text")).mapInArrow(run, "doc_id long, digest string, n long, node long")


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The least size of a heavy set that minimises the cost over all sets; ``sizes`` counts sets by size."""
    top = 2
    while top < 200 and subset_count(top, percent) <= 2000:
        top += 1
    small = sorted(n for n in sizes if n < top)
    light = {n: sizes[n] * subset_count(n, percent) for n in small}
    heavy = {n: sizes[n] * (sum(map(ranges_of, lanes(n, percent))) + COMPARE_COST * n) for n in small}
    best, bound, cost = 0.0, 1, 0.0
    for n in small:
        cost += light[n] - heavy[n]
        if cost <= best:
            best, bound = cost, n + 1
    return bound


def _sets_once(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(node, set) of the texts, piece by piece; a copy is passed over where the task remembers its set."""
    seen: set[int] = set()
    for batch in batches:
        for rows in slices(batch, "text", size=PIECE):
            out = []
            for s in shingle_sets(rows.column("text").to_pylist(), k):
                node = set_number(s) if len(s) else 0
                if len(s) and node not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(node)
                    out.append((node, s))
            yield out


def _keys(s: np.ndarray, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lanes and keys that may be left out: of a light set its subsets (lane 0), of a heavy one, or one near them, its ranges."""
    parts = []
    if len(s) < boundary:
        light = light_keys(s, percent)
        parts.append((light, np.zeros(len(light), np.int64), np.zeros(len(light), np.int64)))
    if len(s) >= -(-percent * boundary // 100):
        parts.append(heavy_keys(s, percent))
    return tuple(np.concatenate(x) for x in zip(*parts))


def shared_keys(documents: DataFrame, k: int, percent: int, boundary: int) -> DataFrame:
    """key, n of the keys that were sent twice or more. A key is eight bytes, counted before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets_once(batches, k):
            if sets:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate([_keys(s, percent, boundary)[0] for _, s in sets]).view(np.int64)})

    counted = _texts(documents).mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("times"))
    return counted.where("times > 1")


def postings(documents: DataFrame, keys: DataFrame, k: int, percent: int, boundary: int) -> DataFrame:
    """key, node, n, lane, spare for the sets' keys that are shared; a table of fixed size drops most others in the task."""
    table = documents.sparkSession.sparkContext.broadcast(_bloom(keys.select(F.col("key").alias("node"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets_once(batches, k):
            found = []
            for node, s in sets:
                key, lane, spare = _keys(s, percent, boundary)
                key = key.view(np.int64)
                at = np.flatnonzero(_in_bloom(table.value, key))
                found.append((key[at], np.full(len(at), node), np.full(len(at), len(s)), lane[at], spare[at]))
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("key", "node", "n", "lane", "spare"), map(np.concatenate, zip(*found)))))

    posted = _texts(documents).mapInArrow(run, "key long, node long, n long, lane long, spare long")
    return posted.join(keys, "key")


def shared_lists(posted: DataFrame) -> DataFrame:
    """The lists that remain: key, node, n, light.

    Of two linked sets the first key that they share, rarest first, is among those that either keeps when it leaves
    out as many of its most frequent keys as it may: a set with few shared keys leaves the join, and the lists of
    passages that many texts have go before anything is compared.
    """
    order = Window.partitionBy("node", "lane").orderBy(F.desc("times"), F.desc("key"))
    rows = posted.dropDuplicates(["key", "node"]).withColumn("place", F.row_number().over(order)).where("place > spare")
    return rows.select("key", "node", "n", (F.col("lane") == 0).alias("light"))


def with_heads(lists: DataFrame, head: Column) -> DataFrame:
    """The lists of two or more sets, with the least ``head`` of each list."""
    heads = lists.groupBy("key").agg(F.min(head).alias("head"), F.min("node").alias("low"), F.max("node").alias("high"))
    return lists.join(heads.where("low < high").select("key", "head"), "key")


# -- verification ---------------------------------------------------------------------------------------


def _bloom(nodes: DataFrame) -> np.ndarray:
    """A bit for each of the nodes (or keys), by their lowest bits: a table of fixed size, made a block at a time."""

    def block(rows: pa.Table) -> pa.Table:
        bits = np.zeros(BLOOM_BLOCK, np.uint8)
        bits[rows.column("bit").to_numpy() % BLOOM_BLOCK] = 1
        at = rows.column("bit")[0].as_py() // BLOOM_BLOCK
        return pa.table({"block": [at], "words": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bit = nodes.select(F.col("node").bitwiseAND(F.lit(BLOOM_BITS - 1)).alias("bit")).distinct()
    table = np.zeros(BLOOM_BITS // 32, np.uint32)
    blocks = bit.groupBy(F.expr(f"bit div {BLOOM_BLOCK}")).applyInArrow(block, "block long, words binary")
    for row in blocks.collect():  # 4 MB at most, in one job
        words = np.frombuffer(row["words"], np.uint32)
        table[row["block"] * len(words) : (row["block"] + 1) * len(words)] = words
    return table


def _in_bloom(table: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    low = nodes & (BLOOM_BITS - 1)
    return ((table[low >> 5] >> (low & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)


def texts_of(documents: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, text for each of the nodes. A table of fixed size drops most other texts before they move."""
    table = documents.sparkSession.sparkContext.broadcast(_bloom(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows in slices(batch, "text", size=PIECE):
                sets = shingle_sets(rows.column("text").to_pylist(), k)
                node = np.array([set_number(s) if len(s) else 0 for s in sets], np.int64)
                keep = _in_bloom(table.value, node) & np.array([len(s) > 0 for s in sets])
                for j in np.flatnonzero(keep):
                    if node[j] in seen:
                        keep[j] = False
                    elif len(seen) < SEEN_SETS:
                        seen.add(int(node[j]))
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), rows.column("text").take(at)], ["node", "text"])

    rows = _texts(documents).mapInArrow(run, "node long, text binary")
    return rows.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text_a", rows=64, size=PIECE):
                a, b = (rows.column(c).dictionary_encode() for c in ("text_a", "text_b"))
                of_a, of_b = (shingle_sets(x.dictionary.to_pylist(), k) for x in (a, b))
                keep = [
                    links(len(of_a[p]), len(of_b[q]), len(np.intersect1d(of_a[p], of_b[q], assume_unique=True)), percent)
                    for p, q in zip(a.indices.to_pylist(), b.indices.to_pylist())
                ]
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def masks(texts: DataFrame, k: int) -> DataFrame:
    """node, n, mask: for each of 64 * MASK_WORDS values of a shingle's hash, whether the set has an odd number of them.

    Two sets differ in at least as many shingles as their masks differ in bits. The mask folded to one word and to
    four, which holds as well and is quicker to compare, comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", size=PIECE):
                bits = np.zeros((rows.num_rows, 64 * MASK_WORDS), np.uint8)
                sets = shingle_sets(rows.column("text").to_pylist(), k)
                n = pa.array([len(s) for s in sets], pa.int32())
                for j, s in enumerate(sets):
                    bits[j] = np.bincount((s % np.uint64(64 * MASK_WORDS)).astype(np.int64), minlength=64 * MASK_WORDS) & 1
                words = np.packbits(bits, axis=1).view(np.int64)
                four = np.bitwise_xor.reduce(words.reshape(len(words), -1, 4), axis=1)
                one = np.bitwise_xor.reduce(four, axis=1)[:, None]
                words = np.concatenate([one, four, words], axis=1)
                columns = [pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(MASK))]
                yield pa.RecordBatch.from_arrays([rows.column("node"), n, *columns], ["node", "n", *MASK])

    return texts.select("node", "text").mapInArrow(run, "node long, n int, " + ", ".join(f"{c} long" for c in MASK))


def _renamed(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether the masks of two sets differ in no more bits than linked sets may differ in shingles.

    The words are columns of their own, which keeps the compiled condition small enough for the JVM to optimise.
    """
    bits = [F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in MASK]
    most = (F.col(f"{a}_n") + F.col(f"{b}_n")) * (100 - percent)
    one, four, all_ = ((sum(part[1:], part[0]) * (100 + percent) <= most) for part in (bits[:1], bits[1:5], bits[5:]))
    return one & four & all_


def plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose masks allow a link."""
    left, right = _renamed(marks, "a"), _renamed(marks, "b")
    joined = pairs.join(left, pairs["a"] == left["a_node"]).join(right, pairs["b"] == right["b_node"])
    return joined.where(_alike("a", "b", percent)).select("a", "b")


# -- components -----------------------------------------------------------------------------------------


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (a, b), a > b, either has one edge down or is the lower end of all its edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    found = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return found.where("down > 1 OR (down > 0 AND least = 0)").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of the edges (a, b).

    Large and small star steps alternate until only stars are left; both only need the least neighbour of a node.
    """
    rows = edges.count()
    ordered = packed(edges, rows).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(packed(ordered.distinct(), rows))
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = packed(packed(large, rows).distinct(), rows)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = packed(large.join(least, "a"), rows)
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(packed(small.distinct(), rows))
        release(edges.sparkSession)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return packed(roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), 2 * rows)


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The components once the found pairs are linked as well; the stars of the former ones stand for their edges."""
    return cut(components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)))


def _pairs(a: str, b: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root of the lists whose sets are in different components so far."""
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rooted.join(keys.select("key"), "key", "left_semi").select("key", "node", "root")


def linked_sets(documents: DataFrame, k: int, percent: int, sizes: dict[int, int]) -> DataFrame:
    """node, root of all sets that link with another set."""
    boundary = choose_boundary(sizes, percent)
    keys = cut(shared_keys(documents, k, percent, boundary))
    lists = cut(with_heads(shared_lists(postings(documents, keys, k, percent, boundary)), F.struct("n", "node")))
    release(documents.sparkSession)
    entries = lists.count()
    others = lists.where(F.col("node") != F.col("head.node"))
    pairs = _pairs("node", "head_node", others.where(F.col("light") | (F.col("head.n") * 100 >= F.col("n") * percent)).withColumn("head_node", F.col("head.node")))
    texts = cut(texts_of(documents, lists.select("node").distinct(), k))
    release(documents.sparkSession)
    marks = cut(packed(masks(texts, k), texts.count()))
    # most pairs that only share a key end here, on their masks; texts move for the others alone
    seen = cut(packed(plausible(pairs, marks, percent), entries))
    edges = cut(packed(verified(seen, texts, k, percent), seen.count()))
    release(documents.sparkSession)
    roots = cut(components(edges))
    # what the heads did not settle: sets of one list in different components. Another head of each list, the same for
    # the lists of a family, joins most of them in one comparison a set
    left = cut(packed(_open(lists.where(~F.col("light")), roots), entries))
    for turn in range(ROUNDS):
        if left.isEmpty():
            return roots
        headed = with_heads(left, F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "root")).where("root <> head.root")
        pairs = _pairs("node", "head_node", headed.withColumn("head_node", F.col("head.node"))).join(seen, ["a", "b"], "left_anti")
        more = cut(packed(plausible(pairs, marks, percent), left.count()))
        seen = seen.unionByName(more)
        found = cut(packed(verified(more, texts, k, percent), more.count()))
        if not found.isEmpty():
            roots = _joined(roots, found)
            left = cut(packed(_open(left.select("key", "node"), roots), left.count()))
    # the rest exactly: all pairs of a list in different components that their masks allow
    left = left.join(marks, "node")
    one, other = _renamed(left, "a"), _renamed(left, "b")
    fits = (F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("b_n") * 100 >= F.col("a_n") * percent)
    more = one.join(other, (one["a_key"] == other["b_key"]) & (F.col("a_root") < F.col("b_root")) & fits & _alike("a", "b", percent))
    more = cut(_pairs("a_node", "b_node", more).join(seen, ["a", "b"], "left_anti"))
    rows = more.count()
    if not rows:
        return roots
    return _joined(roots, cut(packed(verified(more, texts, k, percent), rows)))


def near_copies(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, digest (md5 of the text), n_shingles, node (equal for equal sets), component_id."""
    described = cut(describe(documents, k))
    sizes = {r["n"]: r["count"] for r in described.where("n > 0").groupBy("n").count().collect()}  # by size, not by set
    roots = linked_sets(documents, k, percent, sizes)
    row = F.monotonically_increasing_id()  # deals the rows of a large group of copies to many tasks
    named = salted_join(described, roots, ["node"], row, "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    named = cut(named)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = salted_join(named, least, ["root"], row, "left", salts=8)
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "digest", F.col("n").alias("n_shingles"), "node", own.alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns kept, one of each component: that with the least doc_id.

    Rows without shingles or without a doc_id all stay; rows equal in doc_id and text stay or go together.
    """
    found = near_copies(documents.select("doc_id", "text"), k, percent)
    gone = found.where("n_shingles > 0 AND doc_id <> component_id").select("doc_id", "digest").distinct()
    digest = fresh(documents.columns, "text_digest")
    keyed = documents.withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    names = {c: fresh(keyed.columns, f"gone_{c}") for c in gone.columns}
    gone = broadcast_if_small(gone.select(*[F.col(c).alias(n) for c, n in names.items()]), 96)
    same = (keyed["doc_id"] == gone[names["doc_id"]]) & (keyed[digest] == gone[names["digest"]])
    return keyed.join(gone, same, "left_anti").select(*documents.columns)
