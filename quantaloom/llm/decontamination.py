"""Benchmark decontamination: training texts that repeat windows of benchmark items.

A word is a maximal run of ``WORD`` characters, with A-Z in lower case. The windows of an item are its runs of
``n`` consecutive words; an item with fewer words, but not none, is one window. The windows become a hash table
that is broadcast, in several blocks if it is large; every text is cut into grams of the same lengths, whose
hashes are looked up, and each hit is compared word by word. Documents never move: a gram that matches nothing
ends in the task that read it, and a passage that many documents repeat costs one row per occurrence.

Defined results: null and empty texts have no words and are never hit; null, empty and repeated items add
nothing twice; rows with the same doc_id and text get the same result each, rows with the same doc_id and
different texts are told apart; columns beyond those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.llm.common import fresh, let, lower_ascii, pairwise
from quantaloom.session import BROADCAST_LIMIT, broadcast_if_small, cut

# capitals are let in here, since words are put in lower case one by one
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WINDOW_BYTES = 512


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def gram_hashes(words: Column, length: int) -> Column:
    """One hash per run of ``length`` words, built from the hashes of its halves."""
    hashed = F.transform(words, lambda w: F.xxhash64(lower_ascii(w)))

    def grow(doubled: list[Column], size: int) -> Column:
        if size * 2 <= length:
            return let(pairwise(doubled[-1], size, F.xxhash64), lambda a: grow([*doubled, a], size * 2))
        out, covered = doubled[-1], size
        for half in reversed(range(len(doubled) - 1)):
            if covered + 2**half <= length:
                out = _joined(out, doubled[half], covered)
                covered += 2**half
        return F.slice(out, F.lit(1), F.greatest(F.size(doubled[0]) - F.lit(length - 1), F.lit(0)))

    return let(hashed, lambda h: grow([h], 1))


def _joined(left: Column, right: Column, offset: int) -> Column:
    return F.transform(left, lambda x, i: F.xxhash64(x, F.get(right, i + F.lit(offset))))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows: length, gram, words, items (the ids that hold the window, as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text")).alias("words"))
    items = items.where((F.size("words") > 0) & F.col("item").isNotNull())
    items = items.withColumn("length", F.least(F.size("words"), F.lit(n)))
    parts = []
    for length in sorted(r[0] for r in items.select("length").distinct().collect()):  # at most n numbers
        part = items.where(F.col("length") == length).select(
            "item", "words", F.posexplode(gram_hashes(F.col("words"), length)).alias("at", "gram")
        )
        taken = F.transform(F.slice("words", F.col("at") + 1, F.lit(length)), lower_ascii)
        parts.append(part.select(F.lit(length).alias("length"), "gram", taken.alias("window"), "item"))
    if not parts:
        none = items.select("length", F.lit(0).cast("long").alias("gram"), F.col("words").alias("window"), "item")
        parts = [none.where(F.lit(False))]
    windows = reduce(DataFrame.unionByName, parts)
    return windows.groupBy("length", "gram", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def matches(documents: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BROADCAST_LIMIT // 4) -> DataFrame:
    """Every occurrence of a window: doc_id, digest (md5 of the text), at (0-based word), length, items."""
    windows = cut(benchmark_windows(benchmark, n))
    sizes = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}
    blocks = max(1, -(-sum(sizes.values()) * WINDOW_BYTES // limit))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), word_list(F.col("text")).alias("words"))
    arrays = [
        F.struct(F.lit(size).alias("length"), gram_hashes(F.col("words"), size).alias("grams")) for size in sizes or [n]
    ]
    cuts = docs.select("doc_id", "digest", "words", F.explode(F.array(*arrays)).alias("cut"))
    grams = cuts.select("doc_id", "digest", "words", F.col("cut.length").alias("length"), F.posexplode("cut.grams").alias("at", "gram"))
    found = []
    for block in range(blocks):
        part = windows.where(F.pmod(F.col("gram"), F.lit(blocks)) == block) if blocks > 1 else windows
        hit = grams.join(F.broadcast(part), ["length", "gram"])
        # taken from the row by a generator, so that the comparison is not moved into the join: there it would
        # end generated code and copy the word list of a text once per gram
        taken = F.explode(F.array(F.slice("words", F.col("at") + 1, F.col("length"))))
        hit = hit.select("doc_id", "digest", "at", "length", "items", "window", taken.alias("taken"))
        same = F.transform("taken", lower_ascii) == F.col("window")
        found.append(hit.where(same).select("doc_id", "digest", "at", "length", "items"))
    return reduce(DataFrame.unionByName, found)


def _merged(spans: Column) -> Column:
    """Sorted (at, end) spans of one document as disjoint ones."""
    span = "struct<at:int,end:int>"
    none = F.array().cast(f"array<{span}>")

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["at"].alias("at"), F.greatest(last["end"], s["end"]).alias("end"))
        head = F.slice(done, F.lit(1), F.size(done) - 1)
        joined = F.concat(head, F.array(longer))
        return F.when((F.size(done) > 0) & (s["at"] <= last["end"]), joined).otherwise(F.concat(done, F.array(s.cast(span))))

    return F.aggregate(spans, none, add)


def document_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Documents with a hit: doc_id, digest, spans (disjoint, at to end), items (sorted)."""
    found = matches(documents, benchmark, n)
    span = F.struct("at", (F.col("at") + F.col("length")).alias("end"))
    per = found.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("items").alias("items")
    )
    return per.select(
        "doc_id",
        "digest",
        _merged(F.col("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )


def _keyed(documents: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """The documents with a digest column of a fresh name, the hits under fresh names, and their condition."""
    digest = fresh(documents.columns, "text_digest")
    keyed = documents.withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    names = {c: fresh(keyed.columns, f"hit_{c}") for c in hits.columns}
    hits = hits.select(*[F.col(c).alias(n) for c, n in names.items()])
    return keyed, hits, keyed["doc_id"].eqNullSafe(hits[names["doc_id"]]) & (keyed[digest] == hits[names["digest"]])


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a window's occurrence), items, contaminated."""
    hits = document_hits(documents, benchmark, n)
    hits = hits.select(
        "doc_id",
        "digest",
        "items",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["at"]).alias("n_hit"),
    )
    docs = documents.select("doc_id", "text")
    keyed, hits, same = _keyed(docs, hits)
    narrow = keyed.select(*[c for c in keyed.columns if c != "text"], F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    joined = narrow.join(hits, same, "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("hit_n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("items"),
        F.col("hit_n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """The documents, all columns kept, without contaminated ones or (``remove="spans"``) without their hit words.

    A removed word takes the separators that follow it along.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    hits = document_hits(documents, benchmark, n).select("doc_id", "digest", "spans")
    if remove == "documents":
        keyed, hits, same = _keyed(documents, hits.select("doc_id", "digest"))
        return keyed.join(broadcast_if_small(hits, 64), same, "left_anti").select(*documents.columns)
    keyed, hits, same = _keyed(documents, hits)
    joined = keyed.join(hits, same, "left")
    spans = [c for c in hits.columns if c.startswith("hit_spans")][0]
    pieces = F.regexp_extract_all("text", F.lit(WORD + OTHER), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists(F.col(spans), lambda s: (i >= s["at"]) & (i < s["end"])))
    rest = F.concat(F.regexp_extract("text", "^" + OTHER, 0), F.array_join(kept, ""))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(rest).alias("text")
    return joined.select(*[text if c == "text" else joined[c] for c in documents.columns])
