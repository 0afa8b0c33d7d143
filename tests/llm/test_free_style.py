"""Operators with vectorised Python inside tasks: Jaccard join, token files, toxicity, WARC, language ID."""

import base64
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quantaloom.llm import jaccard_join, language_id, queries, simple8b, token_files, toxicity, warc

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# -- Jaccard join -----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_by_hand(rows, k, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if s and sets[j] and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def altered_texts(seed, sizes, copies=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for n in sizes:
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(rng.randint(1, copies)):
            x = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                p = rng.randrange(len(x)) if x else 0
                move = rng.random()
                if move < 0.4 and x:
                    x[p] = rng.choice(words)
                elif move < 0.7 and x:
                    x.pop(p)
                else:
                    x.insert(p, rng.choice(words))
            out.append(" ".join(x) if rng.random() < 0.8 else " ".join(x).upper())
    return out


@pytest.mark.parametrize("k,percent", [(3, 90), (1, 80)])
def test_groups_match_brute_force(spark, k, percent):
    texts = altered_texts(k, [1, 2, 4, 8, 10, 11, 14, 19, 20, 21, 24, 28, 33, 50, 80, 160] * 2)
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} {' '.join(f'own{i}x{j}' for j in range(6))}" for i in range(12)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \t"), (3, texts[3]), (903, "long " * 30000), (None, texts[0]), (None, "alone here now")]
    docs = frame(spark, [(i, t, "x", 1) for i, t in rows], DOCS + ", node string, n int").repartition(3)
    got = jaccard_join.near_copies(docs, k, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_hand(rows, k, percent)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, text + " more"), (3, text.upper()), (3, "its own text"), (4, "another text"), (5, None), (6, ""), (None, text)]
    docs = frame(spark, [(i, t, "x") for i, t in rows], DOCS + ", gone string")
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, None]
    assert jaccard_join.near_copies(docs.limit(0)).count() == 0


def kept_keys(s, percent, seed):
    """The keys of a set without the most frequent of each lane, by a frequency that the seed makes up."""
    by = defaultdict(list)
    for key, lane, spare in zip(*(x.tolist() for x in jaccard_join.heavy_keys(s, percent))):
        by[lane].append(((key * seed) % 1_000_003 % 50, key, spare))
    return {key for rows in by.values() for _, key, spare in sorted(rows, reverse=True)[rows[0][2] :]}


def families(seed, k):
    """Families whose members mostly don't link, and texts that share a passage of a third to nine tenths of their words."""
    rng = random.Random(seed)
    out = []
    for size, edits, members in ((120, 6, 14), (260, 16, 14), (500, 28, 10)):
        base = [f"{seed}b{size}x{i}" for i in range(size)]
        for _ in range(members):
            x = list(base)
            for _ in range(rng.randint(1, edits)):
                x[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(x))
    passage = " ".join(f"shared{i}" for i in range(90))
    for share in (10, 20, 40, 90, 180):
        out += [f"{passage} " + " ".join(f"own{share}m{m}w{j}" for j in range(share)) for m in range(6)]
    return out


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_families_and_passages_match_brute_force(spark, k, percent):
    rows = list(enumerate(families(percent, k)))
    docs = frame(spark, rows).repartition(3)
    got = jaccard_join.near_copies(docs, k, percent).select("doc_id", "n_shingles", "component_id")
    want = groups_by_hand(rows, k, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert 5 < len({w[2] for w in want}) < len(rows)


def test_every_admissible_pair_shares_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for n in [*range(1, 30), 60, 63, 64, 65, 130, 400]:
            for _ in range(6):
                base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                out, extra = int(rng.integers(0, 1 + n // 8)), int(rng.integers(0, 1 + n // 8))
                other = np.unique(np.concatenate([base[out:], rng.integers(0, 2**63, extra).astype(np.uint64)]))
                common = len(np.intersect1d(base, other))
                if not len(other) or not jaccard_join.links(len(base), len(other), common, percent):
                    continue
                for _ in range(3):  # whichever keys are the most frequent, what both keep has one in common
                    seed = int(rng.integers(1, 2**62))
                    assert kept_keys(base, percent, seed) & kept_keys(other, percent, seed)
                if max(len(base), len(other)) < 22:
                    assert np.intersect1d(jaccard_join.light_keys(base, percent), jaccard_join.light_keys(other, percent)).size


def test_the_boundary_follows_the_cost():
    assert jaccard_join.choose_boundary({}, 90) == 1
    assert 10 < jaccard_join.choose_boundary({n: 100 for n in range(1, 60)}, 90) <= 30


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(101, 100)], "a long, b long"))
    got = {r["node"]: r["root"] for r in jaccard_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_components_of_few_edges_leave_few_files(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "60")
    spark.conf.set(names[1], "false")
    try:
        roots = jaccard_join.components(spark.createDataFrame([(i, i - i % 3) for i in range(90)], "a long, b long").repartition(50))
        assert roots.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
        assert {r["node"]: r["root"] for r in roots.collect()} == {i: i - i % 3 for i in range(90)}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_stars_need_no_round_and_found_pairs_join_them(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(jaccard_join, "cut", lambda df, cut=jaccard_join.cut: cuts.append(1) or cut(df))
    stars = spark.createDataFrame([(i, i % 4) for i in range(4, 40)], "a long, b long")
    roots = jaccard_join.components(stars)
    assert {r["node"]: r["root"] for r in roots.collect()} == {i: i % 4 for i in range(40)}
    assert len(cuts) == 1
    found = spark.createDataFrame([(39, 6), (50, 39), (61, 60), (70, 70)], "a long, b long")
    joined = {r["node"]: r["root"] for r in jaccard_join._joined(roots, found).collect()}
    assert joined == {**{i: 2 if i % 4 == 3 else i % 4 for i in range(40)}, 50: 2, 60: 60, 61: 60}


def jobs_of(spark, run):
    """The result of ``run`` and the number of Spark jobs that it took, with 60 shuffle partitions that stay apart."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "60")
    spark.conf.set(names[1], "false")
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
        for n, v in before.items():
            spark.conf.set(n, v)


def test_a_bloom_table_takes_few_jobs(spark):
    nodes = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500)
    table, jobs = jobs_of(spark, lambda: jaccard_join._bloom(spark.createDataFrame([(int(n),) for n in nodes], "node long")))
    assert jaccard_join._in_bloom(table, nodes).all()
    assert np.unpackbits(table.view(np.uint8)).sum() == len(np.unique(nodes & (jaccard_join.BLOOM_BITS - 1)))
    assert 0 < jobs < 10


def test_sums_of_workers_take_few_jobs(spark):
    at = np.arange(40 * toxicity.BLOCK, step=toxicity.BLOCK // 2)
    rows = [(w, "", int(i // toxicity.BLOCK), np.array([i]).tobytes(), np.array([1.0, i + w]).tobytes()) for w in range(3) for i in at]
    sent = spark.createDataFrame(rows, toxicity.SUMS)
    found, jobs = jobs_of(spark, lambda: list(toxicity._summed(sent, {"": 2}, 1)))
    assert {int(i): s.tolist() for _, own, sums in found for i, s in zip(own, sums)} == {int(i): [3.0, 3.0 * i + 3] for i in at}
    assert 0 < jobs < 20


# -- token files ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 6000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**40, 2**63])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    if n > 600:
        ids[1], ids[2:400], ids[599] = 2**64 - 1, 0, 2**60
    words, blocks = simple8b.encode(ids)
    assert (simple8b.decode(words, blocks, n) == ids).all()
    assert blocks.sum() == len(words)
    if n > simple8b.BLOCK:  # a block decodes by itself
        at = blocks[0]
        assert (simple8b.decode(words[at : at + blocks[1]], blocks[1:2], min(512, n - 512)) == ids[512:1024]).all()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.public_tokenizer())
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", " a", "a ", " ", "  ", "a  b", "a \nb", "a\nb", "a\n", "\na", "a\n\nb", "\x01a b", "é 漢字 it's don't", "<|endoftext|> x", "a\tb c", "a b c", "can't 123 12a!!", "a\x1cb c", "x" * 3000]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encoder = token_files.Encoder(queries.public_tokenizer())
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab .,\n'\té1 ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for _ in range(2):  # the second time from the cache
        ids, length = encoder.batch(pa.array([*texts, None]))
        got = np.split(ids, np.cumsum(length)[:-1])
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_files_hold_the_corpus_in_order(spark, tokenizer):
    rows = [(i * 13 % 47 - 5, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id"), (7, None), (7, None), (60, "long text. " * 20000)]
    docs = frame(spark, [(i, t, "x") for i, t in rows], DOCS + ", path string").repartition(4)
    shards = token_files.write(docs, queries.public_tokenizer())
    got = token_files.read(spark, shards).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for i, t in order:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    path = shards[0][0]
    small = [d for part in token_files.read_shard(path, chunk=1) for d in part[2].tolist()]
    assert small == [d for part in token_files.read_shard(path) for d in part[2].tolist()]
    assert token_files.read(spark, token_files.write(docs.limit(0), queries.public_tokenizer())).count() == 0


def test_an_id_shared_by_most_rows_fills_many_shards(spark):
    rows = [(None, f"{i * 7919 % 1000} words") for i in range(600)] + [(i, "other") for i in range(200)]
    shards = token_files.write(frame(spark, rows).repartition(4), queries.public_tokenizer())
    assert max(n for _, n, _ in shards) < 300
    texts = [(r["doc_id"] is not None, r["start"]) for r in token_files.read(spark, shards).orderBy("start").collect()]
    assert len(texts) == 800 and texts == sorted(texts)


def test_special_strings_in_a_text_are_those_of_the_plain_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.public_tokenizer())
    end = "<|endoftext|>"
    texts = [*TEXTS, f"a{end} x", f"two  spaces {end}{end}\n{end} b", f" {end}", f"c {end[:-1]} {end[1:]}", "<|endo ftext|>", end]
    ids, length = token_files.Encoder(queries.public_tokenizer(), special=True).batch(pa.array(texts))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in np.split(ids, np.cumsum(length)[:-1])] == want
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_token_files(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(w) + 1) for i, w in enumerate(want)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array([*w, 0], "<u4").tobytes()) for w in want]


def test_a_task_holds_the_sets_of_few_bytes_of_text(monkeypatch):
    texts = [b" ".join(b"w%d" % (i * j % 5003) for j in range(20_000)) for i in range(1, 40)]
    want = [(jaccard_join.set_number(s), s) for t in texts for s in jaccard_join.shingle_sets([t], 3)]
    plain, held = jaccard_join.shingle_sets, []
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda texts, k: held.append(sum(map(len, texts))) or plain(texts, k))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})
    got = [x for part in jaccard_join._sets_once(iter([batch]), 3) for x in part]
    assert max(held) <= 1 << 20 and sum(held) == sum(map(len, texts))
    assert [n for n, _ in got] == [n for n, _ in want] and all((a == b).all() for (_, a), (_, b) in zip(got, want))


# -- toxicity ---------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.op4_toxicity(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id")
    held = got.where("held_out").select("predicted", "toxic", "score").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) > 0.95 * len(held)
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    assert sum(toxic) > 0.8 * len(toxic)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_toxicity_edge_cases(spark):
    words = ["tree", "house", "river", "stone", "cloud"]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" vile" if i % 2 else "")) for i in range(200)]
    labels = [(i, i % 2, 1) for i, _ in rows] + [(0, None, 1), (None, 1, 1), (1, 0, 0), (999, 1, 0)]
    docs = frame(spark, [(i, t, "x") for i, t in rows] + [(500, None, ""), (501, "", ""), (None, "vile tree", ""), (502, "word " * 30000, "")], DOCS + ", score string")
    known = frame(spark, labels, "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, known)
    got = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score(model, docs)).collect()}
    assert got[500] == got[501] and 0 <= got[500] <= 1
    assert got[None] >= 0.5 and all((got[i] >= 0.5) == bool(i % 2) for i, _ in rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r[0] % 2 for r in kept.where("doc_id < 200").collect()} == {0}
    none = toxicity.fit(docs, known.limit(0))
    assert docs.select(F.max(toxicity.score(none, docs))).first()[0] == 0
    assert docs.limit(0).select(toxicity.score(model, docs)).count() == 0


def test_thresholds_follow_the_language_of_the_text():
    model = toxicity.Model()
    assert model.groups(["für die größe", ""]) == ["", ""]
    model.learn_languages(["Für die größe Straße über Brücken", "the whole of this with that", "zzz", ""], ["de", "en", None, "xx"])
    assert model.groups(["GRÖSSE für", "with the", "12 !", ""]) == ["de", "en", "", ""]
    logits, labels = np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1])
    assert toxicity._threshold(logits, labels) == 2.5


def plain_score(model, text):
    """One score from its definition, a window and a filter at a time."""
    words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.encode()) if w]
    lowered = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    places = [toxicity._buckets([w])[0] for w in lowered]
    vectors = [model.table[a] + model.table[b] for a, b in places] or [np.zeros(toxicity.DIM)]
    vectors += [np.zeros(toxicity.DIM)] * toxicity.PAD
    logit, unit = float(model.offset), 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            responses = []
            for start in range(max(len(lowered), 1)):
                total = 0.0
                for j in range(width):
                    column = model.columns.index((width, j)) * toxicity.FILTERS + f
                    total += float(vectors[start + j] @ model.filters[:, column])
                responses.append(total)
            logit += max(max(responses) + float(model.bias[unit]), 0.0) * float(model.out[unit])
            unit += 1
    group = model.groups([text])[0]
    return 1 / (1 + np.exp(-(logit - model.thresholds.get(group, model.thresholds["*"]))))


def test_scores_follow_their_definition_and_repeats_change_no_model(spark, sf_dir):
    docs, labels = (queries.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = [r["text"] or "" for r in docs.select("text").limit(40).collect()] + ["", "One", "two words"]
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-4)
    again = toxicity.fit(docs.union(docs).union(docs.where("doc_id < 50")), labels)
    assert again.thresholds == model.thresholds and (again.table == model.table).all()


def test_every_labelled_text_teaches(spark):
    """Each text has a word of its own: training meets those of all ids that are neither held out nor kept back."""
    n = 12_000
    rows = spark.range(n).select("id", F.format_string("own%d %s", "id", F.when(F.col("id") % 3 == 0, "vile").otherwise("tree")).alias("text"))
    docs = rows.select(F.col("id").alias("doc_id"), "text")
    model = toxicity.fit(docs, rows.select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic")))
    taught = [i for i in range(n) if zlib.crc32(b"%d" % i) % 5 and zlib.crc32(b"calibration%d" % i) % 5]
    assert len(taught) > 7000 and model.table[toxicity._buckets([b"own%d" % i for i in taught])].any(2).all()
    assert (model.scores(["a vile day", "a tree"]) >= 0.5).tolist() == [True, False]


# -- WARC -------------------------------------------------------------------------------------------------


def records_by_hand(rows, min_bytes=0):
    groups = defaultdict(list)
    for page, html in rows:
        body = (html or "").encode()
        groups[base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)].append(page)
    out = []
    for (digest, n), pages in groups.items():
        for p in pages:
            first = max(pages) if n >= min_bytes else p
            out.append((p, n, digest, "response" if p == first else "revisit", None if p == first else first))
    return sorted(out)


@pytest.mark.parametrize("size", [500, 4096, 8 << 20])
def test_records_inside_payloads_are_not_taken_for_records(spark, size):
    inner = warc._record(99, "http://inner", b"abc", warc.payload_digest(b"abc"), None).decode()
    rows = []
    for i in range(90):
        html = [f"{'x' * (i * 37 % 500)}\n{inner * 3}", None, inner, "WARC/1.1\r\n", f"\n{inner[:-7]}"][i % 5]
        rows.append((i, None if i == 7 else f"http://u/{i}\r\nX: y", html, "x"))
    pages = frame(spark, rows, "page_id long, url string, html string, sha string").repartition(3)
    archives = warc.write(pages)
    found = warc.read(spark, archives, size)
    assert sorted(tuple(r) for r in warc.pages_read(found).collect()) == records_by_hand([(r[0], r[2]) for r in rows])
    urls = {r["page_id"]: r["url"] for r in found.collect()}
    assert urls[7] is None and urls[8] == "http://u/8  X: y"


def test_warc_edge_cases(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "é" * 200000), (2, "u", "é" * 200000), (3, "u", ""), (4, "u", None), (5, "u", "ab"), (6, "u", "ab")]
    archives = warc.write(frame(spark, rows, schema), min_bytes=3)
    got = warc.pages_read(warc.read(spark, archives, 64 << 10)).collect()
    assert sorted(tuple(r) for r in got) == records_by_hand([(r[0], r[2]) for r in rows], 3)
    assert warc.read(spark, warc.write(frame(spark, [], schema))).count() == 0
    again = warc.pages_read(warc.read(spark, warc.write(frame(spark, [(1, "u", "a"), (1, "u", "a"), (None, None, "a")], schema)))).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in again) == [("1", "response"), ("1", "response"), ("None", "revisit")]


@pytest.mark.parametrize("size", [4096, 8 << 20])
def test_a_header_of_any_length_is_read(spark, size):
    rows = [(i, "data:," + "u" * 100_000 if i == 6 else f"http://u/{i}", f"<p>{i}\nWARC/1.1\r\n") for i in range(10)]
    pages = frame(spark, rows, "page_id long, url string, html string").coalesce(1)
    found = warc.read(spark, warc.write(pages), size)
    assert sorted((r["page_id"], r["url"]) for r in found.collect()) == [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("size", [300, 8 << 20])
@pytest.mark.parametrize("change", [lambda b: b[:-200], lambda b: b[:-1], lambda b: b + b"more", lambda b: b"x" + b, lambda b: b.replace(b"WARC/1.1", b"WARC/9.9", 5)])
def test_a_broken_archive_is_an_error(spark, tmp_path, size, change):
    data = b"".join(warc._record(i, "u", b"text " * i, warc.payload_digest(b"text " * i), None) for i in range(9))
    (tmp_path / "a.warc").write_bytes(change(data))
    (tmp_path / "b.warc").write_bytes(data)
    archives = [(f"file://{tmp_path}/{n}.warc", len(x)) for n, x in (("a", change(data)), ("b", data))]
    assert warc.read(spark, archives[1:], size).count() == 9
    with pytest.raises(ValueError, match="a.warc: the records end at byte"):
        warc.read(spark, archives, size)


# -- language ID ------------------------------------------------------------------------------------------


def code_length(data, tree, order):
    data, bits = b"\0" * order + data, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = tree.get(data[i - k : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").where("doc_id < 60")
    trees = language_id.fit(docs).ready()
    tree = [defaultdict(Counter) for _ in trees.languages]
    counts = language_id.count_sequences(docs.where(~language_id.held_out(F.col("doc_id"))), "text", "lang").collect()
    for r in counts:
        code = int(r["code"]).to_bytes(4, "big")
        for k in range(4):
            tree[trees.languages.index(r["lang"])][code[3 - k : 3]][code[3]] += r["n"]
    texts = [b"hello \xff\x00", "Éç 漢字 und".encode()] + [r[0].encode()[:500] for r in docs.select("text").limit(5).collect()]
    want = np.array([[code_length(t, x, 3) for x in tree] for t in texts])
    data = b"".join(b"\0\0\0" + t for t in texts)
    size = np.array([len(t) + 3 for t in texts])
    got = trees._body(np.frombuffer(data, np.uint8), np.cumsum(size) - size)
    assert np.allclose(got, want, rtol=1e-4)


def test_model_needs_no_copy_of_the_package(spark, sf_dir, tmp_path):
    docs = queries.table(spark, sf_dir, "documents").where("doc_id < 60")
    texts = [r[0].encode() for r in docs.select("text").where("text IS NOT NULL").limit(5).collect()]
    for i, trees in enumerate([language_id.fit(docs), language_id.fit(docs, entries=2000)]):
        want, _ = trees.ready().predict(texts)
        (tmp_path / f"model{i}").write_bytes(cloudpickle.dumps((trees, texts)))
        code = (
            "import pickle, sys; trees, texts = pickle.loads(open(sys.argv[1], 'rb').read()); "
            "assert 'quantaloom' not in sys.modules; print(*trees.ready().predict(texts)[0])"
        )
        done = subprocess.run([sys.executable, "-c", code, f"model{i}"], cwd=tmp_path, capture_output=True, text=True, env={}, check=True)
        assert done.stdout.split() == [str(w) for w in want]


def test_blocks_give_the_code_lengths_of_all_sequences(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rare = [(1000 + i, f"zażółć gęślą jaźń numer {i} w języku", "pl") for i in range(10)]
    docs = docs.union(frame(spark, rare, "doc_id long, text string, lang string"))
    whole, blocks = language_id.fit(docs), language_id.fit(docs, entries=2000)
    asked = frame(spark, [(i, t) for i, t in enumerate(["gęślą jaźń", "\x00\x01 漢字 xq", "the house"])]).union(docs.select("doc_id", "text"))

    def found(trees):
        return asked.select("doc_id", "text", language_id.predict(asked, trees).alias("p")).select("doc_id", "text", "p.*").orderBy("doc_id", "text").collect()

    want, got = found(whole), found(blocks)
    assert [r["lang_pred"] for r in got] == [r["lang_pred"] for r in want]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in want], atol=1e-6)
    assert {r["lang_pred"] for r in got if (r["doc_id"] or 0) >= 1000} == {"pl"} and len(blocks.paths) > 2


def test_language_edge_cases(spark, sf_dir):
    known = queries.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language_id.fit(known)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of the house"), (4, "the and of the house"), (None, "the and of " * 40000), (6, "漢字")]
    docs = frame(spark, [(i, t, "x", 1) for i, t in rows], DOCS + ", lang_pred string, score int")
    got = docs.select("doc_id", language_id.predict(docs, trees).alias("p")).select("doc_id", "p.*").collect()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3} and len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, None)} == {"en"}
    assert language_id.fit(known.where("lang IS NULL")) is None
    assert docs.select(language_id.predict(docs, None).alias("p")).where("p.lang_pred <> 'und'").count() == 0
    assert docs.limit(0).select(language_id.predict(docs, trees)).count() == 0


def test_held_out_languages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    got = queries.op8_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)


def test_pieces_of_a_long_text_add_up(monkeypatch, spark, sf_dir):
    trees = language_id.fit(queries.table(spark, sf_dir, "documents")).ready()
    texts = [b"one text and another " * 50, b"x", b"une autre fois " * 30]
    whole = trees.predict(texts)
    monkeypatch.setattr(language_id, "STEP", 100)
    parts = trees.predict(texts)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_shingles_do_not_depend_on_the_buffer(monkeypatch):
    texts = [b"One two\tthree four", None, b"", b"x" * 500 + b" tail one two three", b" one  TWO three four ", "é è ü x y".encode()] * 3
    whole = jaccard_join.shingle_sets(texts, 3)
    monkeypatch.setattr(jaccard_join, "STEP", 16)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, jaccard_join.shingle_sets(texts, 3)))
    assert (whole[0] == whole[4]).all() and [len(s) for s in whole[:6]] == [2, 0, 0, 3, 2, 2]
