"""The queries of the training-data operators against their SQL, and the pipeline against single stages."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quantaloom.llm import queries
from tests.llm.test_free_style import LOWER, groups_by_hand
from tools.check_oracle import TABLES, compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert compare(spark, con, name, sf_dir).startswith("ok")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    sizes, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        sizes.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5] > 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_an_empty_table_and_on_nulls(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    empty = docs.limit(0)
    nulls = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (1, "", "en", None, 0), (2, "text", None, "src0", None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        stage(spark, nulls, sf_dir).collect()


def corpus(seed):
    """Documents with copies, near copies, benchmark passages, toxic texts, nulls and repeated rows."""
    rng = random.Random(seed)

    def prose(n, bad=0):
        words = [f"word{rng.randrange(900)}" for _ in range(n)]
        for _ in range(bad):
            words[rng.randrange(n)] = "vile"
        return " ".join(words).capitalize() + "."

    texts = [prose(rng.choice([3, 30, 80, 160])) for _ in range(40)]
    items = [prose(14) for _ in range(4)] + ["Tiny item"]
    texts += [texts[i] for i in (2, 5, 7)] + [texts[i] + " tail" for i in range(10) if len(texts[i]) > 400]
    texts += [f"{prose(20)} {items[i][:-1]} {prose(20)}" for i in range(3)] + ["About a tiny item, once."]
    texts += [prose(40, bad=12) for _ in range(12)] + [None, "", "<|endoftext|> é"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "srcx", "web", None]), len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int("vile" in (t or ""))) for i, t, *_ in rows if t]
    return rows + [rows[1]], items, labels


def test_run_matches_plain_python(spark, tmp_path):
    rows, items, labels = corpus(4)
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    clean = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).select("doc_id").collect()}
    toxic = {i for i, t, *_ in rows if "vile" in (t or "")}
    assert len(toxic - clean) >= 10 and len(clean) >= 55  # scores are learned: most toxic texts go, the others stay
    left = [r for r in rows if r[0] in clean]
    first = {i: c for i, n, c in groups_by_hand([r[:2] for r in left], 5, 80) if n}
    assert any(i != c for i, c in first.items())
    left = [r for r in left if first.get(r[0], r[0]) == r[0]]

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def windows(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    cut = {w for item in items for w in windows(words(item), min(10, len(words(item))))}
    before = len(left)
    left = [r for r in left if not any(windows(words(r[1]), n) & cut for n in {len(w) for w in cut})]
    assert before - len(left) == 4

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars INT)")
    # the SQL joins on the keys, so that null ones get a name; empty strings sort as nulls do
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, t, lang or "", source or "", n) for i, t, lang, source, n in left])
    taken = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.MIXING_SQL})").fetchall())
    tokenizer = Tokenizer.from_file(queries.public_tokenizer())
    text_of, want, start = {r[0]: r[1] for r in left}, [], 0
    for doc in taken:
        ids = [*tokenizer.encode(text_of[doc] or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
