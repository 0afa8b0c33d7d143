"""Operators in column functions: fingerprints, decontamination, URL filters, licences, mixing."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quantaloom.llm import decontamination, fingerprints, licences, mixing, queries, url_filters

DOCS = "doc_id long, text string"
WORDS = " ".join(f"w{i}" for i in range(40))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# -- fingerprints -----------------------------------------------------------------------------------------


def winnow_by_hand(hashes, w):
    """(position, hash) of the rightmost least hash of every window."""
    if not hashes:
        return []
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = range(i, min(i + w, len(hashes)))
        p = min(window, key=lambda j: (hashes[j] >> fingerprints.POSITION_BITS, -j))
        if not out or out[-1] != p:
            out.append(p)
    return sorted(set(out))


def test_winnowing_picks_the_rightmost_least_hash_of_each_window(spark):
    text = "a b a b a b a b c d e f a b a b a b g h i " * 3
    grams = fingerprints.winnow(F.col("text"), fingerprints.K, 1)
    row = frame(spark, [(1, text)]).select(grams.alias("all"), fingerprints.winnow(F.col("text")).alias("kept")).first()
    full = [p for p in row["all"]]
    place = [fingerprints.LAST_POSITION - (p & fingerprints.LAST_POSITION) for p in row["kept"]]
    assert place == winnow_by_hand(full, fingerprints.W)
    assert [full[p] for p in place] == row["kept"]


def test_a_shared_run_of_tokens_always_gives_a_common_hash(spark):
    shared = " ".join(f"s{i}" for i in range(fingerprints.K + fingerprints.W - 1))
    rows = [(i, " ".join(f"x{i}_{j}" for j in range(i)) + " " + shared + " " + " ".join(f"y{i}_{j}" for j in range(7))) for i in range(8)]
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    sets = [{g["hash"] for g in r["grams"]} for r in got]
    assert all(a & b for a in sets for b in sets)


def test_fingerprint_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (None, "漢字かな交じり文の長い文章です"), (7, WORDS * 50)]
    got = {r["doc_id"]: r["grams"] for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[2] == got[3] == []
    assert got[4] == got[5] and len(got[4]) == 1
    assert len(got[None]) > 1 and len(got[7]) > 100


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_edited_texts_follow_descending_ids_around_the_end(spark, buckets):
    rows = [(i * 7 % 101, "x" * (i % 5) + f"text {i} " * (i % 9)) for i in range(40)] + [(-5, None), (-9, "é漢" * 10)]
    spark_conf = spark.conf.get("spark.sql.shuffle.partitions")
    got = {}
    df = frame(spark, rows).withColumn("bucket", F.lit("clash"))
    rows_, window = fingerprints.with_neighbours(df, buckets)
    for r in rows_.withColumn("next", F.lead("text").over(window)).where("not guest").collect():
        got[r["doc_id"]] = r["next"]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    assert got == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    assert spark_conf == spark.conf.get("spark.sql.shuffle.partitions")


def test_edited_fingerprints_contract(spark):
    rows = [(3, "abcdef ghijkl mnopqr"), (2, "second text that is longer than the first one"), (1, None)]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    assert got[3]["edited"] == "abcdef ghijkl " + "second"
    assert got[1]["edited"] == "" and got[1]["n_chars"] == 0 and got[1]["near_edited"] == 1.0
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.edited_fingerprints(frame(spark, [(9, "abc" * 9)])).first()
    assert one["edited"] == ("abc" * 9)[:18] + ("abc" * 9)[:9] and one["near_next"] == 1.0
    twice = fingerprints.edited_fingerprints(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "q"), (None, "r")])).collect()
    assert len(twice) == 4


# -- decontamination --------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination_by_hand(docs, items, n):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five SIX"), (2, "alpha beta"), (3, None), (4, "..."), (5, "one two three four five six"), (6, "Été é")]
CASES = [
    (1, "zero one two-three four FIVE six seven alpha, beta alpha"),
    (2, None),
    (3, ""),
    (4, "alpha alpha beta " * 3),
    (5, "one two three four five"),
    (6, "été é Été É"),
    (7, WORDS * 30),
    (7, "other text with alpha beta"),
    (8, "alpha beta"),
    (8, "alpha beta"),
    (None, "alpha beta"),
]


def test_contamination_matches_brute_force(spark):
    docs = frame(spark, [(i, t, "x", 1) for i, t in CASES], DOCS + ", words string, gram int")
    got = decontamination.contamination(docs, frame(spark, ITEMS, "item_id long, text string"), n=4)
    rows = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()], key=str)
    assert rows == contamination_by_hand(CASES, ITEMS, 4)


def test_windows_in_several_blocks_give_the_same_matches(spark):
    docs, items = frame(spark, CASES), frame(spark, ITEMS, "item_id long, text string")
    one = decontamination.matches(docs, items, 4).collect()
    many = decontamination.matches(docs, items, 4, limit=1000).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and one


def test_removal_keeps_clean_rows_and_all_columns(spark):
    docs = frame(spark, [(i, t, "x") for i, t in CASES], DOCS + ", text_digest string")
    items = frame(spark, ITEMS, "item_id long, text string")
    clean = [c for c, r in zip(CASES, [x for c in CASES for x in contamination_by_hand([c], ITEMS, 4)]) if not r[2]]
    kept = decontamination.decontaminate(docs, items, 4)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(clean, key=str)
    spans = decontamination.decontaminate(docs, items, 4, remove="spans").collect()
    assert len(spans) == len(CASES)
    by_id = {r["doc_id"]: r["text"] for r in spans if r["doc_id"] in (1, 4)}
    assert by_id[1] == "zero seven alpha" and by_id[4] == "alpha alpha alpha "
    none = decontamination.decontaminate(docs, items.where("item_id > 90"), 4)
    assert none.count() == len(CASES)
    assert decontamination.contamination(docs.limit(0), items, 4).count() == 0


# -- URL filters ------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, day int"
ENTRIES = "list string, action string, pattern string, day int, op string"


def test_entries_hold_from_their_day_until_they_are_removed(spark):
    entries = [
        ("a", "block", "bad.org", 10, "add"),
        ("a", "block", "bad.org", 20, "remove"),
        ("a", "block", "bad.org", 40, "add"),
        ("b", "allow", "good.bad.org", 0, "add"),
        ("b", "block", "x.net/deep/dir", 0, "add"),
        ("c", "block", "y.net", 5, "add"),
        ("c", "block", "y.net", 5, "remove"),
        ("c", "allow", "tie.net", 0, "add"),
        ("d", "block", "tie.net", 0, "add"),
        ("e", None, "z.net", 0, "add"),
        ("e", "block", "z.net", 0, "flip"),
    ]
    cases = [
        (1, "http://bad.org/", 9, "none"),
        (2, "http://BAD.org:80/", 10, "block"),
        (3, "http://u:p@www.bad.org./x", 19, "block"),
        (4, "http://bad.org/", 20, "none"),
        (5, "http://bad.org/", 9999, "block"),
        (6, "http://good.bad.org/", 50, "allow"),
        (7, "http://notbad.org/", 50, "none"),
        (8, "http://x.net/deep/dir/page?q", 1, "block"),
        (9, "http://x.net/deep/dirt", 1, "none"),
        (10, "http://y.net/", 6, "none"),
        (11, "http://tie.net/", 6, "block"),
        (12, None, 6, "none"),
        (13, "http://bad.org/", None, "none"),
        (14, "no url", 6, "none"),
        (15, "http://z.net/", 6, "none"),
        (2, "http://BAD.org:80/", 10, "block"),
    ]
    captures = frame(spark, [c[:3] + ("x",) for c in cases], PAGES + ", pattern string")
    got = url_filters.judge(captures, frame(spark, entries, ENTRIES)).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == sorted((c[0], c[3]) for c in cases)
    kept = url_filters.admitted(captures, frame(spark, entries, ENTRIES))
    assert kept.columns == captures.columns
    assert sorted(r["page_id"] for r in kept.collect()) == sorted(c[0] for c in cases if c[3] != "block")
    far = "/".join(["s"] * 40_000)
    deep = frame(spark, [(1, f"https://x.org/{far}", 15), (2, "https://" + "a." * 40_000 + "x.org/p/q", 15)], PAGES)
    paths = [("l", "block", "x.org/s/s/s", 1, "add"), ("l", "allow", "x.org", 1, "add"), ("l", "block", "x.org/s/t", 1, "add")]
    got = url_filters.judge(deep, frame(spark, paths, ENTRIES)).orderBy("page_id").collect()
    assert [(r["verdict"], r["pattern"], r["n_active"]) for r in got] == [("block", "x.org/s/s/s", 2), ("allow", "x.org", 1)]
    none = url_filters.judge(captures, frame(spark, [], ENTRIES))
    assert none.where("verdict = 'none'").count() == len(cases)
    assert url_filters.judge(captures.limit(0), frame(spark, entries, ENTRIES)).count() == 0


# -- licences ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return licences.fit(queries.table(spark, sf_dir, "documents"))


def test_notices_are_named_and_prose_is_left_alone(spark, model):
    text = {
        1: "Some prose.\nReleased under the MIT License.\nMore prose.",
        2: "prose here\nLicensed under the Apache License, Version 2.0.",
        3: "His driving license was renewed under the new rules of the state.",
        4: None,
        5: "",
        6: "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.",
        7: "word " * 20000,
    }
    docs = frame(spark, [(i, t, "x") for i, t in text.items()] + [(1, text[1], "x")], DOCS + ", term string")
    got = [(r["doc_id"], r["families"]) for r in licences.scan(docs, model).collect()]
    assert sorted(got) == [(1, ["mit"]), (1, ["mit"]), (2, ["apache-2.0"]), (3, []), (4, []), (5, []), (6, ["cc-by-nc", "gpl"]), (7, [])]
    assert licences.scan(docs.limit(0), model).count() == 0


def test_repeated_rows_change_no_verdict(spark, model):
    line = "You may obtain a copy of the report at the library desk"
    texts = [line, "Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT License\n" + line]
    once = licences.notices(frame(spark, list(enumerate(texts))), model)
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(5)]
    often = licences.notices(frame(spark, rows).repartition(3), model)
    facts = ["doc_id", "at", "family", "guess", "confirmed", F.round("probability", 9).alias("p")]
    assert sorted(map(str, once.select(*facts).collect())) == sorted(map(str, often.select(*facts).collect()))
    found = {tuple(r) for r in licences.scan(frame(spark, rows), model).select("doc_id", "n_notices", F.concat_ws(",", "families")).collect()}
    assert len(found) == 3 and licences.scan(frame(spark, rows), model).count() == 15


def test_every_notice_and_slightly_shortened_notices_are_found(spark, model):
    rows, want = [], {}
    for family, texts in licences.NOTICES.items():
        for t in texts:
            for cut in (None, 1):
                words = t.split()
                want[len(rows)] = family
                rows.append((len(rows), t if cut is None or len(words) < 8 else " ".join(words[:-1])))
    got = {r["doc_id"]: r["families"] for r in licences.scan(frame(spark, rows), model).collect()}
    right = sum(got[i] == [f] for i, f in want.items())
    assert right >= 0.9 * len(want)
    assert all(got[i] for i in want)


FOREIGN = [
    "Licensed under the EUPL, Version 1.2",
    "Eclipse Public License - v 2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    "This is free and unencumbered software released into the public domain.",
    "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Licensed under the Upstream Compatibility License, Version 1.0",
]


def test_notices_of_other_families_are_unknown(spark, model):
    assert not set(FOREIGN) & set(licences.OTHERS)
    prose = ["The house of the old family stood under the trees.", "A copy of the report was free of charge to any person."]
    later = ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', "Neither the name of the author nor the names of its contributors may be used"]
    got = {r["doc_id"]: r["families"] for r in licences.scan(frame(spark, list(enumerate(FOREIGN + prose + later))), model).collect()}
    n = len(FOREIGN)
    assert [got[i] for i in range(n + len(prose))] == [["unknown"]] * n + [[]] * len(prose)
    assert got[n + 2] in (["mit"], ["unknown"]) and got[n + 3] in (["bsd"], ["unknown"])


# -- mixing -----------------------------------------------------------------------------------------------


def shares_by_hand(budget, caps, weights):
    """Water filling in rounds of whole units."""
    live, out = {i for i in range(len(caps)) if weights[i] > 0}, [0] * len(caps)
    rest = min(budget, sum(caps[i] for i in live))
    while live:
        open_ = sum(weights[i] for i in live)
        full = [i for i in live if caps[i] * open_ <= rest * weights[i]]
        if not full:
            for i in live:
                out[i] = rest * weights[i] // open_
            break
        for i in full:
            out[i] = caps[i]
        rest -= sum(caps[i] for i in full)
        live -= set(full)
    return out


def test_shortages_go_to_siblings_before_other_branches(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 5), ("b", "x", "4", 1000), ("b", None, "5", 7)]
    keys = "key_0 string, key_1 string, key_2 string, tokens long"
    df = frame(spark, leaves, keys)
    got = {r["key_2"]: r["budget"] for r in mixing.budgets(df, mixing.equal_weights(df), 200, 1).collect()}
    top = shares_by_hand(200, [115, 1007], [1, 1])
    a = shares_by_hand(top[0], [110, 5], [1, 1])
    b = shares_by_hand(top[1], [1000, 7], [1, 1])
    ax = shares_by_hand(a[0], [10, 100], [1, 1])
    assert got == {"1": ax[0], "2": ax[1], "3": a[1], "4": b[0], "5": b[1]}
    assert got["2"] == 85  # the shortage of 1 and 3 stays within a


def test_nodes_without_weight_hold_no_capacity(spark):
    leaves = [("a", "x", "1", 100), ("a", "y", "2", 10), ("b", "x", "3", 1000), ("c", "x", "4", 50), ("d", "x", "5", 30)]
    df = frame(spark, leaves, "key_0 string, key_1 string, key_2 string, tokens long")
    equal = mixing.equal_weights(df)
    # a/x weighs nothing, d has no weight at all, the leaf of c weighs nothing
    weights = [equal[0].where("key_0 <> 'd'"), equal[1].withColumn("weight", F.expr("if(key_0 = 'a' AND key_1 = 'x', 0, 1)")), equal[2].where("key_0 <> 'c'")]
    got = {r["key_2"]: r["budget"] for r in mixing.budgets(df, weights, 200, 1).collect()}
    assert got == {"1": 0, "2": 10, "3": 190, "4": 0, "5": 0}
    none = [w.withColumn("weight", F.lit(0)) for w in equal]
    assert {r["budget"] for r in mixing.budgets(df, none, 200, 1).collect()} == {0}


def test_sources_of_any_name_are_mixed(spark):
    docs = frame(spark, [(i, "word " * 9, s, "en") for i, s in enumerate(["src1", "srcx", "src", None, "web", "src4"])], DOCS + ", source string, lang string")
    domains = docs.select(F.expr(queries.MIX_DOMAIN.format(text="string")).alias("d")).collect()
    assert [r["d"] for r in domains] == ["d1", "other", "other", "other", "other", "d1"]
    assert queries.mix_documents(docs).count() > 0


def test_mix_takes_whole_epochs_and_a_prefix(spark):
    rows = [(i, "t " * (i % 7 + 1), "d", "en" if i % 3 else "fr", f"s{i % 2}") for i in range(200)]
    rows += [(500, None, "d", "en", "s0"), (501, "", "d", None, None), (502, "t t", "d", None, None), (502, "t t", "d", None, None)]
    docs = frame(spark, rows, DOCS + ", epoch string, lang string, source string")
    path = [F.col("epoch"), F.col("lang"), F.col("source")]
    mixed = mixing.mix(docs, path, None, 900, max_epochs=3, seed=5)
    assert mixed.columns == [*docs.columns, "epoch_"]
    total = mixed.agg(F.sum(mixing.count_tokens(F.col("text")))).first()[0]
    assert 850 <= total <= 900
    again = mixing.mix(docs.repartition(7), path, None, 900, max_epochs=3, seed=5)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))
    other = mixing.mix(docs, path, None, 900, max_epochs=3, seed=6)
    assert sorted(map(str, other.collect())) != sorted(map(str, mixed.collect()))
    everything = mixing.mix(docs, path, None, 10**9, max_epochs=2).groupBy("doc_id").count().collect()
    assert {r["count"] for r in everything if r["doc_id"] < 500} == {2}
    assert mixing.mix(docs.limit(0), path, None, 10).count() == 0


def test_edited_digest_of_the_query(spark, sf_dir):
    docs = sorted(queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect(), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    for k, (i, text) in enumerate(docs):
        own, other = text or "", docs[(k + 1) % len(docs)][1] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + other[:third]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
