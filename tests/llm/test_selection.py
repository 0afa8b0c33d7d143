"""Importance resampling, line frequency and conversation repair against plain Python versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantaloom.llm import conversation_repair as repair
from quantaloom.llm import importance, line_frequency, queries

DOCS = "doc_id long, text string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


# -- importance -------------------------------------------------------------------------------------------


def runs_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def drawn_by_hand(rows, target, percent=25):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(runs_by_hand(text)[1])
    for text in target:
        t.update(runs_by_hand(text)[1])
    s_all, t_all = s.total() + 10000, t.total() + 10000
    out, able = [], []
    for i, (doc, text) in enumerate(rows):
        w, f = runs_by_hand(text)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if len(w) >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0]))
    for rank, i in enumerate(able[: len(able) * percent // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def importance_rows(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["été", "Straße", "x9"]
    rows = [(i * 3 % n, " ".join(rng.choices(words, k=rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(n)]
    return rows + [(None, None), (None, " ".join(words[:30])), (None, " ".join(words[:30])), (7, "Word-" * 50), (7, "Word-" * 50), (900, ""), (901, "!?")]


@pytest.mark.parametrize("pivots", [1, 24])
def test_drawn_documents_match_plain_python(spark, monkeypatch, pivots):
    monkeypatch.setattr(importance.kth_key, "__defaults__", (importance.SEED, pivots))
    rows, target = importance_rows(1, 120), ["w1 w2 w3 w4", "w1 été", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.draw(docs, spark.createDataFrame([(t,) for t in target], "text string"), columns=["doc_id"])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn_by_hand(rows, target)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = (" ".join(f"wort{i % 37}" for i in range(400)) + "é" * 50 + " end").encode()
    whole = Counter(runs_by_hand(text.decode())[1])
    for step in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "STEP", step)
        parts = list(importance.feature_buckets(text))
        assert sum((Counter(at.tolist()) for _, at in parts), Counter()) == whole
        assert sum(n for n, _ in parts) == 401
    three = [zlib.crc32(x) % 10000 for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]
    monkeypatch.setattr(importance, "STEP", 1)
    assert sorted(itertools.chain.from_iterable(at.tolist() for _, at in importance.feature_buckets(b"a b c", 3))) == sorted(three)


def test_importance_keeps_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "x", 5), (2, "b " * 30, "y", 6)], "doc_id long, text string, n_words string, rank int")
    got = importance.draw(docs, docs.select("text").limit(0), percent=50)
    assert got.columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[2] for r in rows] == ["x", "y"] and sorted(r[-1] or 0 for r in rows) == [0, 1]
    assert importance.draw(docs.limit(0), docs).count() == 0


def test_kth_key_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(i % 3, None if i % 4 == 0 else i % 5, i) for i in range(60)], "a int, b int, i int")
    order = [F.col("a"), F.col("b").isNull(), F.col("b"), F.col("i")]
    want = sorted(((r["a"], r["b"] is None, r["b"] or 0, r["i"]) for r in rows.collect()))
    for k in (1, 17, 60):
        key = importance.kth_key(rows, order, k, pivots=2)
        struct = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
        assert rows.where(struct == key).collect()[0]["i"] == want[k - 1][3]


# -- line frequency ---------------------------------------------------------------------------------------

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def judged_by_hand(rows, least, share, lost):
    def plain(line):
        return " ".join(SPACED.findall(re.sub("[0-9]", "0", line.translate(LOWER))))

    having, of_host = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        of_host[host].add(text or "")
        for line in (text or "").split("\n"):
            if plain(line):
                having[host, plain(line)].add(text)
    out = []
    for doc, text, host in rows:
        text = text or ""
        w, lines = SPACED.findall(text), [x for x in text.split("\n") if plain(x)]
        where = defaultdict(list)
        for i in range(len(w) - 2):
            where[tuple(w[i : i + 3])].append(i)
        repeated = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
        gone = [x for x in lines if len(having[host, plain(x)]) > max(least, len(of_host[host]) * share)]
        n_gone = sum(len(SPACED.findall(x)) for x in gone)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        facts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        cleaned = "\n".join(x for x in text.split("\n") if x not in gone)
        out.append((doc, *facts, failed, n_gone, not failed and n_gone <= len(w) * lost, cleaned))
    return out


def line_rows(seed):
    rng = random.Random(seed)

    def prose(n):
        return " ".join(rng.choice(["Alpha", "beta", "été", "x#y", "<b>", "7", "12"]) + str(rng.randrange(400)) for _ in range(n))

    rows = []
    for i in range(60):
        lines = [prose(rng.choice([3, 30, 45])) for _ in range(3)]
        if i % 2:
            lines.insert(1, f"Page {i} of 99 \t OF the   Site")
        if i % 10 == 3:
            lines = ["Shared line that fills most of this text " + " ".join(f"k{j}" for j in range(60)), "own " + prose(5)]
        if i % 7 == 0:
            lines += [lines[0], "", "  "]
        rows.append((i, "\n".join(lines), ["a", "b", None][i % 3]))
    rows += [rows[0], rows[0], (None, rows[1][1], "a"), (None, None, None), (70, "", "a"), (71, None, "b"), (72, "\n\n \n", "a")]
    return rows + [(73, ("one two three four five " * 30).strip(), "b"), (74, " ".join(f"q{j}" for j in range(80)), "lone")]


@pytest.mark.parametrize("limits", [dict(least=3, share=0.0, lost=0.5), dict(least=1, share=0.3, lost=0.2)])
def test_lines_match_plain_python(spark, limits):
    rows = line_rows(5)
    docs = spark.createDataFrame(rows, DOCS)
    want = judged_by_hand(rows, **limits)
    got = line_frequency.judge(docs, **limits).select("doc_id", *line_frequency.FACTS, "base_failed", "removed_words", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r[:-1] for r in want), key=str)
    assert {r[-2] for r in want} == {True, False} and any(r[-3] for r in want)
    kept = line_frequency.clean(docs.withColumn("Digest", F.lit(1)), **limits)
    assert kept.columns == ["doc_id", "text", "source", "Digest"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id IS NOT NULL").collect()) == sorted((r[0], r[-1]) for r in want if r[-2] and r[0] is not None)


def test_windows_are_told_apart_in_large_vocabularies():
    split = [[b"w%d" % i for i in range(3000)] + [b"w1", b"w2", b"w3"], [b"a"] * 5, [b"a", b"b"]]
    assert line_frequency._repeated(split).tolist() == [6, 5, 0]


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_frequency.judge(empty).count() == 0 and line_frequency.clean(empty).count() == 0


# -- conversation repair ----------------------------------------------------------------------------------


def audits_by_hand(symbols):
    """The cheapest audit by trying all edits, breadth first, with at most two insertions in a row."""
    best = {(0, 0, 0): (0, "")}
    found = []
    while best:
        following = {}
        for (i, state, run), (cost, text) in best.items():
            if i == len(symbols) and state in (0, 3):
                found.append((cost, text))
            moves = []
            if run < 2:
                moves.append((i, repair.NEXT[state], run + 1, 5, "I"))
            if i < len(symbols):
                moves.append((i + 1, state, 0, 2, "D"))
                if symbols[i] != "-":
                    extra, role = 5 * symbols[i].isupper(), symbols[i].lower()
                    moves.append((i + 1, repair.NEXT[state], 0, 1 + extra, "R"))
                    if role == repair.ASKED[state]:
                        moves.append((i + 1, repair.NEXT[state], 0, extra, "K"))
                    if role == "s" and state == 0:
                        moves.append((i + 1, 1, 0, extra, "K"))
            for j, q, r, c, e in moves:
                key, value = (j, q, r), (cost + c, text + e)
                if cost + c <= 2 * len(symbols) and (key not in following or value < following[key]):
                    following[key] = value
        best = following
    return min(found)


def test_audits_are_the_cheapest_and_least():
    automaton = repair.SuffixAutomaton()
    words = ["".join(w) for n in range(5) for w in itertools.product("suaxUA-", repeat=n)]
    for w in sorted(words, key=lambda w: w[::-1]):
        path = automaton.follow(w[::-1])
        assert (path[-1][0][0], repair.audit_along(path)) == audits_by_hand(w), w
    assert automaton.made == len(words) - 1  # one node for each distinct suffix


def repaired_by_hand(rows):
    """One conversation's rows in order: counts, cost, audit and repaired rows."""
    seen, symbols, counts = set(), "", Counter()
    for i, (_, role, text) in enumerate(rows):
        last = SPACED.findall(text)
        if not last:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if last[-1][-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "-" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
        counts["illegal"] += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    cost, audit = audits_by_hand(symbols)
    out, left = [], list(rows)
    for edit in audit:
        asked = "user" if not out or out[-1][0][0] in "sa" else "assistant"
        if edit == "I":
            out.append((asked, ""))
        else:
            _, role, text = left.pop(0)
            if edit != "D":
                out.append((role if edit == "K" else asked, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and not left
    body = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, hashlib.sha256(body.encode()).hexdigest())


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["tool", "", None, "system"]) if rng.random() < 0.08 else role
            text = rng.choice(["Yes.", "What now?", f"Long answer {turn}!\n", "cut off", " \t", "", None, f"é {conv}."])
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), role, text))
    return rows


def test_repaired_conversations_match_plain_python(spark, tmp_path):
    rows = conversation_rows(2)
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row a turn; rows of one turn have a test of their own
    saved(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, code = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        by[conv] += []
        role = "user" if code == 4 else role
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    want = [(conv, *repaired_by_hand(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0)))) for conv, x in by.items()]
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(not x for x in by.values()) and len({w[7] for w in want}) > 10


def test_repaired_rows_ties_copies_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 0, "assistant", "Hello.", 2), (1, 0, "assistant", "Hello.", 3), (2, 5, "user", "Why?", 4), (3, None, None, None, 5)]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, digest int")
    found = {r["conv_id"]: r for r in repair.audited(talk).collect()}
    # rows of one turn go by role: the assistant comes first
    assert (found[1]["duplicate"], found[1]["audit"], found[1]["cost"]) == (1, "RDR", 4)
    assert (found[2]["audit"], found[2]["cost"], found[3]["audit"], found[3]["blank"]) == ("D", 2, "D", 1)
    out = repair.repair(talk).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["position"], r["role"], r["text"], r["edit"]) for r in out] == [(1, 0, "user", "Hello.", "R"), (1, 1, "assistant", "Hi.", "R")]
    assert repair.audited(talk.limit(0)).count() == 0 and repair.repair(talk.limit(0)).count() == 0


def test_inserted_rows_and_a_long_conversation(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Text {i}.") for i in range(30_001)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.audited(talk).collect()
    assert [(r["cost"], r["audit"]) for r in found] == [(2, "K" * 30_000 + "D")]
    assert repair.repair(talk).count() == 30_000
    kept = repair._Repair("KIK")
    assert [*kept.row("user", "a"), *kept.row("user", "b"), *kept.end()] == [("user", "a", "K"), ("assistant", "", "I"), ("user", "b", "K")]
