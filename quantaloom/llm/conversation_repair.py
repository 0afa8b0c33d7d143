"""Conversation structure repair: the cheapest edits that make each conversation ``(system? (user assistant)+)?``.

A conversation's signature has one symbol a row: the role's initial, in capitals if the text is truncated, ``-`` if the
row must go (blank, or a repeat of an earlier row). What the best edits are from some row on depends on the rest of
the signature and on the grammar state alone, so signatures are minimised from the end: equal suffixes are one node of
a suffix-shared automaton, whose edge is the symbol read and whose successor is the suffix without it. For each node
and grammar state the cost-to-go and the first edit of the best audit are computed once, for all conversations that
pass through the node. Distinct signatures are sorted by their reversed text over range partitions; neighbours
then share the longest suffixes, and a stack as deep as one signature holds all that a task needs.

Edits: K keeps a row (0), R gives it the role user or assistant (1), D deletes it (2; the only choice for blank and
repeated rows), I inserts an empty user or assistant row (5); a truncated row that stays adds 5. Of equally cheap
audits the least in ASCII order is taken: at every state the possible edits start with different letters, so the
least first letter decides, and audits need no comparison.

Rows are sorted by conversation and turn and stream through a task one conversation at a time; the memory held is a
16-byte digest for each distinct row of the current conversation, its signature and its audit. A conversation stays in
one task since its repaired text is read, and hashed, in order.

Defined results: a null role or text counts as one space, so a null text is blank; null turns come first; rows of one turn go by
role, then by a digest of the text; null conv_ids are one conversation; rows for which ``present`` is false or null
only name their conversation, and a conversation without present rows has zeros, an empty audit and no repaired rows;
repeated rows are duplicates; roles count by their first character; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.llm.common import salted_join
from quantaloom.session import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: grammar states: at the start, after system, after user, after assistant; the role that each asks for leads on
ASKED, NEXT = "uuau", (2, 2, 3, 2)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
WHITE = " \t\n\x0b\x0c\r"


# -- signatures -----------------------------------------------------------------------------------------


def _prepared(conversations: DataFrame, present: Column | None) -> DataFrame:
    """conv_id, present, turn, role, text without nulls, and a digest of role and text."""
    rows = conversations.select(
        "conv_id",
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "digest")


def signatures(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, signature. Texts stay where they are."""
    rows = _prepared(conversations, present)
    shown = F.rtrim("text", F.lit(WHITE))
    fault = F.when(shown == "", "b").when(F.substring(shown, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    rows = rows.select("conv_id", "present", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "digest", "initial", "fault")]
            for conv, here, turn, digest, initial, fault in zip(*columns):
                if open_ is None or conv != at:
                    if open_ is not None:
                        done.append((at, *open_.facts()))
                    at, open_ = conv, _Signature()
                if here:
                    open_.add(turn, digest, initial, fault)
            if done:
                yield _batch(done)
        if open_ is not None:
            yield _batch([(at, *open_.facts())])

    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.schema([("conv_id", _arrow_of(kind)), *[(c, pa.int64()) for c in COUNTS], ("signature", pa.string())])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return _in_order(rows, "present").mapInArrow(run, f"conv_id {kind}, {counts}, signature string")


def _arrow_of(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


class _Signature:
    """What one pass over a conversation's rows, in order, finds."""

    def __init__(self) -> None:
        self.seen, self.symbols, self.last, self.turn = set(), [], None, None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, digest: bytes, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        symbol = initial if initial in ("s", "u", "a") else "x"
        if fault == "b":
            self.blank += 1
            symbol = "-"
        elif digest in self.seen:
            self.duplicate += 1
            symbol = "-"
        elif fault == "t":
            self.truncated += 1
            symbol = symbol.upper()
        self.seen.add(digest)
        self.symbols.append(symbol)

    def facts(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.symbols)


# -- the automaton --------------------------------------------------------------------------------------

#: a node: for each grammar state the cost-to-go, the first edit of the best audit, and the state that it leads to
END = ((0, "", 0), (2 * INSERT, "I", NEXT[1]), (INSERT, "I", NEXT[2]), (0, "", 3))


def node_before(symbol: str, after: tuple) -> tuple:
    """The node that reads ``symbol`` and goes on to ``after``."""
    found = []
    for state in range(4):
        options = [(DELETE + after[state][0], "D", state)]
        if symbol != "-":
            extra, role = TRUNCATED * symbol.isupper(), symbol.lower()
            options.append((REROLE + extra + after[NEXT[state]][0], "R", NEXT[state]))
            if role == ASKED[state]:
                options.append((KEEP + extra + after[NEXT[state]][0], "K", NEXT[state]))
            elif role == "s" and state == 0:
                options.append((KEEP + extra + after[1][0], "K", 1))
        found.append(min(options))
    cost = [f[0] for f in found]
    for _ in range(2):  # a third insertion in a row never pays
        cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]
    return tuple(min(found[q], (INSERT + cost[NEXT[q]], "I", NEXT[q])) for q in range(4))


def audit_along(path: list[tuple]) -> str:
    """The best audit from the start; ``path`` holds the nodes of a signature from its end (first) to its start."""
    edits, state = [], 0
    for node in reversed(path):
        edit = "I"
        while edit == "I":
            _, edit, state = node[state]
            edits.append(edit)
    return "".join(edits)


class SuffixAutomaton:
    """The nodes along the latest signature, from the end; the next one computes what lies before their common suffix."""

    def __init__(self) -> None:
        self.path, self.read, self.made = [END], "", 0

    def follow(self, backwards: str) -> list[tuple]:
        """The nodes of a signature given from its end; shared ones stay."""
        same = _common_length(self.read, backwards)
        del self.path[same + 1 :]
        for symbol in backwards[same:]:
            self.path.append(node_before(symbol, self.path[-1]))
            self.made += 1
        self.read = backwards
        return self.path


def _common_length(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def audits(signed: DataFrame) -> DataFrame:
    """signature, cost, audit and nodes (that had to be computed for it) of each distinct signature."""
    distinct = signed.select(F.reverse("signature").alias("backwards")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            out = []
            for backwards in batch.column(0).to_pylist():
                before = automaton.made
                path = automaton.follow(backwards)
                out.append((backwards[::-1], path[-1][0][0], audit_along(path), automaton.made - before))
            if out:
                names = ["signature", "cost", "audit", "nodes"]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    return distinct.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(run, "signature string, cost long, audit string, nodes long")


# -- repair ---------------------------------------------------------------------------------------------


def audited(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, the counts, signature, cost and audit."""
    signed = cut(signatures(conversations, present))
    return salted_join(signed, audits(signed).drop("nodes"), ["signature"], F.monotonically_increasing_id())


def _edited(conversations: DataFrame, judged: DataFrame, present: Column | None) -> DataFrame:
    """Rows in order, each conversation's audit before them (in a row that is not ``present``)."""
    rows = _prepared(conversations, present).where("present")
    heads = judged.select("conv_id", F.lit(False).alias("present"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    return _in_order(rows.unionByName(heads), "present")


class _Repair:
    """Applies an audit to rows in order: (role, text, edit) of the rows that come out."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            role = ROLES[ASKED[self.state]]
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield role, "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        asked = ASKED[self.state]
        if edit == "K" and role[:1] != asked:
            self.state = 1  # a system row at the start
        else:
            self.state = NEXT[self.state]
        yield (role if edit == "K" else ROLES[asked]), text, edit

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For every batch a list of (conv_id, turn, row that comes out, or None at a conversation's end)."""
    at, repair = None, None
    for batch in batches:
        out = []
        for conv, here, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "text")]):
            if not here:
                if repair is not None:
                    out += [(at, None, r) for r in repair.end()]
                    out.append((at, None, None))
                at, repair = conv, _Repair(text)
            else:
                out += [(conv, turn, r) for r in repair.row(role, text)]
        yield out
    if repair is not None:
        yield [*((at, None, r) for r in repair.end()), (at, None, None)]


def repair(conversations: DataFrame, present: Column | None = None, judged: DataFrame | None = None) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), turn (null if inserted), role, text, edit."""
    rows = _edited(conversations, audited(conversations, present) if judged is None else judged, present)
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = _arrow_of(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = 0
        for events in _streams(batches):
            out = []
            for conv, turn, row in events:
                if row is None:
                    position = 0
                else:
                    out.append((conv, position, turn, *row))
                    position += 1
            if out:
                kinds = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["conv_id", "position", "turn", "role", "text", "edit"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def repaired_digests(conversations: DataFrame, present: Column | None, judged: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired rows as ``role:text``, joined by newlines."""
    rows = _edited(conversations, judged, present)
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = _arrow_of(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = sha256(), True
        for events in _streams(batches):
            out = []
            for conv, _, row in events:
                if row is None:
                    out.append((conv, digest.hexdigest()))
                    digest, first = sha256(), True
                else:
                    digest.update(f"{'' if first else chr(10)}{row[0]}:{row[1]}".encode())
                    first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv_type, pa.string()))], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
