"""WARC archives: writing pages as records, and reading them back with verified record boundaries.

Writing. Pages with equal payloads of at least ``min_bytes`` bytes form a group: the one with the largest page_id is a
``response``, the others are ``revisit`` records that name it and carry no payload. Groups are found from digests and
lengths alone. Each task writes one archive under a name of its own attempt, and only the names that finished tasks
return are read.

Reading. Tasks take byte ranges of the archives and emit, for every place where the record magic stands at the
beginning of a line, the record's header and the place of its successor (from Content-Length). Such places also occur
inside payloads, so none is trusted by itself. Following successors inside a range is done in its task: every
candidate gets the first place beyond the range that its chain reaches. Pointer jumping over these exits, which
doubles the ranges spanned in each round, finds the one place where the chain that begins at byte 0 enters each range;
a last pass follows the chain from there and keeps only the records on it.

Defined results: a null payload is empty; null url and page_id are written as empty fields and come back as nulls;
rows that share both the payload and the largest page_id are all responses (nothing tells them apart); bytes after the last
whole record and a record that is broken off are an error; headers may be of any length; an empty table gives no archive. Payloads may hold any bytes, record headers included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm.common import shared_folder
from quantaloom.session import broadcast_if_small, cut

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
LOOKAHEAD = 1 << 16  # bytes read beyond a range at first; longer headers are read on
RANGE_BYTES = 8 << 20
CANDIDATE = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.1\r\n")
RECORD_URN = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{RECORD_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{RECORD_URN}{refers_to}>")]
    body = payload if refers_to is None else b""
    fields.append(("Content-Length", str(len(body))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return MAGIC + head + b"\r\n" + body + END


def assign(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null for responses.

    Only groups of two or more pages travel (digest, length, largest id); they are broadcast while they are small.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html"))
    narrow = rows.select("page_id", "sha", "size").where(F.col("size") >= min_bytes)
    groups = narrow.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    groups = groups.where("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("g_sha"), F.col("size").alias("g_size"), "first")
    groups = broadcast_if_small(groups, 64)
    joined = rows.join(groups, (rows["sha"] == groups["g_sha"]) & (rows["size"] == groups["g_size"]), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> list[tuple[str, int]]:
    """One record per page; the (path, bytes) of every archive."""
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        out, size = None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    fs, root = FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc"
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                size += out.write(_record(page_id, url, html, payload_digest(html), refers_to))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size]})

    rows = assign(pages, min_bytes).withColumn("html", F.col("html").cast("binary"))
    done = rows.mapInArrow(store, "path string, bytes long").collect()  # a row per archive
    return sorted((r["path"], r["bytes"]) for r in done)


# -- reading --------------------------------------------------------------------------------------------


def _starts(data: bytes, lead: int, own: int) -> list[int]:
    """Where the magic stands at the beginning of a line, in the ``own`` bytes after the first ``lead``."""
    found = CANDIDATE.finditer(data, 0, min(len(data), own + lead + len(MAGIC) - 1))
    return [m.start() for m in found if m.start() >= lead]


def _candidates(data: bytes, base: int, own: int) -> list[tuple[int, int, bytes]]:
    """(place, successor, header) of each well-formed header that begins in the first ``own`` bytes of ``data``.

    ``data`` has one byte before its first place if ``base`` is not 0. A header has no line that is the magic, so it
    ends before the next such place.
    """
    lead = 1 if base else 0
    out = []
    starts = _starts(data, lead, own)
    for at, bound in zip(starts, [*starts[1:], len(data)]):
        end = data.find(END, at, bound)
        if end < 0:
            continue
        header = data[at + len(MAGIC) : end]
        length = re.search(rb"(?:\A|\r\n)Content-Length: ([0-9]{1,18})(?:\r\n|\Z)", header)
        if length:
            place = base + at - lead
            out.append((place, place + (end - at) + 2 * len(END) + int(length[1]), header))
    return out


def _exits(places: np.ndarray, following: np.ndarray, limit: int) -> np.ndarray:
    """Where the chain from each candidate first leaves the range, or the place inside where it breaks off."""
    exits = following.copy()
    for i in range(len(places) - 1, -1, -1):  # successors lie further right, so theirs are known
        if following[i] < limit:
            j = np.searchsorted(places, following[i])
            if j < len(places) and places[j] == following[i]:
                exits[i] = exits[j]
    return exits


def _read(path: str, start: int, size: int) -> bytes:
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        f.seek(start)
        return f.read(size)


def _range_bytes(path: str, start: int, stop: int) -> bytes:
    """The bytes of a range, the byte before it, and what follows, up to the end of the last header at least."""
    from pyarrow.fs import FileSystem

    lead = 1 if start else 0
    fs, name = FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        f.seek(start - lead)
        data = f.read(stop - start + lead + LOOKAHEAD)
        starts = _starts(data, lead, stop - start)
        seen = starts[-1] if starts else 0
        while starts and data.find(END, seen) < 0:
            seen = max(starts[-1], len(data) - len(END) + 1)
            more = f.read(max(len(data), LOOKAHEAD))
            if not more:
                break
            data += more
    return data


def ranges(spark: SparkSession, archives: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of all archives, a task for each: path, total, start, stop."""
    listed = spark.createDataFrame(archives, "path string, total long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    cuts = listed.select("path", "total", F.explode(starts).alias("start"))
    cuts = cuts.select("*", F.least(F.col("start") + range_bytes, "total").alias("stop"))
    return cuts.repartition(max(1, sum(-(-n // range_bytes) for _, n in archives)), "path", "start")


def entries(cuts: DataFrame) -> DataFrame:
    """Where the true chain of records enters each range it does not skip: path, start, entry.

    The chain of every archive has to end at its last byte; a place where one breaks off is an error.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, stop in zip(frame["path"], frame["start"], frame["stop"]):
                found = _candidates(_range_bytes(path, start, stop), start, stop - start)
                places = np.array([c[0] for c in found], np.int64)
                out = _exits(places, np.array([c[1] for c in found], np.int64), stop)
                yield pd.DataFrame({"path": path, "start": start, "place": places, "jump": out})

    hops = cut(cuts.mapInPandas(scan, "path string, start long, place long, jump long"))
    # a place matters only if the chain of another range, or of the archive, can enter there
    targets = hops.select("path", F.col("jump").alias("place")).distinct()
    first = cuts.where("start = 0").select("path", F.lit(0).cast("long").alias("place"))
    nodes = cut(hops.join(targets.union(first).distinct(), ["path", "place"]))
    reached = cut(nodes.where("place = 0").select("path", "place"))
    jumps = nodes.select("path", "place", "jump")
    count = reached.count()
    while True:  # twice as many ranges spanned in each round
        landed = reached.join(jumps, ["path", "place"]).select("path", F.col("jump").alias("place"))
        reached = cut(reached.union(landed.join(nodes.select("path", "place"), ["path", "place"])).distinct())
        grown = reached.count()
        if grown == count:
            break
        count = grown
        onward = jumps.select("path", F.col("place").alias("jump"), F.col("jump").alias("next"))
        jumps = cut(jumps.join(onward, ["path", "jump"], "left").select("path", "place", F.coalesce("next", "jump").alias("jump")))
    entered = cut(reached.join(nodes, ["path", "place"]))
    ends = entered.select("path", "jump").join(nodes.select("path", F.col("place").alias("jump")), ["path", "jump"], "left_anti")
    whole = cuts.where("start = 0").select("path", "total").join(ends, "path", "left")
    broken = whole.select("path", "total", F.coalesce("jump", F.lit(0)).alias("end")).where("end <> total").limit(10).collect()
    if broken:
        raise ValueError("; ".join(f"{r['path']}: the records end at byte {r['end']} of {r['total']}" for r in broken))
    return entered.select("path", "start", F.col("place").alias("entry"))


RECORD = "path string, place long, size long, page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, body_digest string, body_bytes long"


def read(spark: SparkSession, archives: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives, in the columns of ``RECORD``; body columns are computed from the bytes read."""
    if not archives:
        return spark.createDataFrame([], RECORD)
    cuts = ranges(spark, archives, range_bytes)
    entered = cuts.join(entries(cuts), ["path", "start"])

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, stop, total, entry in zip(*(frame[c] for c in ("path", "start", "stop", "total", "entry"))):
                yield _records(path, start, stop, total, entry)

    return entered.mapInPandas(follow, RECORD)


def _records(path: str, start: int, stop: int, total: int, entry: int) -> pd.DataFrame:
    data = _range_bytes(path, start, stop)
    base = start - (1 if start else 0)
    known = {c[0]: c for c in _candidates(data, start, stop - start)}
    rows, at = [], int(entry)
    while at < stop:
        if at not in known or known[at][1] > total:
            raise ValueError(f"{path}: no whole record at byte {at}")
        _, following, header = known[at]
        fields = dict(line.split(b": ", 1) for line in header.split(b"\r\n") if b": " in line)
        size = int(fields[b"Content-Length"])
        first = following - len(END) - size
        body = data[first - base : following - base]
        if len(body) < following - first:
            body = _read(path, first, following - first)
        if len(body) < following - first or not body.endswith(END):
            raise ValueError(f"{path}: no whole record at byte {at}")
        body = body[:size]
        number = lambda name: (lambda m: int(m[1]) if m else None)(re.search(rb"urn:page:(-?[0-9]+)", fields.get(name, b"")))
        rows.append(
            (
                path,
                at,
                following - at,
                number(b"WARC-Record-ID"),
                fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace") or None,
                fields[b"WARC-Type"].decode(),
                fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"),
                int(fields[b"X-Payload-Bytes"]),
                number(b"WARC-Refers-To"),
                payload_digest(body),
                len(body),
            )
        )
        at = following
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def pages_read(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is measured as read; a revisit's comes from its header, as its payload is elsewhere.
    """
    own = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(own, F.col("body_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("body_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
