"""Token ids of a corpus in binary shards, coded with Simple-8b.

Documents are put in ascending order of doc_id by range partitions; each partition writes one shard, and the shards
together hold the corpus in order. A shard is ``MAGIC``; the words of all blocks; then a footer of little-endian
64-bit arrays: words in each block, doc_id of each document, ids in each document, and a flag for null doc_ids; and
a tail of five numbers: blocks, documents, ids, where the footer begins, and the magic again. A reader finds any
block by the running sum of the footer's first array and decodes many blocks at once.

Every attempt of a task writes a file of its own name, and only the names that finished tasks return are read, so a
lost executor leaves nothing behind but an unused file. Shards go to the folder that the session shares.

Encoding runs in batches. Texts are cut before single spaces and line breaks, where no token of a byte-level
vocabulary of this kind can reach across; equal pieces are encoded once, many of them in one call.

With ``special`` a special token's string in a text gives its id, as the tokenizer file says; without, it is ordinary
text. Texts that hold the string of an added token are encoded whole, without cuts.

Defined results: null and empty texts are documents with the end id alone; repeated rows are documents of their own;
equal doc_ids are ordered by text and may fill many shards (only texts that begin alike stay in one), null doc_ids come
first; an empty table gives no shard with documents. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm import simple8b
from quantaloom.llm.common import shared_folder

MAGIC = b"S8BSHRD1"
END_ID = 0
CACHE_PIECES = 600_000
TIE_CHARS = 64  # of a text, by which documents of one doc_id are dealt to shards; inside a shard whole texts are compared
SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}"
ODD = rf"[{SPACES}][{SPACES}]|[\x00-\x02]"
CUT = re.compile(r"(?<=\S)(?= \S)")
# a letter run ends before these signs, so the text can be cut there too; pieces that follow such a cut are marked
MARKS = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~])"


class Encoder:
    """Ids of many texts, the same as the tokenizer gives for each text alone."""

    def __init__(self, path: str, special: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.strings = [t.content for t in added if special or not t.special]
        self.together = 1 if any(re.search(r"\s", t) for t in self.strings) else 10_000  # pieces joined in one call
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}  # piece -> its place in starts and sizes
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; those with a leading space or line break can be joined into long texts."""
        flats, sizes, base = [], [], len(self.slot)
        alone = [p for p in pieces if p[:1] in ("\x01", "\x02", "") or p == "\n"]
        joined = [p for p in pieces if p[:1] not in ("\x01", "\x02", "") and p != "\n"]
        texts = [p[1:] if p[:1] in ("\x01", "\x02") else p or " " for p in alone]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            flats.append(np.array(found.ids, np.uint32))
            sizes.append([len(flats[-1])])
        for i in range(0, len(joined), self.together):
            texts = [p if p[0] == "\n" else " " + p for p in joined[i : i + self.together]]
            found = self.tokenizer.encode("".join(texts), add_special_tokens=False)
            flats.append(np.array(found.ids, np.uint32))
            begin = np.fromiter((o[0] for o in found.offsets), np.int64, len(flats[-1]))
            edge = np.cumsum([0, *map(len, texts)])
            sizes.append(np.diff(np.searchsorted(begin, edge)))
        new = np.concatenate(sizes)
        self.slot.update(zip(alone + joined, range(base, base + len(new))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(new) - new])
        self.sizes = np.concatenate([self.sizes, new])
        self.flat = np.concatenate([self.flat, *flats])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the ids in each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD)
        whole = pa.array(np.zeros(len(texts), bool))
        for string in self.strings:
            whole = pc.or_(whole, pc.match_substring(texts, string))
        odd, whole = pc.or_(odd, whole), np.asarray(whole)
        # the first piece is marked, since it has no space before it; a line break begins a piece of its own
        none, mark = pa.scalar("", pa.large_string()), pa.scalar("\x01", pa.large_string())
        plain = pc.if_else(odd, none, texts)
        plain = pc.replace_substring_regex(plain, MARKS, r"\1 \x02\2".replace("\\x02", "\x02"))
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(plain, "\n", " \n"), none)
        lists = pc.split_pattern(marked, " ")
        coded = pc.dictionary_encode(lists.flatten())
        pieces = coded.dictionary.to_pylist()
        new = [p for p in pieces if p not in self.slot]
        kept = len(self.slot), len(self.flat)
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        which = slots[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.sizes[which]
        ids = _ragged(self.flat, self.starts[which], size)
        if len(self.slot) > CACHE_PIECES:  # the pieces met first, mostly frequent ones, stay
            for piece in new:
                del self.slot[piece]
            self.starts, self.sizes, self.flat = self.starts[: kept[0]], self.sizes[: kept[0]], self.flat[: kept[1]]
        upto = np.r_[0, np.cumsum(size)]
        edges = np.asarray(lists.offsets)
        length = upto[edges[1:]] - upto[edges[:-1]]
        strange = np.flatnonzero(np.asarray(odd))
        if not len(strange):
            return ids, length
        parts = np.split(ids, np.cumsum(length)[:-1])
        for i in strange:
            text = texts[int(i)].as_py()
            parts[i] = np.concatenate([self._whole(p) for p in ([text] if whole[i] else CUT.split(text))])
            length[i] = len(parts[i])
        return np.concatenate(parts), length


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for all i, in a row."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


def encoder_of_process(path: str, special: bool = False) -> Encoder:
    """The encoder that this Python worker keeps from task to task: loading it and filling its cache take a while."""
    import sys
    import types

    kept = sys.modules.setdefault("quantaloom_kept", types.ModuleType("quantaloom_kept"))
    if getattr(kept, "made_for", None) != (path, special):
        kept.made_for, kept.encoder = (path, special), Encoder(path, special)
    return kept.encoder


class ShardWriter:
    """Writes one shard as a stream: whole blocks as they fill up, the footer at the end."""

    def __init__(self, out) -> None:
        self.out, self.left = out, np.zeros(0, np.uint32)
        self.block_words: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_ids, self.size = 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), length.astype("<i8"), null.astype("<i8")))
        self.n_ids += len(ids)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) - len(ids) % simple8b.BLOCK
        self._code(ids[:whole])
        self.left = ids[whole:]

    def _code(self, ids: np.ndarray) -> None:
        words, block_words = simple8b.encode(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.size += 8 * len(words)
        self.block_words.append(block_words)

    def close(self) -> None:
        self._code(self.left)
        blocks = np.concatenate(self.block_words).astype("<i8")
        arrays = [blocks, *(np.concatenate(x) for x in zip(*self.docs))]
        for a in arrays:
            self.out.write(a.tobytes())
        tail = np.array([len(blocks), len(arrays[1]), self.n_ids, self.size], "<i8")
        self.out.write(tail.tobytes() + MAGIC)
        self.out.close()


def write(documents: DataFrame, tokenizer_path: str, folder: str | None = None, special: bool = False) -> list[tuple[str, int, int]]:
    """Encode the texts, an end id after each, and write the shards; (path, documents, ids) of each in order."""
    spark = documents.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.asc_nulls_first("doc_id")
    ordered = docs.repartitionByRange(parts, first, F.substring("text", 1, TIE_CHARS)).sortWithinPartitions(first, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = encoder = path = None
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                if writer is None:
                    encoder = encoder_of_process(tokenizer_path, special)
                    fs, root = _file_system(folder)
                    fs.create_dir(root, recursive=True)
                    path = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.s8b"
                    writer = ShardWriter(fs.open_output_stream(f"{root}/{path}"))
                ids, length = encoder.batch(rows.column("text"))
                ended = np.insert(ids, np.cumsum(length), END_ID)
                doc_id = rows.column("doc_id")
                null = np.asarray(pc.is_null(doc_id))
                writer.add(np.asarray(pc.fill_null(doc_id, 0)), null, ended, length + 1)
        if writer is not None:
            writer.close()
            n_docs = sum(len(d[0]) for d in writer.docs)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{path}"], "n_docs": [n_docs], "n_ids": [writer.n_ids]}
            )

    shards = ordered.mapInArrow(encode, "part int, path string, n_docs long, n_ids long").collect()  # a row per partition
    return [(r["path"], r["n_docs"], r["n_ids"]) for r in sorted(shards)]


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def read_shard(path: str, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A shard's documents in steps: doc_id, null flag, ids in each, and the ids of whole documents in a row."""
    fs, name = _file_system(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        f.seek(size - 40)
        tail = f.read(40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{path} is not a complete shard")
        n_blocks, n_docs, n_ids, footer = np.frombuffer(tail[:32], "<i8").tolist()
        f.seek(footer)
        arrays = np.frombuffer(f.read(8 * (n_blocks + 3 * n_docs)), "<i8")
        block_words, (doc_id, length, null) = arrays[:n_blocks], arrays[n_blocks:].reshape(3, n_docs)
        f.seek(len(MAGIC))
        left, doc, edge = np.zeros(0, np.uint64), 0, np.cumsum(length)
        for i in range(0, n_blocks, chunk):
            own = block_words[i : i + chunk]
            words = np.frombuffer(f.read(8 * int(own.sum())), "<u8")
            count = min((i + len(own)) * simple8b.BLOCK, n_ids) - i * simple8b.BLOCK
            left = np.concatenate([left, simple8b.decode(words, own, count)])
            done = int(edge[doc - 1]) if doc else 0
            upto = int(np.searchsorted(edge, done + len(left), side="right"))
            if upto > doc:
                taken = int(edge[upto - 1]) - done
                yield doc_id[doc:upto], null[doc:upto].astype(bool), length[doc:upto], left[:taken]
                left, doc = left[taken:], upto


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    rows, start = [], 0
    for path, _, n_ids in shards:
        rows.append((path, start))
        start += n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, start long").repartitionByRange(len(rows), "path")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first in zip(frame["path"], frame["start"]):
                for doc_id, null, length, ids in read_shard(path):
                    edge = np.cumsum(length)
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(edge.tolist(), length.tolist())]
                    ids_of = pd.Series(doc_id).astype("Int64").mask(null)
                    yield pd.DataFrame({"doc_id": ids_of, "start": first + edge - length, "n_tokens": length, "ids_crc32": crc})
                    first += int(edge[-1])

    return listed.mapInPandas(decode, schema)
