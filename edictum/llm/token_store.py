"""Token ids in binary shards, in ascending doc_id order, coded by Simple-8b.

A shard (all numbers little-endian): MAGIC; the 64-bit words of all blocks; escaped ids (u64);
the number of words of each block (u16); of each document doc_id (i64), whether it has one (u8)
and its number of ids (i64); last a footer of 5 i64: numbers of ids, documents, blocks, words
and escapes. Shards are numbered by the range of documents that they hold and the place in it,
so the concatenation of all shards is the corpus in order, and a reader finds any block by the
sums of the word counts. A task begins a new shard when the last one holds SHARD_IDS ids or
SHARD_DOCS documents, so neither a shard nor a reader grows with the corpus. Each shard is
written under a name of its own and renamed when it is whole, so a repeated task does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.llm import simple8b
from edictum.llm.vocabulary import encoder
from edictum.shipping import ship_package

MAGIC = b"EDS8B\x00\x00\x01"
#: Ids that are coded or decoded at once.
CHUNK = 1 << 20
#: Ids, and documents, after which a shard ends.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20
SHARDS = "shard int, part int, path string, n_docs bigint, n_tokens bigint"


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard as documents come, with bounded memory."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = self.n_escapes = self.n_words = 0
        self.doc_ids, self.known, self.lengths = array("q"), array("B"), array("q")
        self.escapes: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Ids are unsigned 32-bit numbers in bytes."""
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= CHUNK:
            self._code(self.n_waiting // simple8b.BLOCK * simple8b.BLOCK)

    def _code(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        words, per_block, escapes = simple8b.encode(ids[:n], self.n_escapes)
        self.out.write(words.astype("<u8").tobytes())
        self.waiting, self.n_waiting = [ids[n:].tobytes()], len(ids) - n
        self.n_ids, self.n_escapes, self.n_words = self.n_ids + n, self.n_escapes + len(escapes), self.n_words + len(words)
        self.escapes.append(escapes)
        self.blocks.append(per_block)

    @property
    def full(self) -> bool:
        """Whether the shard should end here."""
        return self.n_ids + self.n_waiting >= SHARD_IDS or len(self.lengths) >= SHARD_DOCS

    def abort(self) -> None:
        """Leave nothing behind."""
        self.out.close()
        self.fs.delete_file(self.part)

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        self._code(self.n_waiting)
        per_block = np.concatenate(self.blocks)
        n_docs = len(self.lengths)
        for x, kind in ((np.concatenate(self.escapes), "<u8"), (per_block, "<u2"), (self.doc_ids, "<i8"), (self.known, "u1"), (self.lengths, "<i8"), ([self.n_ids, n_docs, len(per_block), self.n_words, self.n_escapes], "<i8")):
            self.out.write(np.asarray(x).astype(kind).tobytes())
        self.out.close()
        self.fs.move(self.part, self.path)
        return n_docs, self.n_ids


def read_shard(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids (u32) of each document of a shard, in order, with bounded memory."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n_ids, n_docs, n_blocks, n_words, n_escapes = (int(x) for x in np.frombuffer(f.read_at(40, size - 40), "<i8"))
        at = len(MAGIC) + 8 * n_words
        if f.read_at(len(MAGIC), 0) != MAGIC or size != at + 8 * n_escapes + 2 * n_blocks + 17 * n_docs + 40:
            raise ValueError(f"{uri} is not a whole shard")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += out.nbytes
            return out

        escapes, per_block, doc_ids, known, lengths = take(n_escapes, "<u8"), take(n_blocks, "<u2").astype(np.int64), take(n_docs, "<i8"), take(n_docs, "u1"), take(n_docs, "<i8")
        first_word = np.concatenate([[0], np.cumsum(per_block)])
        rest, block = np.empty(0, np.uint32), 0
        for doc_id, there, n in zip(doc_ids.tolist(), known.tolist(), lengths.tolist()):
            while len(rest) < n:
                upto = min(n_blocks, block + max(CHUNK, n - len(rest)) // simple8b.BLOCK + 1)
                words = np.frombuffer(f.read_at(8 * int(first_word[upto] - first_word[block]), len(MAGIC) + 8 * int(first_word[block])), "<u8")
                ids = simple8b.decode(words, per_block[block:upto], min(n_ids, upto * simple8b.BLOCK) - block * simple8b.BLOCK, escapes)
                rest, block = np.concatenate([rest, ids.astype(np.uint32)]), upto
            yield doc_id if there else None, rest[:n]
            rest = rest[n:]


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, put ``end_id`` after each, and write shards below ``out_dir``; a row for each shard.

    ``out_dir`` is a URI that all executors can write to. Null and empty texts have the end id
    alone; null doc_ids come first; rows of one doc_id follow each other in the order of a hash
    of the text, repeated rows side by side. Ranges end between any two rows, so neither an id nor
    a repeated row has to fit in a task. An empty table gives shards without documents, or none.
    The returned table is written out and has as many rows as shards, so reading it doesn't
    encode again.
    """
    end = int(end_id).to_bytes(4, "little")
    kinds = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        fs, path = _open(out_dir)
        fs.create_dir(path, recursive=True)
        encode = encoder(tokenizer).encode_column
        uri = lambda: f"{out_dir}/shard-{shard:06d}-{part:04d}.eds8b"
        out = ShardWriter(uri())

        def done() -> pa.RecordBatch:
            n_docs, n_tokens = out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": uri(), "n_docs": n_docs, "n_tokens": n_tokens}], kinds)

        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    if out.full:
                        yield done()
                        part += 1
                        out = ShardWriter(uri())
                    out.add(doc_id, ids + end)
        except BaseException:
            out.abort()
            raise
        yield done()

    ship_package(docs.sparkSession)
    # the last key tells equal rows apart, so that they too can be split
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    spark = docs.sparkSession
    manifest = f"{out_dir}/manifest"
    ordered.mapInArrow(write, SHARDS).write.parquet(manifest)
    return spark.read.schema(SHARDS).parquet(manifest)


def read_tokens(spark: SparkSession, shards: DataFrame, digests_only: bool = False) -> DataFrame:
    """A row for each document of the shards: doc_id, start (ids of all documents before it), n_tokens, and the ids.

    ``ids`` is binary, of unsigned 32-bit numbers; with ``digests_only`` their crc32 takes its place.
    The list of shards has a row for each SHARD_IDS ids or so and goes through the driver.
    """
    start, rows = 0, []
    for r in sorted(shards.collect(), key=lambda r: (r["shard"], r["part"])):
        if r["n_docs"]:
            rows.append((r["path"], start))
        start += r["n_tokens"]
    last = ("ids_crc32", "bigint", pa.int64()) if digests_only else ("ids", "binary", pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (last[0], last[2])])
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, held = [], 0
                for doc_id, ids in read_shard(path):
                    data = ids.astype("<u4").tobytes()
                    out.append((doc_id, at, len(ids), zlib.crc32(data) if digests_only else data))
                    at, held = at + len(ids), held + len(data)
                    if len(out) >= 4096 or held > 1 << 24 and not digests_only:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    ship_package(spark)
    todo = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, len(rows)), "path")
    return todo.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {last[0]} {last[1]}")
