"""Cost-balanced packing of token sequences.

The cost of a piece is linear plus quadratic in its length, as that of attention over it.
Whole multiples of the sequence length fill sequences of their own. The rest of each document
goes to one of many groups by a hash of its id and tokens; there are so many groups that each has
about WINDOW rests. The rests of a group are dealt out in descending order, each to the sequence
of lowest cost that has room for it; one that fits nowhere is cut at the roomiest sequence. A
group has as few sequences as its tokens need, so it pads less than one sequence, however the
input is split; groups and places in them follow from the documents alone. A group that grows
beyond twice WINDOW, by repeated rows, is dealt out part by part in bounded memory, and an id that
very many rows share is dealt out to several groups. Sequence ids hold the group and a count.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.vocabulary import encoder
from edictum.llm.workspace import HEAVY
from edictum.shipping import ship_package

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Documents of a group, about.
WINDOW = 2048
#: Bytes of ids that a task holds before it sends them on.
HELD = 1 << 24
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
_TYPES = [pa.int64()] * 7
_GROUPED = "grp int, h bigint, doc_id bigint, tokens bigint, crcs array<bigint>, ids binary"
_KINDS = pa.schema([("grp", pa.int32()), ("h", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("ids", pa.binary())])


def cost(length: int) -> float:
    """Estimated cost of a piece."""
    return LINEAR * length + QUADRATIC * length * length


def deal(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, sequence, offset) of items of at most ``capacity``."""
    total = sum(lengths)
    if not total:
        return []
    n = -(-total // capacity)
    spent, room = np.zeros(n), np.full(n, capacity, dtype=np.int64)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = np.flatnonzero(room >= left)
            at = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(room))
            take = min(left, int(room[at]))
            out.append((item, start, take, at, capacity - int(room[at])))
            room[at] -= take
            spent[at] += cost(take)
            start, left = start + take, left - take
    return out


def _narrow(ids: bytes) -> bytes:
    """Unsigned 32-bit ids in half the space, if all are below 65,536; the first byte tells."""
    x = np.frombuffer(ids, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if x.max(initial=0) < 1 << 16 else b"\x04" + ids


def _wide(ids: bytes) -> bytes:
    """The inverse of _narrow()."""
    return np.frombuffer(ids, "<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document, place in it, length, crc32 of its ids, sequence and offset there.

    Null and empty texts are one piece of the end id alone. Null doc_ids stay null; repeated rows
    are packed each. An empty table gives no rows; other columns are left out. ``with_ids`` adds
    the ids (binary, unsigned 32-bit numbers). The result depends on the rows only, not on how
    they are split, unless one id has more than an eighth of a shuffle partition's share of rows:
    then places among its rows can differ.
    """
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")
    schema = PIECE + ", ids binary" * with_ids
    types = pa.schema([(n, t) for n, t in zip(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], _TYPES)] + [("ids", pa.binary())] * with_ids)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_rows = rows.count()
    n_groups = max(1, -(-n_rows // WINDOW))
    # ids with very many rows, and over how many groups to deal them: fewer than HEAVY a partition
    many = max(WINDOW, n_rows // (HEAVY * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = {r["doc_id"]: -(-r["count"] // WINDOW) for r in rows.groupBy("doc_id").count().filter(F.col("count") > many).collect()}

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_column
        out: list[tuple] = []
        held = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS.types)], schema=_KINDS)
            out.clear()
            held = 0
            return batch

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                tokens, turn = len(ids) // 4, turn + 1
                whole = tokens // capacity * capacity
                h = xxhash.xxh64_intdigest(ids) - (1 << 63)
                part = turn % parts[doc_id] if doc_id in parts else 0
                grp = xxhash.xxh64_intdigest(struct.pack("<?qqq", doc_id is None, doc_id or 0, h, part)) % n_groups
                crcs = [zlib.crc32(ids[4 * at : 4 * (at + capacity)]) for at in range(0, whole, capacity)]
                out.append((grp, h, doc_id, tokens, crcs, _narrow(ids if with_ids else ids[4 * whole :])))
                held += len(out[-1][-1])
                if held > HELD or len(out) == 4096:
                    yield flush()
        if out:
            yield flush()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        rests: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start of the rest, tokens of the document, ids
        now, sequence = None, 0

        def piece(doc_id: int | None, start: int, length: int, crc: int, tokens: int, at: int, offset: int, ids: bytes) -> None:
            rows.append((doc_id, start, length, crc, tokens, (now << 32) + at, offset) + ((ids,) if with_ids else ()))

        def settle() -> None:
            nonlocal sequence
            dealt = deal([len(ids) // 4 for *_, ids in rests], capacity)
            for item, start, length, at, offset in dealt:
                doc_id, begin, tokens, ids = rests[item]
                ids = ids[4 * start : 4 * (start + length)]
                piece(doc_id, begin + start, length, zlib.crc32(ids), tokens, sequence + at, offset, ids)
            sequence += 1 + max((at for *_, at, _ in dealt), default=-1)
            rests.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
            rows.clear()
            return out

        for batch in batches:
            for grp, doc_id, tokens, crcs, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if grp != now:
                    settle()
                    now, sequence = grp, 0
                ids, whole = _wide(ids), len(crcs) * capacity
                for at, crc in enumerate(crcs):
                    piece(doc_id, at * capacity, capacity, crc, tokens, sequence, 0, ids[4 * at * capacity : 4 * (at + 1) * capacity])
                    sequence += 1
                if tokens > whole:
                    rests.append((doc_id, whole, tokens, ids[4 * whole if with_ids else 0 :]))
                    if len(rests) == 2 * WINDOW:
                        settle()
                if len(rows) >= 4096:
                    yield flush()
        settle()
        if rows:
            yield flush()

    ship_package(spark)
    grouped = rows.mapInArrow(group, _GROUPED).repartition("grp").sortWithinPartitions("grp", "h", "doc_id")
    return grouped.mapInArrow(pack, schema)
