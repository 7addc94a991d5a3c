"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z lower-cased, words are runs of anything but ASCII white space, shingles of
``words`` words (repeats included) joined by single spaces; each shingle is hashed by XXH64
(UTF-8, seed 42), and a bit of the fingerprint is 1 if it is set in over half the hashes. Texts
with fewer words are one shingle; texts without words (null and empty too) have fingerprint 0,
linked like any other.

Covering code: the 63 low bits are read as a word of the perfect Hamming [63, 57] code, of
covering radius 1, and the top bit is kept as it is. Two fingerprints that differ in at most 2
bits have a word halfway that is within 1 bit of both, and the anchor nearest to that word is
within 1 more. So both sides are replicated to every anchor within the covering radius plus
their half of the threshold (33 anchors at most), meet at a common anchor, and are compared
there. By construction an anchor can't have more than about 2,100 distinct fingerprints, so no
group grows with the data. Identical fingerprints are one entry from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.components import connected_components
from edictum.llm.workspace import OWN, apart, join_unevenly, materialize, materialize_counted
from edictum.shipping import ship_package

THRESHOLD = 2
SEED = 42
#: Masks of the six parity checks: check j covers the bits i (0 to 62) for which i + 1 has bit j.
CHECKS = np.array([sum(1 << i for i in range(63) if (i + 1) >> j & 1) for j in range(6)], dtype=np.uint64)
#: For each syndrome but 0, the 31 pairs of bits whose flips give a code word.
PAIRS = np.array([[0] * 31] + [[1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 64) if p < p ^ s] for s in range(1, 64)], dtype=np.uint64)
TOP = np.uint64(1 << 63)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """The hash of each shingle of a UTF-8 text, repeats included; none for a text without words."""
    w = (text or b"").lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)] if w else []
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned 64-bit number; 0 for none."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the bits of a very long text are counted in blocks
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned 64-bit number."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_column(text: Column | str, words: int = 3) -> Column:
    """The fingerprint as a signed 64-bit column."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64))

    return of(text)


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of unsigned fingerprints, and for each the index of its fingerprint."""
    syndrome = np.zeros(len(fps), dtype=np.int64)
    for j, mask in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(fps & mask).astype(np.int64) & 1) << j
    off = np.flatnonzero(syndrome)
    home = fps.copy()
    home[off] ^= np.uint64(1) << (syndrome[off] - 1).astype(np.uint64)
    near = (fps[off, None] ^ PAIRS[syndrome[off]]).reshape(-1)
    index = np.arange(len(fps))
    return np.concatenate([home, home ^ TOP, near]), np.concatenate([index, index, np.repeat(off, 31)])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            a, i = anchors_of(fp[at : at + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(fp[at : at + 4096][i]), pa.array(rep[at : at + 4096][i])], ["anchor", "fp", "rep"])


def forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the members of a group, of which ``close`` tells who is linked: each with the first member of its class, if that is another."""
    n = len(close)
    label = np.arange(n)
    while True:
        new = np.where(close, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: links between members of an anchor, at most one fewer than it has members."""
    rest = np.empty((3, 0), dtype=np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        anchor, fp, rep = rows[0], rows[1].view(np.uint64), rows[2]
        starts = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1))
        sizes = np.diff(starts, append=len(anchor))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= THRESHOLD]
        a, b = [rep[two]], [rep[two + 1]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = fp[at : at + n]
            i, j = forest(np.bitwise_count(own[:, None] ^ own[None, :]) <= THRESHOLD)
            a.append(rep[at + i])
            b.append(rep[at + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        last = np.searchsorted(rows[0], rows[0, -1])  # the last anchor may go on in the next batch
        rest = rows[:, last:]
        if last:
            yield links(rows[:, :last])
    if rest.shape[1]:
        yield links(rest)


def near_duplicate_links(distinct: DataFrame) -> DataFrame:
    """``a``, ``b``: links whose classes are those of all pairs at 2 or fewer differing bits.

    ``distinct``: ``fp`` (each once) and ``rep`` (a long that names it), without nulls.
    """
    ship_package(distinct.sparkSession)
    placed = distinct.select("fp", "rep").mapInArrow(_replicate, "anchor bigint, fp bigint, rep bigint")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a bigint, b bigint").distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (signed), ``component_id`` (the least doc_id reachable) for every row of ``docs``.

    Null and empty texts have fingerprint 0. Rows without a doc_id keep their fingerprint, take no
    part in links and have a null component. Repeated rows are kept as they are. An empty table
    gives no rows. Other columns are left out, whatever they are called.
    """
    ship_package(docs.sparkSession)
    fps = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), words).alias("fp")), "fingerprints")
    distinct = materialize(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = connected_components(near_duplicate_links(distinct), "a", "b")
    classes = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """``fp``, ``class`` for each different ``fp`` (signed, not null): one class for all that 2 or fewer bits link, step by step."""
    # a fingerprint is named by itself: an id that has several would join their classes
    distinct = materialize(fps.select("fp").distinct().withColumn("rep", F.col("fp")), "distinct")
    found = connected_components(near_duplicate_links(distinct), "a", "b")
    return distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"))


def one_of_each(docs: DataFrame, classes_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents without all but the one of least (doc_id, text hash) of each class.

    ``classes_of`` gives doc, th and class for each row of a table of doc, th and text. Documents
    are told apart by id and text: different texts of one id each stay or go with their own
    class. Of rows repeated in both, one stays. Rows without a doc_id are kept.
    """
    keyed = apart(docs).withColumn("__doc", F.col(f"{OWN}.doc_id").cast("long")).withColumn("__th", F.xxhash64(f"{OWN}.text"))
    classed = classes_of(keyed.filter("__doc is not null").select(F.col("__doc").alias("doc"), F.col("__th").alias("th"), f"{OWN}.text"))
    classed, total = materialize_counted(classed.groupBy("doc", "th").agg(F.first("class").alias("class"), F.count(F.lit(1)).alias("n")), "classed")
    first = materialize(classed.groupBy("class").agg(F.min(F.struct("doc", "th")).alias("keep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "first")
    alone = classed.filter("n > 1").join(first.select("class"), "class", "left_anti").withColumn("keep", F.struct("doc", "th"))
    status = join_unevenly(classed, first, ["class"], "rows", total).unionByName(alone).select(F.col("doc").alias("__d"), F.col("th").alias("__t"), (F.struct("doc", "th") == F.col("keep")).alias("kept"), "n")
    gone = materialize(status.filter("not kept or n > 1"), "gone")
    same = (F.col("__doc") == F.col("__d")) & (F.col("__th") == F.col("__t"))
    out = keyed.join(gone, same, "left_anti")
    repeated = materialize(gone.filter("kept"), "repeated")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["__doc", "__th"]))
    return out.select(f"{OWN}.*")
