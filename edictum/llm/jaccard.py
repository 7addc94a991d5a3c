"""SimHash near-dedup at a Jaccard similarity of word shingles: wider than fingerprints reach, and checked exactly.

A text's set holds the hashes of its shingles of WORDS words (words as in simhash; a text with
fewer words is one shingle, one without words has the empty set). Texts with equal sets are one
entry. Entries meet in buckets. One bucket is the entry's class of SimHash fingerprints, found by
anchor-point covering as in simhash. Such classes hold the closest copies only: at a similarity
of 0.8 two fingerprints differ in 10 of 64 bits on average, and a covering that wide would need
thousands of anchors a fingerprint. So that none at 0.8 is lost, entries meet in BANDS further
buckets, by all ROWS minima of a band of hashes: a pair at 0.8 misses all of these with a
probability of 1.2e-7, one above it with less. Every link is checked on the whole sets, with
integers, so fingerprints that agree by chance link nothing.

Only classes are wanted, so large buckets aren't compared all against all: in TURNS rounds the
members of each bucket are checked against one pivot, and those that are in one class with it
need no more. Where members of different classes are left in a bucket, those outside its largest
class meet all others, dealt out in blocks of bounded size, whose sets are compared inside a task;
only links leave it. No pair that meets in a bucket is left out unless its class is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.components import connected_components
from edictum.llm.simhash import SEED, fingerprint_classes, fingerprint_of, forest, one_of_each, shingle_hashes
from edictum.llm.workspace import discard, join_unevenly, materialize
from edictum.shipping import ship_package

WORDS = 5
#: Links have 5 * common >= 4 * all shingles.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 40, 5
_random = np.random.default_rng(SEED)
FACTOR, SHIFT = (_random.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
FACTOR |= np.uint64(1)
#: Rounds of pivots.
TURNS = 2
#: Shingles of a block, about; a set counts for at least LEAST.
BLOCK, LEAST = 1 << 17, 128
#: Shingles that are held against all members of a group at once.
COLUMNS = 4_096


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles of a UTF-8 text, in order."""
    return np.unique(shingle_hashes(text, words))


def bands_of(hashes: np.ndarray) -> list[int]:
    """The bucket of a set in each band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024] * FACTOR + SHIFT).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def _signed(numbers: list[int]) -> list[int]:
    return np.array(numbers, dtype=np.uint64).view(np.int64).tolist()


def _sketch(text: Column, words: int) -> Column:
    @F.arrow_udf("entry bigint, fp bigint, n bigint, bands array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        entries, fps, sizes, bands = [], [], [], []
        for t in texts.cast(pa.binary()).to_pylist():
            hashes = shingle_hashes(t, words)
            s = np.unique(hashes)
            entries.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            fps.append(fingerprint_of(hashes))
            sizes.append(len(s))
            bands.append(_signed(bands_of(s)))
        return pa.StructArray.from_arrays([pa.array(_signed(entries), pa.int64()), pa.array(_signed(fps), pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["entry", "fp", "n", "bands"])

    return of(text)


def _sets(text: Column, words: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).view(np.int64) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return of(text)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a, b = (sets.select(F.col("entry").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    # sizes alone rule out most others before sets are intersected
    sized = pairs.join(a, "a").join(b, "b").withColumn("n", F.size("set_a") + F.size("set_b")).filter(F.least(F.size("set_a"), F.size("set_b")) * DENOMINATOR >= F.greatest(F.size("set_a"), F.size("set_b")) * NUMERATOR)
    return sized.select("a", "b", "n", common.alias("common")).filter(F.col("common") * DENOMINATOR >= (F.col("n") - F.col("common")) * NUMERATOR).select("a", "b")


def close_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets (arrays of different numbers) are similar enough, as a matrix."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    different, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(different)) > 1
    number, owner = np.cumsum(shared) - 1, np.repeat(np.arange(len(sets)), sizes)
    owner, column = owner[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        common += (held @ held.T).astype(np.int64)
    np.fill_diagonal(common, sizes)  # shingles that only one set has weren't counted
    return common * DENOMINATOR >= (sizes[:, None] + sizes[None, :] - common) * NUMERATOR


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, entry, shingles) sorted by group: links between members of a group, at most one fewer than it has members."""
    now, entries, sets = None, [], []

    def settle() -> pa.RecordBatch:
        i, j = forest(close_sets(sets)) if len(sets) > 1 else (np.empty(0, int), np.empty(0, int))
        e = np.array(entries, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[i], pa.int64()), pa.array(e[j], pa.int64())], ["a", "b"])

    for batch in batches:
        for group, entry, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if group != now:
                if len(sets) > 1:
                    yield settle()
                now, entries, sets = group, [], []
            entries.append(entry)
            sets.append(own.values.to_numpy())
    if len(sets) > 1:
        yield settle()


def _across_classes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``: links between members (band, entry, class, n) of one band that lie in different classes, and some inside a class."""
    weight = F.greatest("n", F.lit(LEAST))
    by_class = members.groupBy("band", "class").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("rows"))
    bands = by_class.groupBy("band").agg(F.max(F.struct("w", "class")).alias("most"), F.sum("w").alias("w"), F.sum("rows").alias("rows"))
    blocks = lambda w: F.greatest(F.ceil(w / BLOCK), F.lit(1)).cast("int")
    bands = bands.select("band", F.col("most.class").alias("major"), blocks(F.col("most.w")).alias("nm"), blocks(F.col("w") - F.col("most.w")).alias("no"), "rows")
    bands, n = materialize(bands, "blocks"), members.count()
    each = join_unevenly(members.select("band", "entry", "class"), bands, ["band"], "rows", n)
    place = lambda parts: F.pmod(F.xxhash64("entry"), parts).cast("int")
    upto = lambda parts: F.sequence(F.lit(0), parts - 1)
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own = place(F.col("no"))
    outside = F.concat(F.transform(upto(F.col("nm")), lambda j: pair(0, own, j)), F.transform(upto(F.col("no")), lambda j: pair(1, F.least(own, j), F.greatest(own, j))))
    major = F.transform(upto(F.col("no")), lambda j: pair(0, j, place(F.col("nm"))))
    dealt = each.select("entry", "band", F.explode(F.when(F.col("class") == F.col("major"), major).otherwise(outside)).alias("p"))
    dealt = dealt.select("entry", F.xxhash64("band", "p.kind", "p.x", "p.y").alias("grp"))
    found = dealt.join(sets, "entry").select("grp", "entry", "shingles").repartition("grp").sortWithinPartitions("grp", "entry").mapInArrow(_linked, "a bigint, b bigint")
    return found.distinct()


def near_duplicate_entries(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc``, ``th``, ``class`` of every row of ``docs`` (doc, th, text; doc and th name the text)."""
    ship_package(docs.sparkSession)
    placed = materialize(docs.select("doc", "th", _sketch(F.col("text"), words).alias("s")).select("doc", "th", "s.*"), "sketches")
    # of texts with one set the fingerprints can differ, by shingles that repeat: the least stands for them
    entries = placed.groupBy("entry").agg(F.min(F.struct("doc", "th")).alias("rep"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = materialize(entries, "entries")
    classes = materialize(fingerprint_classes(entries.select("fp")), "classes")
    each = entries.select("entry", "n", F.explode("bands").alias("band")).unionByName(entries.filter("n > 0").join(classes, "fp").select("entry", "n", F.xxhash64(F.lit("class"), "class").alias("band")))
    shared = materialize(each.groupBy("band").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi")).filter("lo <> hi").select("band"), "bands")
    members = materialize(each.join(shared, "band").withColumn("class", F.col("entry")), "members")
    wanted = materialize(entries.join(members.select("entry").distinct(), "entry", "left_semi").select("entry", F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th")), "wanted")
    texts = docs.join(wanted, ["doc", "th"]).groupBy("entry").agg(F.first("text").alias("text"))
    sets = materialize(texts.select("entry", _sets(F.col("text"), words).alias("shingles")), "sets")
    for done in (entries, classes, shared, wanted):
        discard(done)
    links = found = None
    for turn in range(TURNS + 1):
        if turn < TURNS:
            pivot = members.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "entry").alias("h"), F.col("entry").alias("p"), F.col("class").alias("q"))).alias("m"))
            pairs = members.join(pivot, "band").filter("class <> m.q").select(F.least("entry", "m.p").alias("a"), F.greatest("entry", "m.p").alias("b"))
            new = materialize(_checked(pairs.distinct(), sets), "links")
        else:
            new = materialize(_across_classes(members, sets), "links")
        discard(found)
        links = new if links is None else links.unionByName(new)
        found = materialize(connected_components(links, "a", "b"), "found")
        if turn < TURNS:
            classed = members.drop("class").join(found, members["entry"] == found["node"], "left").select("band", "entry", "n", F.coalesce("component", "entry").alias("class"))
            split = classed.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("band")
            members, before = materialize(classed.join(split, "band"), "members"), members
            discard(before)
    for done in (members, sets):
        discard(done)
    return placed.select("doc", "th", "entry").join(found, F.col("entry") == F.col("node"), "left").select("doc", "th", F.coalesce("component", "entry").alias("class"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents without all but the one of least (doc_id, text hash) of each class; repeated rows count as copies.

    Classes are those of all pairs whose similarity is at least 0.8. Rows without a doc_id are kept. Columns are those of ``docs``.
    """
    return one_of_each(docs, lambda keyed: near_duplicate_entries(keyed, words))
