"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts become words: A-Z lower-cased, every other ASCII character but digits and letters parts them.
The automaton has a state for each class of word sequences that end at the same places of the items. A
document's words are streamed through it, which gives, at each word, the longest sequence ending there
that some item holds. A window is a run of item words that counts as a leak: ``length`` words, or, of an item
so short that fewer words are the share ``coverage`` of it, that many. States know the longest
window that ends in them for each matching length, and the items of their windows.

Items are dealt out to shards of a bounded number of words, each built in a task; a shard is the unit that
is broadcast (SHARD words at most twice, some 30 MB), and documents pass the shards one after the other.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.workspace import materialize
from edictum.operators.ordered import running_sum
from edictum.shipping import ship_package

#: A shard takes pieces of items until it holds so many words; a longer item is cut into pieces that overlap.
SHARD = 1 << 18
_PARTS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_NORMAL = bytes.maketrans(_PARTS, b" " * len(_PARTS))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a text in UTF-8."""
    return text.lower().translate(_NORMAL).split()


class Automaton:
    """States of a suffix automaton over several sequences of words, built for streaming.

    ``most`` is the length of the longest window, 255 at most.
    """

    def __init__(self, items: list[tuple[str, list[bytes], int]], most: int) -> None:
        """``items`` has a name, words and the length of a window for each."""
        self.most, self.names = most, [name for name, _, _ in items]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words] for _, words, _ in items]
        ways, self.link, self.length = [{}], array("i", [-1]), array("i", [0])
        for codes in coded:
            last = 0
            for c in codes:
                last = self._extend(ways, last, c)
        windows: dict[int, dict[int, list[int]]] = {}
        for i, (codes, (_, _, n)) in enumerate(zip(coded, items)):
            v = 0
            for at, c in enumerate(codes):
                v = ways[v][c]
                while self.length[self.link[v]] >= n:
                    v = self.link[v]
                if at + 1 >= n:
                    held = windows.setdefault(v, {}).setdefault(n, [])
                    if not held or held[-1] != i:
                        held.append(i)
        self.windows = windows
        self.shortest = min((n for held in windows.values() for n in held), default=1)
        self._settle(ways)

    def _extend(self, ways: list[dict[int, int]], last: int, c: int) -> int:
        """The state of the sequence so far and ``c``."""
        known = ways[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(ways, last, c, known)
        new = self._state(ways, {}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = ways[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(ways, p, c, q)
        return new

    def _state(self, ways: list[dict[int, int]], out: dict[int, int], length: int) -> int:
        ways.append(out)
        self.link.append(0)
        self.length.append(length)
        return len(ways) - 1

    def _split(self, ways: list[dict[int, int]], p: int, c: int, q: int) -> int:
        """The shorter sequences of ``q``, those that ``p`` leads to, as a state of their own."""
        short = self._state(ways, dict(ways[q]), self.length[p] + 1)
        self.link[short], self.link[q] = self.link[q], short
        while p >= 0 and ways[p].get(c) == q:
            ways[p][c] = short
            p = self.link[p]
        return short

    def _settle(self, ways: list[dict[int, int]]) -> None:
        """Ways out as arrays, and the longest window for each state and matching length."""
        n = len(ways)
        self.word, self.to, self.more = array("i", [0]) * n, array("i", [0]) * n, {}
        for v, out in enumerate(ways):
            if len(out) == 1:
                self.word[v], self.to[v] = next(iter(out.items()))
            elif out:
                self.more[v] = out
        self.row, self.best = array("i", [0]) * n, [bytes(self.most + 1)]
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            short = self.length[up]
            if short >= self.most:
                self.row[v] = self.row[up]
                continue
            own, row = self.windows.get(v, {}), bytearray(self.best[self.row[up]])
            for size in range(short + 1, self.most + 1):
                row[size] = size if size in own else row[size - 1]
            self.row[v] = len(self.best)
            self.best.append(bytes(row))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Disjoint spans of leaked words, the names of the items that hold their windows, and the longest match."""
        get, word, to, more, link, length, row, best, most, shortest = self.ids.get, self.word, self.to, self.more, self.link, self.length, self.row, self.best, self.most, self.shortest
        v = now = longest = 0
        spans: list[tuple[int, int]] = []
        found: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                v = now = 0
                continue
            while True:
                if word[v] == c:
                    v = to[v]
                    now += 1
                    break
                t = more[v].get(c) if v in more else None
                if t is not None:
                    v = t
                    now += 1
                    break
                if not v:
                    break
                v = link[v]
                now = length[v]
            if now >= shortest:
                if now > longest:
                    longest = now
                size = now if now < most else most
                window = best[row[v]][size]
                if window:
                    a = i + 1 - window
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
                    found.add((v, size))
        return spans, self._names(found), longest

    def _names(self, found: set[tuple[int, int]]) -> set[str]:
        out: set[int] = set()
        done: dict[int, int] = {}
        for v, size in found:
            while v > 0 and done.get(v, -1) < size:
                done[v] = size
                for n, items in self.windows.get(v, {}).items():
                    if n <= size:
                        out.update(items)
                v = self.link[v]
        return {self.names[i] for i in out}


def _pieces(batches: Iterator[pa.RecordBatch], length: int, coverage: float, shard: int) -> Iterator[pa.RecordBatch]:
    """Items as pieces of at most ``shard`` words, which overlap so that no window is cut."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text or b"")
            if not words:
                continue
            window = max(1, min(length, math.ceil(coverage * len(words))))
            for a in range(0, max(1, len(words) - window + 1), shard):
                piece = words[a : a + shard + window - 1]
                rows.append((item or "", b" ".join(piece), window, len(piece)))
        names, kinds = ("item", "words", "window", "n"), (pa.string(), pa.binary(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)


def build_automata(items: DataFrame, length: int = 10, coverage: float = 1.0, shard: int = SHARD) -> tuple[DataFrame, list[int]]:
    """Pickled automata, ``shard`` (from 0) and ``blob``, and the numbers of the shards. ``items`` has item_id and text; see match_documents()."""
    ship_package(items.sparkSession)
    said = items.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary"))
    cut = said.mapInArrow(lambda batches: _pieces(batches, length, coverage, shard), "item string, words binary, window int, n bigint")
    pieces = materialize(cut.withColumn("key", F.sha2(F.concat(F.col("item").cast("binary"), F.col("words")), 256)), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total > shard:
        pieces = running_sum(pieces, "key", "n", "before").withColumn("shard", F.floor(F.col("before") / shard).cast("int"))
    else:
        pieces = pieces.withColumn("shard", F.lit(0))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "key"])
        held = Automaton([(r.item, bytes(r.words).split(), int(r.window)) for r in rows.itertuples()], length)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "blob": [pickle.dumps(held, protocol=5)]})

    automata = materialize(pieces.groupBy("shard").applyInPandas(build, "shard int, blob binary"), "automata")
    return automata, sorted(r["shard"] for r in automata.select("shard").collect())


_LOADED: list = [None, None]


def _loaded(key: str, broadcast) -> Automaton:
    """The automaton of a broadcast; a worker holds one at a time."""
    if _LOADED[0] != key:
        _LOADED[:] = [None, None]
        _LOADED[:] = [key, pickle.loads(broadcast.value)]
    return _LOADED[1]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


_FOUND = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def _stream(batches: Iterator[pa.RecordBatch], key: str, broadcast, names: list[str], cut: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``row``, ``text`` and what was found so far, with what one more automaton finds."""
    automaton = _loaded(key, broadcast)
    for batch in batches:
        texts, before = batch.column(1), [batch.column(i) for i in range(2, 6)]
        rows, kept = [], []
        for i, text in enumerate(texts):
            text = text.as_py()
            words = words_of(text or b"")
            spans, items, longest = automaton.search(words)
            flat = before[1][i].as_py()
            if flat:
                spans = _united([*spans, *zip(flat[::2], flat[1::2])])
            rows.append((len(words), [x for s in spans for x in s], sorted(items.union(before[2][i].as_py())), max(longest, before[3][i].as_py())))
            if cut:
                kept.append(_without(text, spans) if spans else text)
        out = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FOUND)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()) if cut else texts, *out], names=names)


def _matched(docs: DataFrame, columns: list[str], items: DataFrame, length: int, coverage: float, shard: int, cut: bool) -> DataFrame:
    """``row`` (the columns named), ``text`` as bytes, and what all automata find; one pass over the documents for each."""
    if not 1 <= length <= 255:
        raise ValueError("length must be 1 to 255 words")
    automata, shards = build_automata(items, length, coverage, shard)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"))
    for k in shards or [None]:
        blob = pickle.dumps(Automaton([], length)) if k is None else bytes(automata.filter(F.col("shard") == k).first()["blob"])
        last = k is None or k == shards[-1]
        rows = _pass(rows, sc.broadcast(blob), cut and last)
        if not last:
            rows = materialize(rows, "contaminated", "zstd")
    return rows


def _pass(rows: DataFrame, broadcast, cut: bool) -> DataFrame:
    key, names = uuid.uuid4().hex, rows.columns
    return rows.mapInArrow(lambda batches: _stream(batches, key, broadcast, names, cut), rows.schema)


def match_documents(docs: DataFrame, items: DataFrame, length: int = 10, coverage: float = 1.0, shard: int = SHARD) -> DataFrame:
    """What of each document stands in test items: doc_id, n_words, spans, items, longest.

    A run of ``length`` item words (255 at most), or of fewer if they are the share ``coverage`` of all words of their item,
    is a leak; every word of a document in any such run is. ``spans`` are the disjoint spans of leaked words (from, to,
    from, ...), ``items`` the ids of all items that hold one of the document's runs, sorted as strings, each once;
    ``longest`` is the length of the longest run that document and some item share.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are left out. Null and empty texts have no
    words, items without words are no items, a null item_id is an empty string. Rows with one id stay rows of their own.
    Texts are read whole, in time linear in their words. Without items nothing is found; without documents no rows.
    """
    found = _matched(docs, ["doc_id"], items, length, coverage, shard, cut=False)
    return found.select("row.doc_id", "n_words", "spans", "items", "longest")


def remove_leaks(docs: DataFrame, items: DataFrame, length: int = 10, coverage: float = 1.0, shard: int = SHARD) -> DataFrame:
    """``docs`` with all its columns, and ``text`` without leaked spans; see match_documents(). Null texts stay null."""
    found = _matched(docs, docs.columns, items, length, coverage, shard, cut=True)
    return found.select(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def digest(matched: DataFrame) -> DataFrame:
    """Counts and a digest of the items of what match_documents() found."""
    at = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    hit = F.when(F.size("spans") == 0, 0).otherwise(F.aggregate(at, F.lit(0).cast("long"), lambda n, i: n + F.get("spans", i + 1) - F.get("spans", i)))
    return matched.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
