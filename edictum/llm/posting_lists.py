"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted by balanced k-means to a bounded sample of vectors; their number grows with
the root of the number of vectors, so a list grows with the root too. Every vector goes to the
list of its nearest centroid and, if it lies near a boundary, to those of other centroids almost
as near (fewer if they lie in the same direction). A query finds centroids by best-first search
of an in-memory graph of centroids, until the nearest that is left is beyond a ratio of the
least distance, and reads the lists of all within the ratio, at least a few, and more until they
hold enough ids. Lists that lie together share a cell, and a vector or query travels once to each
of its cells; there the lists that a query reads are compared exactly, in double precision. A
cell that has many vectors or queries is dealt out in shards, so no group grows with the data.
Centroids and graph are of bounded number and travel in closures; vectors and queries only by
shuffle. Without a ratio every list is read, and the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edictum.llm.workspace import materialize
from edictum.shipping import ship_package


@dataclass(frozen=True)
class Settings:
    """Parameters of index and search."""

    lists: float = 2.0  #: lists for the root of the number of vectors
    most_lists: int = 4_096  #: and at most so many
    per_list: int = 16  #: least vectors of the sample for each list
    sample: int = 65_536  #: most vectors that centroids are fitted to, the least by a hash,
    sample_bytes: int = 1 << 26  #: and most bytes of them
    rounds: int = 8  #: of k-means
    balance: float = 0.5  #: weight of a list's size in the assignment while fitting
    copies: int = 4  #: most lists of a vector; the nearest is always among them
    boundary: float = 1.12  #: distance to another centroid over that to the nearest, up to which a vector is replicated
    neighbours: int = 16  #: of a centroid in the graph
    patience: int = 32  #: centroids that a search goes through at least
    ratio: float | None = 1.5  #: distance to a centroid over that to the nearest, up to which its list is read; None: all lists
    fewest: int = 4  #: lists that a query reads at least
    shard: int = 8_192  #: about so many vectors, and so many queries, meet in one group


#: Distances that differ by less are equal: the root of 2 - 2 cos has rounding noise of about 2e-8 near 0.
SLACK = 1e-6
#: Rows that are held against all centroids at once.
ROWS = 1_024


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ c.T))


@dataclass(frozen=True)
class Index:
    """Centroids (unit vectors), for each its neighbours in the graph, and the cell of its list."""

    centroids: np.ndarray
    graph: np.ndarray
    cell: np.ndarray

    def search(self, x: np.ndarray, ratio: float, patience: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and their distances, nearest first, found by best-first search until all that is left lies beyond the ratio."""
        first = float(_distances(x[None], self.centroids[:1])[0, 0])
        found, todo, least, gone_through = {0: first}, [(first, 0)], first, 0
        while todo:
            far, i = heapq.heappop(todo)
            if gone_through >= patience and far > ratio * least + SLACK:
                break
            gone_through += 1
            new = [j for j in dict.fromkeys(self.graph[i].tolist()) if j not in found]
            if new:
                for j, d in zip(new, _distances(x[None], self.centroids[new])[0].tolist()):
                    found[j] = d
                    least = min(least, d)
                    heapq.heappush(todo, (d, j))
        at, d = np.array(list(found)), np.array(list(found.values()))
        order = np.lexsort((at, d))
        return at[order], d[order]


def _apart(c: np.ndarray) -> np.ndarray:
    """The unit vectors without those equal to an earlier one."""
    keep = np.ones(len(c), dtype=bool)
    for at in range(0, len(c), ROWS):
        equal = 2 - 2 * c[at : at + ROWS] @ c.T <= SLACK * SLACK
        keep[at : at + ROWS] &= ~np.tril(equal, at - 1).any(axis=1)
    return c[keep]


def _means(x: np.ndarray, k: int, s: Settings) -> np.ndarray:
    """At most k different unit vectors by balanced spherical k-means."""
    different = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    c = _apart(different[np.linspace(0, len(different) - 1, max(1, min(k, len(different)))).astype(int)])
    size = np.zeros(len(c))
    for _ in range(s.rounds):
        full = size / len(x) * len(c) - 1 if size.any() else size  # over 0: larger than the mean
        at = np.concatenate([np.argmax(x[i : i + ROWS] @ c.T - s.balance * 0.1 * full, axis=1) for i in range(0, len(x), ROWS)])
        size = np.bincount(at, minlength=len(c)).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return _apart(c)


def fit(x: np.ndarray, n: int, s: Settings) -> Index:
    """Centroids for n vectors from a sample of unit vectors, a graph of nearest and ring neighbours over them, and cells of near ones."""
    if not len(x):
        return Index(np.zeros((1, x.shape[1])), np.zeros((1, 1), dtype=int), np.zeros(1, dtype=int))
    c = _means(x, min(s.most_lists, len(x) // s.per_list, math.ceil(s.lists * math.sqrt(n))), s)
    k = len(c)
    near = min(s.neighbours, k - 1)
    graph = np.concatenate([np.argsort(-np.where(np.arange(k) == np.arange(at, min(k, at + ROWS))[:, None], -2, c[at : at + ROWS] @ c.T), axis=1)[:, :near] for at in range(0, k, ROWS)])
    ring = np.stack([(np.arange(k) + 1) % k, (np.arange(k) - 1) % k], axis=1)  # keeps the graph in one part
    middles = _means(c, math.ceil(math.sqrt(k)), s)
    return Index(c, np.concatenate([graph, ring], axis=1), np.argmax(c @ middles.T, axis=1))


def lists_of(x: np.ndarray, index: Index, s: Settings) -> list[list[int]]:
    """The lists of each row: the nearest, and others within the boundary unless a chosen one is nearer to them than the row is."""
    c, out = index.centroids, []
    for d in _distances(x, c):
        within = np.flatnonzero(d <= s.boundary * d.min() + SLACK)
        chosen: list[int] = []
        for j in within[np.argsort(d[within], kind="stable")].tolist():
            if not chosen or (_distances(c[j][None], c[chosen]) > d[j]).all():
                chosen.append(j)
                if len(chosen) == s.copies:
                    break
        out.append(chosen)
    return out


def lists_to_read(x: np.ndarray, index: Index, s: Settings, ids: np.ndarray, k: int) -> list[int]:
    """The lists that a query reads: those within the ratio, at least ``fewest``, and by distance until they hold k ids besides its own.

    ``ids`` counts for each list its ids, each as its share of the lists that it stands in.
    """
    if s.ratio is None:
        return list(range(len(ids)))
    near, dist = index.search(x, s.ratio, s.patience)
    held = np.cumsum(ids[near])
    n = max(s.fewest, int(np.searchsorted(dist, s.ratio * dist[0] + SLACK, "right")), int(np.searchsorted(held, k + 1 - 1e-6)) + 1)
    return near[:n].tolist() if n <= len(near) or held[-1] > k else list(range(len(ids)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _members(lists: pa.ChunkedArray, of_cell: np.ndarray) -> np.ndarray:
    """Rows by lists of a cell: whether the row stands in, or asks for, the list."""
    column = lists.combine_chunks()
    out = np.zeros((len(column), len(of_cell)), dtype=np.float32)
    out[np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), np.searchsorted(of_cell, column.flatten().to_numpy())] = 1
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine): the k nearest found of each row whose id is divisible by ``every``.

    ``lists_read`` and ``vectors_read`` tell how many lists the query read and how many vectors
    stand in them. A row is not its own neighbour; ties go to the smaller vec_id. Vectors that are
    null, zero or hold null or non-finite components, and rows without an id, take no part, nor do
    vectors of another length than most (of ties, the least), so such queries have no rows. Of
    repeated ids, one is returned a rank. An empty table gives no rows. With ``ratio=None`` in the
    settings all vectors are read and the result is exact.
    """
    ship_package(vectors.sparkSession)
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double, lists_read int, vectors_read bigint"
    if width is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == width["n"])
    n_wanted = math.ceil(settings.lists * math.sqrt(width["count"])) * 2 * settings.per_list
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(settings.sample, max(16_384, n_wanted), settings.sample_bytes // (8 * width["n"])))).toArrow()
    x = _matrix(sample["v"].combine_chunks())
    index = fit(x / np.linalg.norm(x, axis=1, keepdims=True), width["count"], settings)
    n_lists = len(index.centroids)

    def assign(ids: np.ndarray | None, sizes: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    x = _matrix(part.column(1))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    lists = lists_of(x, index, settings) if ids is None else [lists_to_read(q, index, settings, ids, k) for q in x]
                    take, cells, inside, number, total = [], [], [], [], []
                    for i, own in enumerate(lists):
                        by_cell: dict[int, list[int]] = {}
                        for j in own:
                            by_cell.setdefault(int(index.cell[j]), []).append(j)
                        take += [i] * len(by_cell)
                        cells += by_cell
                        inside += by_cell.values()
                        number += [len(own)] * len(by_cell)
                        total += [0 if ids is None else int(sizes[own].sum())] * len(by_cell)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), part.column(1).take(pa.array(take, pa.int64())), pa.array(cells, pa.int32()), pa.array(inside, pa.list_(pa.int32())), pa.array(number, pa.int32()), pa.array(total, pa.int64())], ["vec_id", "v", "cell", "lists", "n", "m"])

        return run

    kind = "vec_id bigint, v array<double>, cell int, lists array<int>, n int, m bigint"
    posted = materialize(rows.mapInArrow(assign(None), kind), "posted")
    # a row a list
    stands = posted.select("vec_id", F.explode("lists").alias("list"))
    size = stands.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    held = stands.groupBy("vec_id").agg(F.collect_set("list").alias("in")).select(F.explode("in").alias("list"), (1 / F.size("in")).alias("share")).groupBy("list").agg(F.sum("share").alias("share")).collect()
    ids, sizes = np.zeros(n_lists), np.zeros(n_lists, dtype=np.int64)
    ids[[r["list"] for r in held]] = [r["share"] for r in held]
    sizes[[r["list"] for r in size]] = [r["n"] for r in size]
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).mapInArrow(assign(ids, sizes), kind), "asked")
    # how many shards each cell has on either side: a row a cell
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / settings.shard).cast("int").alias(name))
    shards = F.broadcast(parts(posted, "np").join(parts(asked, "nq"), "cell"))
    mine = F.pmod(F.xxhash64("vec_id"), F.col("np")).cast("int")
    left = posted.join(shards, "cell").select("vec_id", "v", "cell", "lists", mine.alias("ps"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qs"))
    ours = F.pmod(F.xxhash64("vec_id"), F.col("nq")).cast("int")
    right = asked.join(shards, "cell").select("vec_id", "v", "cell", "lists", "n", "m", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("ps"), ours.alias("qs"))

    def compare(have: pa.Table, want: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("lists_read", pa.int32()), ("vectors_read", pa.int64())])
        if not have.num_rows or not want.num_rows:
            return kinds.empty_table()
        have, want = have.sort_by("vec_id"), want.take(pc.sort_indices(pc.list_element(want["lists"].combine_chunks(), 0)))
        x, y = (_matrix(t["v"].combine_chunks()) for t in (have, want))
        ids, asking, n_read, m_read = (t.to_numpy() for t in (have["vec_id"], want["vec_id"], want["n"], want["m"]))
        of_cell = np.flatnonzero(index.cell == have["cell"][0].as_py())
        stands, asks = _members(have["lists"], of_cell), _members(want["lists"], of_cell)
        norms, y_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        out: list[tuple] = []
        for at in range(0, len(y), 128):
            block = slice(at, at + 128)
            cols = np.flatnonzero(stands[:, asks[block].any(axis=0)].any(axis=1))
            if not len(cols):
                continue
            some = ids[cols]
            starts = np.flatnonzero(np.diff(some, prepend=some[0] - 1))  # of each id
            rough = np.where(asks[block] @ stands[cols].T > 0, y[block] @ x[cols].T / (y_norms[block, None] * norms[cols]), -np.inf)
            for i, (q, r) in enumerate(zip(asking[block], rough), at):
                r = np.where(some == q, -np.inf, r)
                # all that may reach the k-th largest are scored alike, so that equal vectors tie
                each = np.maximum.reduceat(r, starts) if len(starts) < len(r) else r
                least = np.partition(each, -min(k, len(each)))[-min(k, len(each))]
                best = np.flatnonzero((r >= least - 1e-9) & (r > -np.inf))
                s = (x[cols[best]] * y[i]).sum(axis=1) / (norms[cols[best]] * y_norms[i])
                first = np.argsort(-s, kind="stable")
                first = first[np.sort(np.unique(some[best[first]], return_index=True)[1])[:k]]
                best, s = best[first], s[first]
                out.append((np.full(len(best), q), some[best], s, np.full(len(best), n_read[i]), np.full(len(best), m_read[i])))
        return pa.table(list(map(np.concatenate, zip(*out))), schema=kinds) if out else kinds.empty_table()

    keys = ["cell", "ps", "qs"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double, lists_read int, vectors_read bigint")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("lists_read").alias("lists_read"), F.max("vectors_read").alias("vectors_read"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "lists_read", "vectors_read")
