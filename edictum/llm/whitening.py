"""Embedding whitening by block subspace iteration that never forms the covariance.

Entries become whole numbers, so sums and deviations are exact; rows are centred on exact means before
anything is multiplied. Each pass over the table computes X'(XQ) for a block Q of directions,
summed by Spark from a partial block a task. The driver holds blocks of d rows alone: it adds the pass to
a basis, orthonormal by QR, and takes Ritz pairs from it (Rayleigh-Ritz). The next block is what the
pairs still lack, their residuals, so the basis grows as in a block Krylov method; at a bound it is
cut back to the best Ritz vectors. A last pass over the found components alone has to certify all
of them by their true residuals, and gives the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.shipping import ship_package

SCALE, SHIFT = 64, 1_000_000
#: Larger entries have no whole number of 64 bits.
LARGEST = 2.0**56
#: Directions beside those asked for; the basis is cut back when it has WIDTH times as many columns as that.
SPARE, WIDTH = 16, 4
#: A residual certifies its component if it is below this share of the largest eigenvalue, times 32 plus the vectors' length (rounding).
ROUNDING = 8 * np.finfo(np.float64).eps
#: Eigenvalues below this share of the largest are zero as far as doubles tell.
RANK = 1e-11
MOST_PASSES = 400
#: Columns of a partial sum's row.
_COLUMNS = 64


@dataclass
class Whitening:
    """What fit() found. ``components`` has a column for each, ``values`` its eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _finite(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    return vectors.filter(v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False))))


def usable(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """Rows whose vector takes part, with their number and length: the most frequent length, the greater of two."""
    kept, v = _finite(vectors, vector), F.col(vector)
    usual = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return kept, 0, 0
    return kept.filter(F.size(v) == usual["d"]), usual["count"], usual["d"]


def _numbers(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    """Whole numbers of a batch's vectors, a row each."""
    entries = batch.column(at).flatten().to_numpy(zero_copy_only=False)
    return np.floor(entries * SCALE).astype(np.int64).reshape(-1, d) + SHIFT


def _away(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distances from the whole part of each mean, and what of n times the mean is left (from 0 to n)."""
    whole = [s // n for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, whole)], dtype=np.int64)
    return x - np.array(whole, dtype=np.int64), rest


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles, each to its last digit."""
    far, rest = _away(x, n, sums)
    return far - rest / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum of (n*x - S)^2 of each row, exactly."""
    far, rest = _away(x, n, sums)
    if not x.size:
        return [0] * len(x)
    if max(abs(int(far.max())), abs(int(far.min()))) * n >= 1 << 46:
        return [int(s) for s in ((far.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)]
    y = far * n - rest
    high, low = y >> 24, y & 0xFFFFFF
    parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in zip(*parts)]


def _sum_over(rows: DataFrame, give: Callable[[pa.RecordBatch], np.ndarray], height: int) -> np.ndarray:
    """The sum of a block of doubles over all batches, of ``height`` rows; a task sends its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = give(batch)
                total = block if total is None else total + block
        if total is None:
            return
        for at in range(0, total.shape[1], _COLUMNS):
            part = total[:, at : at + _COLUMNS]
            part = np.pad(part, ((0, 0), (0, _COLUMNS - part.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array([at] * height, pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], names=["i", "at", "v"])

    ship_package(rows.sparkSession)
    parts = rows.mapInArrow(run, "i int, at int, v array<double>").groupBy("i", "at").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(_COLUMNS)))
    found = parts.collect()  # height rows for each block of columns, whatever the size of the table
    out = np.zeros((height, max(r["at"] for r in found) + _COLUMNS))
    for r in found:
        out[r["i"], r["at"] : r["at"] + _COLUMNS] = r[2:]
    return out


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums of the whole numbers, a dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = _numbers(batch, 0, d)
            if len(x):
                small = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 62
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    ship_package(rows.sparkSession)
    found = rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(s) for _, s in sorted((r["i"], r["s"]) for r in found)]


def _against(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What of a block the basis lacks, orthonormal; columns that it has are left out."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    fresh = q[:, np.abs(np.diag(r)) > 1e-12]
    fresh = fresh - basis @ (basis.T @ fresh)
    return np.linalg.qr(fresh)[0] if fresh.shape[1] else fresh


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and coordinates of the Ritz pairs of a basis."""
    small = basis.T @ image
    values, ways = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], ways[:, ::-1]


def _certified(values: np.ndarray, vectors: np.ndarray, image: np.ndarray, top: float) -> np.ndarray:
    """Which Ritz pairs are eigenpairs as far as doubles tell."""
    rest = np.linalg.norm(image - vectors * values, axis=0)
    return rest <= ROUNDING * (32 + len(vectors)) * top


def fit(vectors: DataFrame, k: int = 32, vector: str = "embedding", seed: int = 0) -> Whitening:
    """Means and the first ``k`` components of all usable vectors, by as many passes as it takes.

    There are fewer components if vectors have fewer entries, or vary in fewer directions: directions without
    variance can't be whitened. Raises RuntimeError rather than return components that no pass certified.
    """
    rows, n, d = usable(vectors, vector)
    if not n or not d:
        return Whitening(n, [0] * d, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    rows = rows.select(F.col(vector).cast("array<double>"))
    sums = _sums(rows, d)
    passes = 1

    def times(block: np.ndarray) -> np.ndarray:
        def give(batch: pa.RecordBatch) -> np.ndarray:
            x = centred(_numbers(batch, 0, d), n, sums)
            return x.T @ (x @ block)

        return _sum_over(rows, give, d)[:, : block.shape[1]] / n

    def last(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        m = block.shape[1]

        def give(batch: pa.RecordBatch) -> np.ndarray:
            x = centred(_numbers(batch, 0, d), n, sums)
            y = x @ block
            return np.vstack([x.T @ y, y.T @ y, np.full((1, m), (x * x).sum() / m)])

        out = _sum_over(rows, give, d + m + 1)[:, :m] / n
        return out[:d], out[d : d + m], float(out[d + m].sum())

    p = min(d, k + SPARE)
    fresh = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, p)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    while passes < MOST_PASSES:
        image = np.hstack([image, times(fresh)])
        basis = np.hstack([basis, fresh])
        passes += 1
        values, ways = _ritz(basis, image)
        top = max(values[0], 0.0)
        if top == 0:
            return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, passes)
        found, moved = basis @ ways, image @ ways
        wanted = slice(0, min(k, d))
        good = _certified(values[wanted], found[:, wanted], moved[:, wanted], top)
        if good.all() or basis.shape[1] == d:
            m = int((values[wanted] > RANK * top).sum())
            block = np.linalg.qr(found[:, :m])[0]
            moved_block, spread, trace = last(block)
            passes += 1
            values, ways = _ritz(block, moved_block)
            block, moved_block, spread = block @ ways, moved_block @ ways, ways.T @ spread @ ways
            if _certified(values, block, moved_block, values[0]).all():
                block = block * np.where(np.take_along_axis(block, np.abs(block).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
                root = np.sqrt(values)
                error = np.abs(spread / np.outer(root, root) - np.eye(m)).max()
                return Whitening(n, sums, block, values, trace, float(error), passes)
            basis, image, values, ways = block, moved_block, values, np.eye(m)
            found, moved, good = block, moved_block, np.zeros(m, dtype=bool)
        elif basis.shape[1] + p > max(WIDTH * p, p + 1):
            basis, image = np.linalg.qr(found[:, :p])[0], None
            image = moved[:, :p] @ np.linalg.inv(basis.T @ found[:, :p])
        lacking = (moved - found * values)[:, : len(good)][:, ~good]
        fresh = _against(np.hstack([lacking, np.random.default_rng(seed + passes).standard_normal((d, 1))]), basis)[:, : d - basis.shape[1]]
        if not fresh.shape[1]:
            raise RuntimeError("the basis is complete and its components are not certified")
    raise RuntimeError(f"components are not certified after {passes} passes")


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, deviation (decimal) and whitened (array of doubles, an entry a component) of each usable row.

    Rows of null vectors, and of vectors with null, non-finite or over-large entries (beyond 2^56), or of another length than the
    most frequent one, are left out. Other columns are left out; null and repeated keys stay.
    """
    d = len(model.sums)
    rows = _finite(vectors, vector).filter(F.size(vector) == d)
    n, sums, way = model.n, model.sums, model.components / np.sqrt(model.values)
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch, 1, d)
            far = [Decimal(s) for s in deviations(x, n, sums)]
            out = centred(x, n, sums) @ way
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), pa.array(list(out), kind)], names=["key", "deviation", "whitened"])

    rows = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    ship_package(rows.sparkSession)
    if not n or not len(model.values):
        return rows.select(F.col("key").alias(key), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", key)


def by_component(whitened: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """A row for each row and component, with the model's figures. Deviations beyond 64 bits are null."""
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values)).cast("array<double>")
    rows = whitened.select(key, F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
