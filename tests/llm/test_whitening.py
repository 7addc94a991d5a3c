"""Whitening against a dense eigendecomposition of exact sums."""

import math

import numpy as np
import pytest

from edictum.llm import whitening as w
from edictum.llm.queries import op12_subspace_whitening

SCHEMA = "vec_id long, embedding array<double>"


def whole(vec):
    return [math.floor(64 * c) + 1_000_000 for c in vec]


def brute(rows, k=32):
    """Deviations of the rows that take part, eigenvalues, eigenvectors, centred rows, trace."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [whole(v) for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    far = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], far, values[::-1][:k], vectors[:, ::-1][:, :k], centred, values.sum()


def check(out, rows, k=32, close=1e-7):
    """Projections agree but for their sign, and all figures."""
    ids, far, values, vectors, centred, trace = brute(rows, k)
    m = int((values > 1e-9 * values[0]).sum())
    want = centred @ vectors[:, :m] / np.sqrt(values[:m])
    assert len(out) == len(ids) * m
    got = {(r.vec_id, r.component): r for r in out}
    for j in range(m):
        mine = np.array([got[i, j + 1].whitened for i in ids])
        sign = np.sign(mine @ want[:, j])
        assert np.abs(mine - sign * want[:, j]).max() < close
        assert all(abs(got[i, j + 1].explained - values[j] / trace) < 1e-9 for i in ids)
    assert all(got[i, 1].deviation == d and got[i, 1].n == len(ids) for i, d in zip(ids, far))
    errors = {r.identity_error for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-8


def some(n, d, seed, decay=1.0):
    rnd = np.random.default_rng(seed)
    return [(i, [float(c) for c in v]) for i, v in enumerate(rnd.standard_normal((n, d)) * decay ** np.arange(d) @ np.linalg.qr(rnd.standard_normal((d, d)))[0])]


def test_query_with_odd_rows(spark, tmp_path):
    rows = some(300, 40, 1) + [(1000, None), (1001, [None] + [0.0] * 39), (1002, [float("nan")] + [0.0] * 39), (1003, [float("-inf")] * 40), (1004, [-0.3] * 40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(op12_subspace_whitening(spark, str(tmp_path)).collect(), rows)


@pytest.mark.parametrize("d, decay", [(3, 1.0), (200, 0.97), (300, 1.0)])
def test_sizes_and_spectra(spark, d, decay):
    """Fewer entries than components; a basis that grows; a flat spectrum in which the basis is cut back."""
    rows = [(i, [20 * c for c in v]) for i, v in some(900, d, d, decay)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = w.fit(df, k=8)
    check(w.by_component(w.whiten(df, model), model).collect(), rows, 8, 1e-6)
    assert d < 200 or 3 < model.passes < w.MOST_PASSES


def test_a_third_are_copies_and_keys_repeat(spark):
    rows = some(60, 6, 4)
    rows = [(i, v) for i, v in rows] + [(7, rows[7][1])] * 30
    model = w.fit(spark.createDataFrame(rows, SCHEMA))
    ids, far, values, *_ = brute(rows)
    out = w.whiten(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted((r.vec_id, int(r.deviation)) for r in out) == sorted(zip(ids, far)) and np.allclose(model.values, values)


def test_directions_without_variance(spark):
    """Equal vectors have no component; a line has one."""
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    model = w.fit(same)
    assert model.n == 5 and len(model.values) == 0 and w.by_component(w.whiten(same, model), model).count() == 0
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = w.fit(df)
    check(w.by_component(w.whiten(df, model), model).collect(), rows)
    assert len(model.values) == 1


def test_empty_table_and_large_entries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = w.fit(empty)
    assert model.n == 0 and w.by_component(w.whiten(empty, model), model).collect() == []
    rows = [(1, [1e300, 1.0]), (2, [2.0**55, 1.0]), (None, [-(2.0**55), 3.0]), (4, [0.0, -5.0]), (5, [7.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", whitened string")
    model = w.fit(df)
    ids, far, *_ = brute(rows[1:4])
    got = {r.vec_id: int(r.deviation) for r in w.whiten(df, model).collect()}
    assert got == dict(zip(ids, far)) and model.n == 3


def test_exact_deviations():
    x = np.array([[3, 10**6], [5, 10**6 + 7], [2**40, 4]], dtype=np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert w.deviations(x, 3, sums) == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert w.deviations(x[:2], 2, [8, 2 * 10**6 + 7]) == [(6 - 8) ** 2 + 49, 4 + 49]
