import numpy as np
from edictum.llm.posting_lists import Settings, fit, nearest

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in fine:
        if q % every == 0:
            scores = sorted((-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in fine if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(found, want):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found, want = got(nearest(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    assert set(found) == set(want) and recall(found, want) >= 0.9
    exact = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q, f in found.items() for i, s in f if i in exact[q])
    assert all([s for _, s in f] == sorted((s for _, s in f), reverse=True) and len(f) == 5 for f in found.values())


def clustered(n, width=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(8, n // 40), width))
    return [(i, v) for i, v in enumerate((centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, width))).tolist())]


def test_what_a_query_reads_falls_with_the_table(spark):
    """Recall holds while the share of the table that is read falls."""
    shares = []
    for n in (2_000, 16_000):
        rows = clustered(n)
        out = nearest(spark.createDataFrame(rows, SCHEMA), every=200).cache()
        assert recall(got(out), brute(rows, every=200)) >= 0.95
        reads = {r["query_id"]: (r["lists_read"], r["vectors_read"]) for r in out.collect()}
        shares.append(np.mean([m for _, m in reads.values()]) / n)
        assert min(k for k, _ in reads.values()) >= Settings().fewest
        out.unpersist()
    assert shares[1] < 0.6 * shares[0]


def test_exact_mode(spark):
    rows = clustered(1_500) + [(2_000 + i, [0.5] * 24) for i in range(12)]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), settings=Settings(ratio=None, copies=1, shard=200)))
    want = brute(rows)
    assert {q: [i for i, _ in f] for q, f in found.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_search_goes_on_until_the_ratio_is_met():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = fit(x, 40_000, Settings())
    assert len(index.centroids) > 200
    missed = total = 0
    for q in x[:60]:
        at, d = index.search(q, 1.5, 32)
        every = np.sqrt(np.maximum(0, 2 - 2 * index.centroids @ q))
        within = set(np.flatnonzero(every <= 1.5 * every.min()).tolist())
        missed += len(within - set(at.tolist()))
        total += len(within)
        assert np.allclose(d, every[at])
    assert missed <= 0.02 * total


def test_the_query_on_a_table(spark):
    """The query against brute force over the whole table."""
    from edictum.llm.queries import op3_posting_lists

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found, want = got(op3_posting_lists(spark, "/root/testdata/sf0.01")), brute(rows)
    assert set(found) == set(want) and recall(found, want) >= 0.9 and all(len(f) == 5 for f in found.values())


def test_clusters_with_a_hot_list_and_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(i, (centres[0 if i % 3 == 0 else i % 8] + rng.normal(size=16)).tolist()) for i in range(1500)]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), settings=Settings(sample=600, lists=0.3, per_list=20, shard=64)))
    assert recall(found, brute(rows)) >= 0.9


def test_ties_copies_and_what_takes_no_part(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(0, 130)] + [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, float("nan"), 1.0]), (350, [float("inf"), 1.0, 1.0]), (400, [1.0, None, 2.0]), (None, one), (450, [])]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as list", "2 as v")))
    assert {q: [i for i, _ in f] for q, f in found.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert {q: [i for i, _ in f] for q, f in got(nearest(spark.createDataFrame(rows, SCHEMA))).items()} == {0: [2, 1]}
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0


def test_a_query_at_a_centroid_is_refilled(spark):
    rows = [(i, np.eye(12)[i].tolist()) for i in range(12)]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), every=2, settings=Settings(per_list=1)))
    assert sorted(found) == [0, 2, 4, 6, 8, 10] and all(len(f) == 5 for f in found.values())


def test_a_third_copies_of_one_vector(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 24))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), settings=Settings(sample=2000, per_list=10)))
    assert all(len(f) == 5 for f in found.values()) and recall(found, brute(rows)) >= 0.9


def test_a_repeated_id_takes_one_rank(spark):
    rows = [(1, [1.0, 0.1])] * 400 + [(i, [1.0, i / 10]) for i in (0, *range(2, 60))]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), settings=Settings(per_list=16)))
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
