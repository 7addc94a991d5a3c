import random

import numpy as np

from edictum.llm import jaccard

SCHEMA = "doc_id long, text string"


def slow_set(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def survivors(rows):
    """The least (doc_id, text) of each class of pairs with a similarity of at least 0.8, by loops."""
    sets = [slow_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for x, row in zip(label, rows):
        best[x] = min(best.get(x, row), row)
    return sorted(best.values())


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def changed(words, seed, n):
    r, out = random.Random(seed), list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10_000)}"
    return " ".join(out)


def test_classes_match_brute_force_jaccard(spark):
    rows = [(i, " ".join(prose(i, 120))) for i in range(60)]
    rows += [(100 + i, changed(prose(i, 120), 1000 + i, i % 7)) for i in range(60)]  # similarities from 0.6 to 1
    base = prose(7_000, 300)
    rows += [(300 + i, changed(base, i, 3 + i % 4)) for i in range(40)]  # one large class, partly by chains
    rows += [(400, ""), (401, " \t"), (402, "one two"), (403, "ONE  two"), (404, "one three"), (405, "a b c d e")]
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == survivors(rows) and len(got) < len(rows) - 40


def test_all_pairs_are_checked_when_pivots_link_nothing(spark):
    """Groups at similarities just under 0.8 share buckets; one pair in them is linked."""
    base = prose(9, 400)
    rows = [(i, changed(base, i, 14)) for i in range(30)]
    rows += [(50, changed(rows[17][1].split(), 1, 2))]
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == survivors(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Members of a bucket meet whichever blocks they are dealt to, in the largest class or outside it."""
    monkeypatch.setattr(jaccard, "BLOCK", 1_000)
    monkeypatch.setattr(jaccard, "TURNS", 0)
    base = prose(21, 200)
    rows = [(i, changed(base, i, 2 + i % 14)) for i in range(120)]
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == survivors(rows) and 10 < len(got) < 110


def test_close_sets():
    rng = np.random.default_rng(4)
    base = rng.choice(100_000, 6_000, replace=False)
    sets = [np.unique(np.concatenate([base[: rng.integers(3_000, 6_000)], rng.integers(100_000, 200_000, rng.integers(0, 900))])) for _ in range(30)] + [np.array([], dtype=np.int64)]
    want = [[a is b or 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert (jaccard.close_sets(sets) == np.array(want)).all()


def test_pairs_at_the_threshold_share_a_bucket():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))
        assert set(jaccard.bands_of(s[:90])) & set(jaccard.bands_of(s[10:]))  # 80 common of 100


def test_no_documents(spark):
    assert jaccard.keep_one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []
