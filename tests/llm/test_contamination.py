"""Decontamination against windows looked up one by one."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edictum.llm import contamination as c
from edictum.llm.queries import op11_suffix_automaton

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, length=10, coverage=1.0):
    """Words, places hit, items, longest shared run."""
    w, hit, held = words(text), set(), set()
    longest = 0
    for item, body in items:
        b = words(body)
        if not b:
            continue
        n = max(1, min(length, math.ceil(coverage * len(b))))
        runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in runs:
                hit.update(range(i, i + n))
                held.add("" if item is None else str(item))
        for i in range(len(w)):
            for j in range(len(b)):
                k = 0
                while i + k < len(w) and j + k < len(b) and w[i + k] == b[j + k]:
                    k += 1
                longest = max(longest, k)
    return w, hit, held, longest


LETTERS = st.lists(st.sampled_from("ab"), max_size=14).map(" ".join)


@given(st.lists(LETTERS, max_size=5), LETTERS, st.integers(1, 5), st.sampled_from([0.3, 0.5, 1.0]))
@settings(max_examples=500, deadline=None)
def test_automaton(items, text, length, coverage):
    rows = []
    for i, body in enumerate(items):
        b = c.words_of(body.encode())
        if b:
            rows.append((str(i), b, max(1, min(length, math.ceil(coverage * len(b))))))
    spans, held, longest = c.Automaton(rows, length).search(c.words_of(text.encode()))
    w, hit, want, most = brute(text, list(enumerate(items)), length, coverage)
    assert {x for a, b in spans for x in range(a, b)} == hit and held == want
    assert all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))
    if rows:
        assert longest == most or most < min(n for _, _, n in rows)


def table_of(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["Ab", "é", "9", "x1", "Ωmega", "the", "of", "zu", "a\tb", "..."]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(12)]
    items += [(None, "null Item id"), (77, None), (78, ""), (5, items[4][1]), (79, "one-two,three " * 30)]
    docs = []
    for i in range(n):
        parts = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            body = (rnd.choice(items)[1] or "").upper().split(" ")
            parts[rnd.randrange(len(parts) + 1) : 0] = body[rnd.randrange(5) :]
        docs.append((rnd.choice([i, i, 3, None]), " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "!!!"), (903, docs[0][1])] * 2, items


@pytest.mark.parametrize("shard", [c.SHARD, 25])
def test_documents_against_brute_force(spark, shard):
    docs, items = table_of(1)
    found = c.match_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), shard=shard).collect()
    got = sorted((repr(r.doc_id), r.n_words, [x for a, b in zip(r.spans[::2], r.spans[1::2]) for x in range(a, b)], r["items"]) for r in found)
    want = []
    for doc, text in docs:
        w, hit, held, _ = brute(text, items)
        want.append((repr(doc), len(w), sorted(hit), sorted(held)))
    assert got == sorted(want)
    if shard < c.SHARD:
        assert c.build_automata(spark.createDataFrame(items, ITEMS), shard=shard)[1][3:]


def test_query(spark, tmp_path):
    docs, items = table_of(2)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(repr(tuple(r)) for r in op11_suffix_automaton(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    want = []
    for doc, text in docs:
        w, hit, held, _ = brute(text, items)
        want.append(repr((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))))
    assert got == sorted(want)


def test_removal_keeps_other_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Start, {item.upper()}! End.", 7, "s"), (2, "clean text", 8, None), (3, None, 9, "n"), (4, item, 1, "w")]
    got = c.remove_leaks(spark.createDataFrame(docs, DOCS + ", row long, items string"), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert [tuple(r) for r in got] == [(1, "Start, ! End.", 7, "s"), (2, "clean text", 8, None), (3, None, 9, "n"), (4, "", 1, "w")]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([], ITEMS)
    assert [(r.n_words, r.spans, r["items"], r.longest) for r in c.match_documents(docs, items).collect()] == [(3, [], [], 0)]
    assert c.match_documents(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []


def test_long_and_hostile_texts():
    """One word repeated: every place matches, in linear time."""
    a = c.Automaton([("1", [b"a"] * 5000, 10), ("2", [b"a"] * 9, 9)], 10)
    spans, held, longest = a.search([b"a"] * 300_000)
    assert spans == [(0, 300_000)] and held == {"1", "2"} and longest == 5000
