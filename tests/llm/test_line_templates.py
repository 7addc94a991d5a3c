import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edictum.llm.line_templates import DEPTH, FIELD, FIFTH, dedup_lines

SCHEMA = "doc_id long, text string"


def templates(words):
    """The templates of a line: itself, and itself with one run of a fifth of its tokens left open."""
    says = lambda ws: any(w not in (FIELD, "") for w in ws)
    if says(words):
        yield words
    n = len(words)
    if n >= FIFTH and says(words[:DEPTH]):
        for at in range(DEPTH, n, n // FIFTH):
            yield words[:at] + (None,) * len(words[at : at + n // FIFTH]) + words[at + n // FIFTH :]


def brute(docs):
    """Kept text of each (doc_id, text), by loops."""
    places = defaultdict(list)
    for doc, text in {(d, t) for d, t in docs if d is not None and t is not None}:
        for no, line in enumerate(text.split("\n")):
            words = tuple(FIELD if re.search("[0-9]", w) else w for w in re.sub("[ \t\x0b\f\r]+", " ", line).strip(" ").split(" "))
            for t in templates(words):
                places[t].append((doc, no, text))
    gone = {(d, t, no) for own in places.values() if len({x[0] for x in own}) > 1 for d, no, t in own if (d, no) != min(own)[:2]}
    return {(d, t): (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone)) for d, t in docs}


CASES = {
    "exact": [(1, "one two three four five\nown line of the first doc"), (2, "own line of another doc\none two three four five")],
    "digits": [(1, "Posted by user on 12 May 2021"), (2, "Posted by user on 3 May 1999"), (3, "Posted by user on day May 1999 again")],
    "field": [(i, f"the quick brown fox jumps over {w} lazy dogs today") for i, w in enumerate(["some", "many", "few", "few", "no"])],
    "inside one document": [(1, "same line stands twice here\nsame line stands twice here"), (2, "nothing else in this one")],
    "short": [(1, "all rights reserved\nRead more\n}"), (2, "all rights reserved\nown\n}"), (3, "Page 3\nRead more"), (4, "Page 12")],
    "numbers and blanks": [(i, f"{i} {i + 1} {i + 2} {i + 3} {i + 4}\n\n2020\n \n{i} {i} {i} {i} total {i}") for i in range(3)],
    "two templates in a leaf": [(i, f"{a}\n{b}") for i, (a, b) in enumerate([("we are open on {} from nine to five".format(d), "we are open on monday for {} and {} only".format(d, d)) for d in ["mo", "tu", "we", "th"]])],
    "open runs": [(i, " ".join(["lead one two three"] + ["same"] * i + ["x" + "abcdefgh"[i]] + ["same"] * (8 - i))) for i in range(8)],
    "prose apart": [(1, "it was the best of times and the worst"), (2, "it was the age of wisdom and of folly too")],
    "copies": [(i, "first line of the copy\nsecond line of the copy\n\nlast 1 2 3 line") for i in range(6)],
    "ties": [(1, "a b c d x y y y y y"), (2, "a b c d y x y y y y"), (3, "a b c d y y x y y y")],
    "white space": [(1, "  tabs\tand  blanks in line \r"), (2, "tabs and blanks in line")],
    "repeated rows": [(1, "line of a repeated row here"), (1, "line of a repeated row here"), (2, "line of a repeated row here")],
    "one id, two texts": [(1, "line of a shared id here"), (1, "more\nline of a shared id here"), (0, "line of a shared id here")],
    "nulls": [(1, None), (None, "line without an id is kept"), (2, "line without an id is kept"), (3, ""), (4, "line without an id is kept")],
    "long": [(1, "word " * 30000 + "end"), (2, "x\n" + "word " * 30000 + "end")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_brute_force(spark, name):
    docs = CASES[name]
    got = dedup_lines(spark.createDataFrame(docs, SCHEMA).withColumn("before", F.col("text"))).collect()
    want = brute(docs)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((d or -1, want[d, t] or "") for d, t in docs)
    for r in got:
        n = 0 if r["before"] is None else r["before"].count("\n") + 1
        assert r["n_lines"] == n and (r["text"] is None) == (r["before"] is None)


def test_first_place_is_kept_and_columns_stay(spark):
    docs = spark.createDataFrame([(2, "a recurring line of text", "x", 7), (1, "a recurring line of text", "y", 8)], "doc_id long, text string, doc string, n_lines int")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "doc", "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["doc"], r["n_dropped"]) for r in out.collect()} == {1: ("a recurring line of text", "y", 0), 2: ("", "x", 1)}


def test_very_many_lines_in_one_document(spark):
    """Time grows with the lines, not with lines times what is dropped."""
    text = "\n".join(f"line of words {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} {chr(97 + i // 100 % 26)}{chr(97 + i // 2600 % 26)}{chr(97 + i // 67600)}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text)], SCHEMA)
    dedup_lines(docs.limit(0)).collect()
    start = time.perf_counter()
    got = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(docs).collect()}
    assert got[2] == 200_000 and time.perf_counter() - start < 60


def test_a_line_that_holds_most_of_the_table(spark):
    """Heavy keys are met without a shuffle, with the same result."""
    docs = [(i, f"the very same line in all of these\nthe very same line in each of {'abcdefghij'[i % 10]} these\nown {chr(97 + i % 26)}{chr(97 + i // 26)} words of this document alone") for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect()}
    assert got == {d: t for (d, _), t in brute(docs).items()}


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame(CASES["field"], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
