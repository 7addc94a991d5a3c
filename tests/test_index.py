"""An inverted index against search over all rules."""

import json
import random

import pytest

from edictum.operators import index, search
from edictum.plans.ir import Action, Rule, leaf


def some_rules(n):
    rnd = random.Random(5)
    words = ["fee", "fees", "late", "age", "loan", "rates", "gas", "zone"]
    out = []
    for i in range(n):
        c = {"any": [leaf(rnd.choice(["AGE", "AMT"]), rnd.choice(["<", ">=", "=="]), rnd.choice([18, 65, 1000])), leaf("KIND", "in", [rnd.choice("ab"), "c"])]}
        title, intent = (" ".join(rnd.choices(words, k=rnd.randrange(3))) for _ in range(2))
        out.append(Rule(f"R{i:03d}", c, (Action("set", "flag", "FLAG", "Y"),), title=title, intent=intent, concepts=tuple(rnd.choices(words, k=rnd.randrange(2)))))
    return out


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    rules = some_rules(120)
    docs = spark.createDataFrame([(r.rule_id, json.dumps(r.document())) for r in rules] + [("null", None)], "rule_id string, document string")
    rows = search.rule_rows(docs)
    path = str(tmp_path_factory.mktemp("index"))
    held = index.Index.write(rows.filter("rule_id < 'R100'"), path)
    held.add(rows.filter("rule_id >= 'R100'"))
    return rules, rows, held


def test_rows_are_those_of_objects(spark, asked):
    rules, rows, _ = asked
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, search.rules_table(spark, rules).collect()))


@pytest.mark.parametrize("question", ["late fees under 18", "customers over 65", "gas", "zones and fees at least 1000, less than 18", "nothing known", "under 7", "show all rules"])
def test_scores_are_those_of_a_scan(spark, asked, question):
    rules, rows, held = asked
    terms, numbers = search.read_question(question)
    want = {r.rule_id: r.score for r in search.search(rows, question).collect()} if terms or numbers else {}
    assert {r.id: r.score for r in held.scores(question).collect()} == want


def test_pages_go_through_all(asked):
    _, rows, held = asked
    want = [(r.rule_id, r.score) for r in search.search(rows, "late fees under 18").collect()]
    got, after = [], None
    while page := held.page("late fees under 18", 7, after).collect():
        got += [(r.id, r.score) for r in page]
        after = (page[-1].score, page[-1].id)
    assert got == want and len(got) > 20


def test_nothing_indexed(spark, tmp_path):
    none = spark.createDataFrame([], search.ROWS)
    assert index.Index.write(none, str(tmp_path)).page("fees under 5", 3).collect() == []


def test_a_word_of_all_rows_is_no_task_of_its_own(spark, tmp_path, monkeypatch):
    """Postings are made without a shuffle and dealt out by word and row; a word counts by its best place, once."""
    monkeypatch.setattr(index, "FOLDERS", 2)
    rows = spark.createDataFrame([(f"R{i}", "fee", ["fees"], "fee late fees", [("==", [1.0, 1.0]), ("==", [1.0])]) for i in range(200)], search.ROWS)
    made = index.postings(rows)
    assert sorted(map(tuple, made.filter("id = 'R7'").collect())) == [("fee", "R7", 3), ("late", "R7", 1)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert index.numbers(rows).count() == 200
    held = index.Index.write(rows, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index.Index.write(rows, str(tmp_path / "plain"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    said = spark.read.parquet(str(tmp_path / "plain" / "postings")).filter("stem = 'fee'").selectExpr("input_file_name() as f").distinct().count()
    assert said > 1 and held.page("fees", 3).count() == 3
