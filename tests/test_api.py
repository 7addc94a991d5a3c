import json

import pytest

from edictum import cli
from edictum.api import Workbench
from edictum.operators import export_sink
from edictum.operators.store import StoreError
from edictum.queries import LOAN


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    w = Workbench(spark, f"file://{tmp_path_factory.mktemp('wb')}")
    w.upload_program("p1", "ordchk.cbl", {"ordchk.cbl": LOAN})
    seen = []
    assert w.extract_program("p1", job="j1", progress=lambda *a: seen.append(a[0])) == {"new": 4, "unchanged": 0, "new_version": 0}
    assert seen == ["extract", "verify", "save"] and w.store.table("jobs").first()["state"] == "done"
    return w


def test_rules_and_trace(bench):
    assert [r.rule_id for r in bench.rules()] == ["ORDCHK-R001", "ORDCHK-R002", "ORDCHK-R003", "ORDCHK-R004"]
    assert bench.list_rules("band over 5000", page_size=2).count() == 2 and bench.list_rules(user="x", grants=[]).count() == 0
    lines = bench.rule_trace("ORDCHK-R001", 1).collect()
    assert [r["in_rule"] for r in lines] == [False, True, True, False] and "ORD-OPEN AND" in lines[1]["text"]
    with pytest.raises(StoreError):
        bench.rule_trace("NOPE")


def test_only_approved_rules_decide(bench, spark, tmp_path):
    with pytest.raises(StoreError):
        bench.rule_set("p1")
    for r in bench.rules():
        bench.store.review(r.rule_id, "approve", "", "ann")
    one = bench.score_one("p1", {"ord_amt": 900000, "ord_stat": "O", "cust_bal": 0}, {"BAND": "NONE"})
    assert one == {"decision": {"band": "HIGH"}, "fired_rules": ["ORDCHK-R001"]}
    df = spark.createDataFrame([(900000.0, "O", 0.0), (1.0, "F", -5.0)], "amt double, stat string, bal double")
    got = bench.score("p1", df, {"ORD-AMT": "amt", "ORD-STAT": "stat", "CUST-BAL": "bal"}, {"BAND": "NONE"}).collect()
    assert [r["band"] for r in got] == ["HIGH", "LOW"]
    assert set(bench.rule_set_inputs("p1")) == {"ord_amt", "ord_stat", "cust_bal"}
    shares = dict(bench.explain("p1", "band", n=100))
    assert sum(shares.values()) == pytest.approx(1, abs=0.01)
    assert bench.conflicts() == [] and "HIGH" in bench.export("json") and "decisionTable" in bench.export("dmn") and json.loads(bench.export("tree"))
    assert bench.conflicts_table().collect() == []
    files = str(tmp_path / "files")
    assert [r.rules for r in bench.export_files(files, "json").collect()] == [len(bench.rules())]
    (read,) = export_sink.read_files(bench.spark, files).collect()
    assert read.whole and [d["rule_id"] for d in json.loads(read.content)] == [r.rule_id for r in bench.rules()]
    found = bench.write_index(str(tmp_path / "index")).page("band over 5000", 2).collect()
    assert [(r.id, r.score) for r in found] == [(r.rule_id, r.score) for r in bench.list_rules("band over 5000", page_size=2).collect()]


def test_drift_between_uploads(bench):
    bench.upload_program("p2", "ordchk.cbl", {"ordchk.cbl": LOAN.replace("> 5000", "> 6000")})
    kinds = sorted(r["kind"] for r in bench.drift("p1", "p2").collect())
    assert kinds == ["changed"] * 4
    with pytest.raises(StoreError):
        bench.upload_program("p3", "x.cbl", {})


def test_backups_to_delete(bench, spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, created_at int")
    assert [r["path"] for r in bench.newest_backups(df, 2).collect()] == ["a"]


def test_commands(tmp_path, capsys):
    (tmp_path / "ordchk.cbl").write_text(LOAN)
    (tmp_path / "new.cbl").write_text(LOAN.replace("'LOW'", "'LOWX'"))
    assert cli.main(["extract", str(tmp_path / "ordchk.cbl")]) == 0 and len(json.loads(capsys.readouterr().out)) == 4
    for kind in ("json", "tree", "dmn"):
        cli.main(["export", str(tmp_path / "ordchk.cbl"), "--format", kind, "-o", str(tmp_path / kind)])
        assert (tmp_path / kind).read_text()
    cli.main(["diff", str(tmp_path / "ordchk.cbl"), str(tmp_path / "new.cbl")])
    assert capsys.readouterr().out.count("ORDCHK-R003") == 2
