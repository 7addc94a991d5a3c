"""Files written in tasks against exports made one by one."""

import glob
import json
import os

import pytest

from edictum.operators import export, export_sink
from edictum.plans.ir import Action, Rule, Trace, leaf


def some_sets():
    def rule(name, i):
        return Rule(f"{name}-{i}", leaf("BAL", ">" if i else "<=", 5), (Action("set", "band", "BAND", i),), trace=Trace(program=name, paragraph="M"))

    return {name: [rule(name, i) for i in range(2)] for name in ("A", "001", "b/c d=é")}


@pytest.mark.parametrize("kind", export_sink.KINDS)
def test_files_are_the_exports(spark, tmp_path, kind):
    sets = some_sets()
    rows = [(name, i, json.dumps(r.document())) for name, rules in sets.items() for i, r in enumerate(rules)] + [(None, 0, "{}"), ("A", 9, None)]
    manifest = export_sink.write_files(spark.createDataFrame(rows[::-1], "rule_set string, seq int, document string"), str(tmp_path), kind)
    got = {r.rule_set: r for r in export_sink.read_files(spark, str(tmp_path)).collect()}
    want = {"json": export.to_json, "trees": lambda r: json.dumps(export.to_tree_json(r), default=str), "pmml": lambda r: export.to_pmml(r)[0], "dmn": lambda r: export.to_dmn(r)[0]}[kind]
    assert {n: r.content for n, r in got.items()} == {n: want(rules) + "\n" for n, rules in sets.items()} and all(r.whole for r in got.values())
    assert {(r.rule_set, r.rules, r.bytes) for r in manifest.collect()} == {(n, 2, len((want(rules) + "\n").encode())) for n, rules in sets.items()}


def test_lost_and_changed_files_show(spark, tmp_path):
    rows = [(name, i, json.dumps(r.document())) for name, rules in some_sets().items() for i, r in enumerate(rules)]
    export_sink.write_files(spark.createDataFrame(rows, "rule_set string, seq int, document string"), str(tmp_path), "json")
    (one,) = glob.glob(f"{tmp_path}/files/rule_set=A/part-*")
    with open(one, "w") as f:
        f.write("[]\n")
    for crc in glob.glob(f"{tmp_path}/files/rule_set=A/.part-*"):
        os.remove(crc)
    assert {r.rule_set: r.whole for r in export_sink.read_files(spark, str(tmp_path)).collect()} == {"A": False, "001": True, "b/c d=é": True}


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        export_sink.contents(spark.createDataFrame([], "rule_set string, seq int, document string"), "xls")


def test_files_are_found_by_name_and_not_listed(spark, tmp_path):
    """Any name of a set is read back, and what is planned doesn't grow with the sets."""
    names = ["", "__HIVE_DEFAULT_PARTITION__", "a%2Fb", "x^[{y", "."] + [f"S{i}" for i in range(40)]
    doc = json.dumps(some_sets()["A"][0].document())
    export_sink.write_files(spark.createDataFrame([(n, 0, doc) for n in names], "rule_set string, seq int, document string"), str(tmp_path), "json")
    read = export_sink.read_files(spark, str(tmp_path))
    assert {r.rule_set for r in read.collect() if r.whole} == set(names)
    assert not [f for f in read.inputFiles() if "/files/" in f]


def test_an_export_replaces_the_one_before(spark, tmp_path):
    schema, doc = "rule_set string, seq int, document string", json.dumps(some_sets()["A"][0].document())
    for names in (["A", "B"], ["B"]):
        export_sink.write_files(spark.createDataFrame([(n, 0, doc) for n in names], schema), str(tmp_path), "json")
    assert os.listdir(tmp_path / "files") == ["rule_set=B"]
