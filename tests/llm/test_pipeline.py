from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import kept_lines, survivors

from edictum.llm import mixing, queries, rule_ensemble
from edictum.llm.workspace import materialize, table

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_predecessor(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], SF), name))
    rows = [[r.asDict() for r in f.collect()] for f in frames]
    assert all(f.columns == columns for f in frames[:-1])

    model = rule_ensemble.train(docs, table(spark, SF, "labels"))
    import pyarrow as pa

    score = model.score(rule_ensemble.feature_matrix(rule_ensemble.raw_statistics(pa.array([r["text"] for r in rows[0]]))))
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r, s in zip(rows[0], score) if s >= queries.QUALITY}
    good = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    assert len({r["doc_id"] for r in rows[1]} & good) >= 0.97 * len(good)

    want = kept_lines([(r["doc_id"], r["text"]) for r in rows[1]])
    assert {r["doc_id"]: r["text"] for r in rows[2]} == {d: t for (d, _), t in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])

    assert sorted((r["doc_id"], r["text"]) for r in rows[3]) == survivors([(r["doc_id"], r["text"]) for r in rows[2]])

    sized, plan = mixing.mix(frames[3])
    planned = {r["source"]: r for r in plan.collect()}
    want = Counter({r["doc_id"]: planned[r["source"]]["whole"] + int(planned[r["source"]]["cut"] is not None and r["key"] <= planned[r["source"]]["cut"]) for r in sized.collect() if r["size"]})
    assert Counter(r["doc_id"] for r in rows[4]) == +want

    tokens = Counter()
    for p in rows[5]:
        tokens[p["doc_id"]] += p["length"]
    per_doc = {p["doc_id"]: p["doc_tokens"] for p in rows[5]}
    assert {d: n // per_doc[d] for d, n in tokens.items()} == dict(Counter(r["doc_id"] for r in rows[4]))
    loads = Counter()
    for p in rows[5]:
        loads[p["sequence_id"]] += p["length"]
    assert max(loads.values()) <= 2048 and np.mean(list(loads.values())) > 2000


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "pack"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, doc string, th long, class string, size int, __key int"
PROSE = "A clean paragraph of several ordinary words about number {0}, which goes on for a while, and then ends. It has a second sentence too."
ODD = [
    (1, PROSE.format("one"), "en", "a", 1, "x", 1, "y", 1, 1), (1, PROSE.format("one"), "en", "a", 1, "x", 1, "y", 1, 1), (1, PROSE.format("two") + " Another text of the same id.", "en", "a", 1, "x", 1, "y", 1, 1),
    (None, PROSE.format("none"), None, None, None, None, None, None, None, None), (None, PROSE.format("none"), None, None, None, None, None, None, None, None),
    (2, None, "en", "b", None, "x", 1, "y", 1, 1), (3, "", "en", "b", 0, "x", 1, "y", 1, 1), (4, "A very long text. " * 30_000, "de", None, 1, "x", 1, "y", 1, 1), (5, PROSE.format("one"), "en", "a", 1, "x", 1, "y", 1, 1),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_each_stage(spark, name):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = materialize(spark.createDataFrame(ODD, COLUMNS), "odd")
    out = materialize(stage(spark, docs, SF), name)
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == out.columns
    got = [r.asDict() for r in out.collect()]
    if name != "pack":
        assert out.columns == docs.columns
    if name == "line_dedup":
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD) and sum(r["text"] is None for r in got) == 1
    if name == "near_duplicates":
        # copies of 1 and 5 are one class, as are the empty ones; its other text, the long one and those without an id stay
        assert Counter(r["doc_id"] for r in got) == Counter({1: 2, None: 2, 2: 1, 4: 1})
    if name == "mix":
        assert all(r["text"] for r in got) and max(Counter((r["doc_id"], r["text"]) for r in got).values()) <= 4
    if name == "pack":
        assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(r[0] for r in ODD)


HELPERS = ["own", "__key", "__doc", "__th", "__lines", "__gone", "__stats", "__score", "__whole", "__more", "__copy", "__source", "stats", "score", "class", "n", "n_lines", "n_dropped"]


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_duplicates", "mix"])
def test_columns_of_any_name_keep_their_values(spark, name):
    """Names that operators use for their own columns, and one with a dot."""
    names = [*HELPERS, "a.b"]
    docs = table(spark, SF, "documents").select("*", *((F.col("doc_id") * 100 + j).alias(c) for j, c in enumerate(names)))
    out = dict(corpus_pipeline.STAGES)[name](spark, materialize(docs, "named"), SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(100 * r["doc_id"] + j for j in range(len(names))) for r in got)
