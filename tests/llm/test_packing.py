import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edictum.llm import packing
from edictum.llm.queries import op10_packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOK = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string"


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_deal_places_each_token_once(lengths):
    pieces = packing.deal(lengths, 64)
    by_item, by_seq = defaultdict(list), defaultdict(list)
    for item, start, length, seq, offset in pieces:
        by_item[item].append((start, length))
        by_seq[seq].append((offset, length))
    for parts, ends in ((by_item, dict(enumerate(lengths))), (by_seq, None)):
        for k, own in parts.items():
            at = 0
            for start, length in sorted(own):
                assert start == at and length > 0
                at += length
            assert at == ends[k] if ends else at <= 64
    assert len(by_seq) == -(-sum(lengths) // 64) and set(by_item) == set(range(len(lengths)))


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 700, size=600).tolist()
    load = defaultdict(float)
    for _, _, length, seq, _ in packing.deal(lengths, 2048):
        load[seq] += packing.cost(length)
    assert max(load.values()) < 1.3 * np.median(list(load.values()))


def verify(rows, pieces, capacity):
    ids = {}
    for d, t in rows:
        ids.setdefault(d, [])
        if (own := [*TOK.encode(t or "", add_special_tokens=False).ids, 1]) not in ids[d]:
            ids[d].append(own)
    if any(len(x) > 1 for x in ids.values()):  # several texts of an id: only what sequences hold
        used = defaultdict(list)
        for p in pieces:
            used[p["sequence_id"]].append((p["offset"], p["length"]))
            part = lambda own: np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert any(p["doc_tokens"] == len(own) and zlib.crc32(part(own)) == p["ids_crc32"] for own in ids[p["doc_id"]])
        assert all(sum(n for _, n in own) <= capacity for own in used.values())
        assert sum(p["length"] for p in pieces) == sum(len(TOK.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
        return used
    ids = {d: x[0] for d, x in ids.items()}
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and p["length"] > 0
        part = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        docs[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
    copies = {d: sum(1 for x, _ in rows if x == d) for d in ids}
    assert all(sorted(docs[d]) == sorted(list(range(len(ids[d]))) * copies[d]) for d in ids)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_pieces(spark):
    rows = [(i, f"Doc {i} " + "some words here " * (i % 40)) for i in range(150)] + [(900, None), (901, ""), (902, "very long " * 20_000), (None, "no id"), (903, "twice"), (903, "twice")]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as start", "2 as length").coalesce(2), PATH, 1, capacity=64)
    seqs = verify(rows, out.collect(), 64)
    assert sum(64 - sum(n for _, n in s) for s in seqs.values()) < 64
    full = packing.pack_documents(spark.createDataFrame(rows[:20], SCHEMA), PATH, 1, capacity=64, with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in full)


def test_windows_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 64)
    rows = [(i, "words " * (i % 9)) for i in range(1500)] + [(9_999, "the same row")] * 700 + [(None, f"no id {i}") for i in range(400)]
    verify(rows, packing.pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH, 1, capacity=128).collect(), 128)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH, 1).count() == 0


def test_the_result_depends_on_the_rows_only(spark):
    """64 partitions of one row each give the pieces of one partition, with as little padding."""
    rows = [(i, f"Doc {i} " + "some words here " * (100 + 7 * i % 90)) for i in range(60)] + [(5, "see <|endoftext|> here"), (5, "again"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (sorted(map(tuple, packing.pack_documents(df.repartition(n), PATH, 1).collect()), key=repr) for n in (1, 64))
    assert one == many
    used, sequences = sum(p[2] for p in one), len({p[5] for p in one})
    assert used / (2048 * sequences) > 0.9 and (sequences - 1) * 2048 < used


def test_wide_ids():
    for ids in ([], [0], [65_535], [65_536, 1]):
        data = np.array(ids, "<u4").tobytes()
        assert packing._wide(packing._narrow(data)) == data


def test_the_query_on_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seqs = verify(rows, op10_packing(spark, "/root/testdata/sf0.001").collect(), 2048)
    used = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) * 2048 - used < 2048
