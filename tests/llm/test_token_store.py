import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edictum.llm import simple8b, token_store, vocabulary
from edictum.llm.workspace import fresh_path

PATHS = [str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
SCHEMA = "doc_id long, text string"


LIBRARY = {p: Tokenizer.from_file(p) for p in PATHS}
ODD = st.lists(st.sampled_from(list("ab Z'.!9\n\t\r\x1c\x85\u00a0\u2003\u3000é́Σσ世界🙂") + ["<|endoftext|>", "don't", "  "]), max_size=40).map("".join)


@pytest.mark.parametrize("path", PATHS)
@given(texts=st.lists(st.one_of(ODD, st.text(max_size=30), st.none()), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_gives_what_the_library_gives(path, texts):
    import pyarrow as pa

    got = list(vocabulary.encoder(path).encode_column(pa.array(texts, pa.string())))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY[path].encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_on_slices_blocks_and_full_caches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vocabulary, "KEPT", 20)
    monkeypatch.setattr(vocabulary, "BLOCK", 64)
    e = vocabulary.Encoder(PATHS[0])
    texts = [f"word{i % 13} and some{i} more\n\n text {'x' * (i % 90)}" for i in range(120)]
    got = [*e.encode_column(pa.array(texts).slice(10, 100)), *e.encode_column(pa.array(texts).slice(10, 100))]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == 2 * [LIBRARY[PATHS[0]].encode(t, add_special_tokens=False).ids for t in texts[10:110]]


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.sampled_from([0, 2**60 - 1, 2**60, 2**64 - 1])), max_size=700))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(ids):
    words, per_block, escapes = simple8b.encode(np.array(ids, dtype=np.uint64))
    assert per_block.sum() == len(words) and len(per_block) == -(-len(ids) // simple8b.BLOCK)
    assert simple8b.decode(words, per_block, len(ids), escapes).tolist() == ids


def test_small_ids_are_packed():
    assert len(simple8b.encode(np.ones(256, dtype=np.uint64))[0]) == 5 and len(simple8b.encode(np.full(256, 40_000, dtype=np.uint64))[0]) == 86


def expected(rows, path, end):
    import xxhash

    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1]) - (h(r[1]) >> 63 << 64)))
    out, at = [], 0
    for d, t in rows:
        ids = [*LIBRARY[path].encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("path", PATHS)
def test_shards_read_back(spark, path):
    rows = [(i * 7 % 101, f"Document number {i} has its own words, like w{i * i}.") for i in range(101)] + [(500, None), (501, ""), (502, "long word " * 40_000), (None, "no id"), (503, "same"), (503, "same"), (504, "see <|endoftext|> here"), *((600, f"text {i % 3}") for i in range(90))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as start", "'x' as ids").repartition(5)
    where = fresh_path(spark, "tokens")
    shards = token_store.write_tokens(docs, where, path, 0)
    want = expected(rows, path, 0)
    digests = token_store.read_tokens(spark, shards, digests_only=True).collect()
    assert sorted(map(tuple, digests), key=lambda r: r[1]) == [w[:4] for w in want]
    full = sorted(token_store.read_tokens(spark, shards).collect(), key=lambda r: r["start"])
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in full] == [w[4] for w in want]
    assert not [f for f in os.listdir(where.removeprefix("file://")) if f.endswith(".part")]


def test_shards_end_at_a_size(spark, monkeypatch):
    """Ranges and shards of a repeated id are split; the corpus stays in order."""
    rows = [(7, "the same text in every row")] * 400 + [(i, f"number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one range
    try:
        shards = token_store.write_tokens(docs, fresh_path(spark, "tokens"), PATHS[0], 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["n_docs"] for r in shards.collect()) < 300  # the id's rows are in several ranges
    want = expected(rows, PATHS[0], 0)
    assert sorted(map(tuple, token_store.read_tokens(spark, shards, digests_only=True).collect()), key=lambda r: r[1]) == [w[:4] for w in want]
    out = token_store.ShardWriter("file:///tmp/edictum-unused-shard")
    monkeypatch.setattr(token_store, "SHARD_IDS", 10)
    out.add(1, np.arange(9, dtype="<u4").tobytes())
    assert not out.full
    out.add(1, b"\x00" * 4)
    assert out.full
    out.abort()


def test_the_query_on_a_table(spark):
    """The query's rows are those of the plain library."""
    from edictum.llm.queries import op6_simple8b

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op6_simple8b(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == [w[:4] for w in expected(rows, PATHS[0], 0)]


def test_empty_table(spark):
    shards = token_store.write_tokens(spark.createDataFrame([], SCHEMA), fresh_path(spark, "tokens"), PATHS[0], 0)
    assert token_store.read_tokens(spark, shards).count() == 0


def test_damaged_shard(tmp_path):
    out = token_store.ShardWriter(f"file://{tmp_path}/a")
    out.add(1, np.arange(1000, dtype="<u4").tobytes())
    assert out.close() == (1, 1000)
    (tmp_path / "b").write_bytes((tmp_path / "a").read_bytes()[8:])
    with pytest.raises(ValueError):
        list(token_store.read_shard(f"file://{tmp_path}/b"))
