import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edictum.llm import chat
from edictum.llm.queries import op9_chat

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<", "|", "\n", "é́", "🙂", "a b", " ", "<\\|"]), max_size=8).map("".join)


@given(NASTY)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys<|im_sep|>tem", ""]), NASTY), max_size=6))
@settings(max_examples=200, deadline=None)
def test_render_parse_and_mask(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    e = chat.chat_tokenizer(PATH).encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets).reshape(-1, 2)
    mask = chat.mask_of(offsets, spans)
    inside = np.zeros(len(formatted), dtype=bool)
    for a, b in offsets[mask]:
        inside[a:b] = True
    want = np.zeros(len(formatted), dtype=bool)
    for a, b in spans:
        want[a:b] = True
    assert (inside == want).all()


def digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def check(spark, rows):
    key = lambda r: [(v is not None, v if v is not None else 0) for v in (r[1],)] + [(v is not None, v or "") for v in r[2:]]
    want = {}
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append((r[2], r[3]))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as segment", "'x' as mask")
    assert got(chat.read_back(chat.format_conversations(df, PATH).repartition(3))) == {c: digest(t) for c, t in want.items()}


def test_conversations(spark):
    check(spark, [(1, 1, "assistant", "reply\nover lines"), (1, 0, "user", "Hi"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "again"), (2, 0, None, "no role"), (None, 0, "assistant", "no id"), (3, 0, "assistant", " \n leading and trailing \n"), (4, 5, "user", "gap"), (4, 9, "assistant", "<|im_end|>\\<|x")])


def test_ties_repeated_rows_and_long_texts(spark):
    check(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "same"), (1, 0, "assistant", "same"), (1, None, "assistant", "first"), (2, 0, "assistant", "word " * 100_000)])


def test_a_very_large_conversation_in_segments(spark, monkeypatch):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " * 40) for i in range(2500)] + [(8, 0, "assistant", "small")]
    check(spark, rows)
    segments = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), PATH).groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in segments}[7] > 2


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_the_query_matches_brute_force(spark, sf):
    want = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got(op9_chat(spark, f"/root/testdata/{sf}")) == {c: digest(t) for c, t in want.items()}
