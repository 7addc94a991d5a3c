"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a new line. Inside roles
and texts each backslash is doubled and ``<|`` becomes ``<\\|``, which is reversible and leaves
no control string. The control strings are added to the tokenizer as tokens of their own, so no
token crosses the bound of a turn's text. A segment of whole turns is encoded once with
offsets; the sorted token spans are met with the sorted spans of assistant texts by binary
search, which gives the mask over tokens. Conversations are rendered in segments of bounded
length, cut between turns only, so their ids are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.shipping import ship_package

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A segment ends with the turn that takes it past so many characters.
SEGMENT = 1 << 18
LEARNT = "assistant"
_ESCAPED = re.compile(r"\\([\\|])")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """Without ``<|``; the inverse of unescape()."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the spans of the texts to learn from."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted segment. The inverse of render()."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The tokenizer with the control strings as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_file(path)
    out.add_tokens([AddedToken(x, normalized=False) for x in (START, SEP, END)])
    return out


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (rows of start and end, sorted) lie in one of the sorted, disjoint spans."""
    mask = np.zeros(len(offsets), dtype=bool)
    if not spans or not len(offsets):
        return mask
    bounds = np.array(spans)
    at = np.searchsorted(bounds[:, 0], offsets[:, 0], "right") - 1
    inside = at >= 0
    mask[inside] = (offsets[inside, 0] < bounds[at[inside], 1]) & (offsets[inside, 1] <= bounds[at[inside], 1])
    return mask & (offsets[:, 1] > offsets[:, 0])


SEGMENTS = "conv_id bigint, segment int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
_KINDS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each segment of each conversation: text, ids, offsets of tokens in code points, and loss mask.

    ``turns`` has conv_id, turn, role, text; other columns are left out. Turns are in order of
    turn, then role, then text, nulls first; repeated rows are repeated turns. Null roles and
    texts count as empty. Turns with a null conv_id are one conversation. An empty table gives
    no rows. Rows come sorted by conversation and segment within their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chat_tokenizer(tokenizer)
        waiting: list[tuple[str, str]] = []
        rows, now, number, held = [], None, 0, 0

        def settle() -> None:
            nonlocal number, held
            formatted, spans = render(waiting)
            e = tok.encode(formatted, add_special_tokens=False)
            offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            rows.append((now, number, formatted, e.ids, offsets[:, 0], offsets[:, 1], mask_of(offsets, spans)))
            waiting.clear()
            number, held = number + 1, 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS.types)], schema=_KINDS)
            rows.clear()
            return out

        size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if (waiting or number) and conv != now:
                    if waiting:
                        settle()
                    number = 0
                now = conv
                waiting.append((role or "", text or ""))
                held += len(role or "") + len(text or "")
                size += len(text or "")
                if held > SEGMENT:
                    settle()
                if size > 1 << 20 and rows:
                    size = 0
                    yield flush()
        if waiting:
            settle()
        if rows:
            yield flush()

    ship_package(turns.sparkSession)
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return turns.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the segments' text, offsets and masks alone: a row a conversation.

    The text to learn from is that of the masked tokens: the union of their spans in each turn,
    unescaped.
    """
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, state = [], None, None

        def settle() -> None:
            n, turns, chars, loss, formatted = state
            rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, formatted, starts, ends, mask = (batch.column(j)[i] for j in (0, 1, 2, 4, 5, 6))
                conv, formatted = conv.as_py(), formatted.as_py()
                if state is None or conv != now:
                    if state is not None:
                        settle()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                keep = mask.values.to_numpy(zero_copy_only=False).astype(bool)
                a, b = starts.values.to_numpy()[keep], ends.values.to_numpy()[keep]
                if len(a):  # runs of touching or overlapping spans are the texts of turns
                    reach = np.maximum.accumulate(b)
                    first = np.concatenate([[True], a[1:] > reach[:-1]])
                    for x, y in zip(a[first], np.concatenate([reach[:-1][first[1:]], reach[-1:]])):
                        piece = unescape(formatted[x:y])
                        state[2] += len(piece)
                        state[3].update(piece.encode())
                state[4] += len(formatted)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                rows = []
        if state is not None:
            settle()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    ship_package(segments.sparkSession)
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
