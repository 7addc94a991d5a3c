"""Encoding whole texts by the tokenizers library, with what it gives for a word kept for the next time.

Both vocabularies split at white space before they merge: a token never holds a white-space
character after another character. Both also split between letters and punctuation. So a text
may be cut before each ASCII white-space run that follows an ordinary character, and between an
ASCII letter and an ASCII punctuation mark (but the apostrophe), and the ids of the parts put
together are those of the whole.
A column of texts is cut by their bytes, its different parts are found by Arrow's dictionary
encoding, and each goes through the library once; the parts' ids are then dealt out by index.
Texts with rarer white space, control characters or names of special tokens are encoded whole, so
such names get the ids that the library gives them.
Two generations of seen parts bound the memory.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Parts kept in each of two generations, a few hundred bytes each.
KEPT = 400_000
#: Longer parts are not kept.
LONGEST = 64
#: Bytes of text that are cut and encoded at once (or one text, if it is longer).
BLOCK = 1 << 22
_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(b" \t\n\v\f\r")] = True
_LETTER, _MARK = np.zeros((2, 256), dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")] = True  # but the apostrophe, which begins endings
#: Control characters and white space beyond ASCII, in UTF-8, that libraries may see in different ways.
_RARE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rare = re.compile(b"|".join([_RARE, *special]))
        self.leads = np.zeros(256, dtype=bool)  # first bytes of what the expression finds
        self.leads[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, *(t.lstrip(b"\\")[0] for t in special)]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts, from those seen before or the library."""
        found = list(map(self.new.get, parts))
        missing = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            ids = self.old.get(parts[i])
            if ids is None:
                missing.append(i)
            else:
                found[i] = self.new[parts[i]] = ids
        for i, ids in zip(missing, self._library([parts[i] for i in missing])):
            found[i] = ids
            if len(parts[i]) <= LONGEST:
                self.new[parts[i]] = ids
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        return found

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts between the offsets into the bytes, which begin at 0."""
        white = _WHITE[data]
        cut = white.copy()
        cut[1:] &= ~white[:-1]
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return [b""] * (len(offsets) - 1)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        of_part = self._parts(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        # a text has less than 2**31 bytes, so 32 bits number its ids
        sizes = np.fromiter(map(len, of_part), dtype=np.int32, count=len(of_part)) // 4
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts, dtype=np.int32)
        at = np.repeat(first[index] - (ends - counts), counts)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(of_part), dtype="<u4")[at].tobytes()
        del at
        upto = np.append(0, ends).astype(np.int64)[np.searchsorted(starts, offsets)] * 4
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column, block by block; of null and empty texts, none."""
        column = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            part = data[offsets[at] : offsets[upto]]
            if self.leads[part].any() and self.rare.search(part):
                for i in range(at, upto):
                    one = part[offsets[i] - offsets[at] : offsets[i + 1] - offsets[at]]
                    yield from self._library([one.tobytes()]) if self.rare.search(one) else self._block(one, np.array([0, len(one)]))
            else:
                yield from self._block(part, offsets[at : upto + 1] - offsets[at])
            at = upto

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return next(self.encode_column(pa.array([text], pa.string())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    return Encoder(path)
