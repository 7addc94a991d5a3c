"""Simple-8b: 64-bit words with a selector of 4 bits and ids of one width in the other 60.

Ids are coded in blocks of BLOCK, each beginning with a word of its own, so that any block can
be decoded alone and many at once. Ids of more than 60 bits are escapes: their word has
selector 0 and the number of the id in a table of whole ids. All steps run over many blocks
with numpy; only the walk from word to word is a loop, one step for all blocks.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
ESCAPE = 0
#: Fixed values of the format: ids a word, for selectors 1 to 14; each has 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_COUNT = np.array([1, *COUNTS, 0], dtype=np.int64)
_BITS = np.array([0, *(60 // c for c in COUNTS), 0], dtype=np.uint8)
_WIDE = BLOCK + max(COUNTS)
#: Bits of numbers below 65,536.
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_MASK60 = np.uint64((1 << 60) - 1)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (over 60: more than a word has)."""
    if ids.max(initial=0) < 1 << 16:
        return _WIDTH[ids]
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _selectors(widths: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector that packs most ids from there on."""
    n = widths.shape[1]
    best = np.full(widths.shape, ESCAPE, dtype=np.uint8)
    most = {1: widths}

    def window(c: int) -> np.ndarray:
        """The largest width among the c places from each place on; places after the end count as 0."""
        if c not in most:
            a = max(x for x in most if x < c)
            b = max(x for x in most if x <= c - a)
            if a + b < c:
                window(a + b)
                return window(c)
            out = most[a].copy()
            np.maximum(out[:, : n - a], most[b][:, a:], out=out[:, : n - a])
            most[c] = out
        return most[c]

    for selector in range(len(COUNTS), 0, -1):
        np.copyto(best, np.uint8(selector), where=window(COUNTS[selector - 1]) <= _BITS[selector])
    return best


def encode(ids: np.ndarray, escaped: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, number of words in each block, and escaped ids (numbered from ``escaped`` on)."""
    ids = np.asarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grid = np.zeros((blocks, _WIDE), dtype=np.uint64)
    full = len(ids) // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : len(ids) - full * BLOCK] = ids[full * BLOCK :]
    lengths = np.full(blocks, BLOCK, dtype=np.int64)
    lengths[-1] = len(ids) - (blocks - 1) * BLOCK
    best = _selectors(_widths(grid[:, :BLOCK]))
    flat, at, row = best.reshape(-1), np.zeros(blocks, dtype=np.int64), np.arange(blocks) * BLOCK
    places, chosen = [], []
    while (live := at < lengths).any():
        s = flat[row + np.minimum(at, BLOCK - 1)]
        places.append(np.where(live, at, -1))
        chosen.append(s)
        at = np.where(live, at + _COUNT[s], at)
    place, selector = np.stack(places, axis=1), np.stack(chosen, axis=1)
    used = place >= 0
    per_block = used.sum(axis=1)
    start = (place + (np.arange(blocks) * _WIDE)[:, None])[used]
    selector = selector[used]
    cells, words = grid.reshape(-1), selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[here] |= np.arange(escaped, escaped + len(here), dtype=np.uint64)
            escapes = cells[start[here]]
        else:
            shifts = np.arange(_COUNT[s], dtype=np.uint64) * np.uint64(_BITS[s])
            words[here] |= np.bitwise_or.reduce(cells[start[here][:, None] + np.arange(_COUNT[s])] << shifts, axis=1)
    return words, per_block, escapes if (selector == ESCAPE).any() else np.empty(0, np.uint64)


def decode(words: np.ndarray, per_block: np.ndarray, n_ids: int, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, of which only the last may be short. The inverse of encode()."""
    blocks = len(per_block)
    if not blocks:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    counts = _COUNT[selector]
    before = np.cumsum(counts) - counts
    first = np.cumsum(per_block) - per_block
    block = np.repeat(np.arange(blocks), per_block)
    start = before - before[first][block] + block * _WIDE
    grid = np.zeros(blocks * _WIDE, dtype=np.uint64)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == ESCAPE:
            grid[start[here]] = escapes[words[here] & _MASK60]
        else:
            shifts = np.arange(_COUNT[s], dtype=np.uint64) * np.uint64(_BITS[s])
            grid[(start[here][:, None] + np.arange(_COUNT[s])).reshape(-1)] = ((words[here] & _MASK60)[:, None] >> shifts & np.uint64((1 << int(_BITS[s])) - 1)).reshape(-1)
    return grid.reshape(blocks, _WIDE)[:, :BLOCK].reshape(-1)[:n_ids]
