"""Simple-8b: unsigned ids in 64-bit words, for whole arrays at once.

A word is a 4-bit selector (the lowest bits) and 60 bits of ids. Selector s from 2 to 15 packs ``COUNTS[s]`` ids of
``BITS[s]`` bits each; selector 1 stands for 120 zeros; selector 0 is the escape: the next word is one raw id of up
to 64 bits. Ids are coded in blocks of ``BLOCK``; a block begins at a word, so that blocks are coded and decoded
side by side. Ids that a block's last word holds beyond the block are padding.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
# fixed values of the coding: ids per word and bits per id, by selector
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def _bit_length(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; through double exponents, which are exact below 2**53."""
    if ids.size and ids.max() < len(SMALL):
        return SMALL[ids]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high)[1] + 32, low).astype(np.int8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For every position of padded blocks (rows), the selector that packs the most ids from there on."""
    pad = np.zeros((bits.shape[0], max(COUNTS)), np.int8)
    wide = np.concatenate([bits, pad], axis=1)
    spans, size = {1: wide}, 1
    while size < max(COUNTS):
        last = spans[size]
        spans[size * 2] = np.maximum(last[:, : last.shape[1] - size], last[:, size:])
        size *= 2
    best = np.zeros(bits.shape, np.int8)  # the escape, unless something fits
    for s in range(len(COUNTS) - 1, 0, -1):
        count = COUNTS[s]
        half = max(p for p in spans if p <= count)
        n = bits.shape[1]
        most = np.maximum(spans[half][:, :n], spans[half][:, count - half : count - half + n])
        best = np.where(most <= BITS[s], np.int8(s), best)
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all ids, and the words in each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    step = BLOCK * 512  # blocks that fit in a processor's cache
    parts = [_encode(ids[i : i + step]) for i in range(0, len(ids), step)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_blocks = -(-len(ids) // BLOCK)
    width = BLOCK + max(COUNTS)
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    rows = np.zeros((n_blocks, width), np.uint64)
    rows[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    choice = np.zeros((n_blocks, width), np.int8)
    choice[:, :BLOCK] = _selectors(_bit_length(rows[:, :BLOCK]))
    choice, rows = choice.ravel(), rows.ravel()
    begin = np.arange(n_blocks) * width
    end = begin + BLOCK
    end[-1] = begin[-1] + len(ids) - (n_blocks - 1) * BLOCK
    counts, sizes = np.array(COUNTS), 1 + (np.arange(len(COUNTS)) == 0)
    alive, at, used = np.arange(n_blocks), begin.copy(), np.zeros(n_blocks, np.int64)
    steps = []
    while len(alive):  # one word per block and step
        now = at[alive]
        chosen = choice[now]
        steps.append((alive, now, chosen, used[alive]))
        used[alive] += sizes[chosen]
        now = now + counts[chosen]
        at[alive] = now
        alive = alive[now < end[alive]]
    block, start, chosen, nth = (np.concatenate(x) for x in zip(*steps))
    place = (np.cumsum(used) - used)[block] + nth
    words = np.zeros(int(used.sum()), np.uint64)
    for s in np.unique(chosen):
        these = np.flatnonzero(chosen == s)
        first, to = start[these], place[these]
        word = np.full(len(these), s, np.uint64)
        if s == 0:
            words[to + 1] = rows[first]
        elif s > 1:
            for j in range(COUNTS[s]):
                word |= rows[first + j] << np.uint64(4 + j * BITS[s])
        words[to] = word
    return words, used


def decode(words: np.ndarray, block_words: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of consecutive blocks, all full but for the last; ``n_ids`` in all."""
    if not len(block_words):
        return np.zeros(0, np.uint64)
    first = np.cumsum(block_words) - block_words
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = _escaped(selector, first)
    keep = np.flatnonzero(~raw)
    selector = selector[keep]
    count = np.array(COUNTS)[selector]
    block = np.repeat(np.arange(len(block_words)), block_words)[keep]
    end = np.cumsum(count)
    lead = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    base = (end - count)[lead]
    start = end - count - np.repeat(base, np.diff(np.r_[lead, len(block)])) + block * BLOCK
    out = np.zeros(len(block_words) * BLOCK + max(COUNTS), np.uint64)
    # the padding of a block's last word is zero and overlaps the next block, so values are added
    for s in np.unique(selector):
        these = np.flatnonzero(selector == s)
        if s == 0:
            out[start[these]] += words[keep[these] + 1]
        elif s > 1:
            mask = np.uint64((1 << BITS[s]) - 1)
            body = words[keep[these]]
            for j in range(COUNTS[s]):
                out[start[these] + j] += (body >> np.uint64(4 + j * BITS[s])) & mask
    return out[:n_ids]


def _escaped(selector: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words are raw ids: those after an escape that is not raw itself."""
    raw = np.zeros(len(selector), bool)
    zero = np.flatnonzero(selector == 0)
    skip = -1
    for i in zero:  # escapes are rare
        if i != skip:
            raw[i + 1] = True
            skip = i + 1
    return raw
