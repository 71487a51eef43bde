"""Suffix sorting of one bounded shard by induction.

Suffixes are tuples in a priority queue keyed by their first symbol. Taking them out in order, each hands the suffix one symbol before
it to the queue: first the larger-or-equal (L) ones upwards from the sorted leftmost-S suffixes, then the S ones downwards. A queue
with one FIFO for each symbol suffices, because a handed suffix never sorts before the one that hands it; the queue is the suffix array
itself with one write position for each symbol, and whatever waits in a symbol's FIFO is taken out together. The leftmost-S
suffixes are named by their substrings, which the same induction sorts, and the shorter string of names is ordered by doubling, up to the
depth that the caller needs.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol must be the unique smallest."""
    n = len(t)
    differs = np.empty(n, bool)
    differs[:-1] = t[1:] != t[:-1]
    differs[-1] = True
    up = np.empty(n, bool)
    up[:-1] = t[1:] > t[:-1]
    up[-1] = True
    at = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the end of the run of equal symbols
    return up[following]


def _push(queue: np.ndarray, write: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Append suffixes to the FIFOs of their symbols, in the given order; ``step`` -1 fills from the far end."""
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    counts = np.diff(np.append(first, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(first, counts)
    queue[write[symbols] + step * place] = suffixes
    write[symbols[first]] += step * counts


def _induce(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray, by_symbol: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost-S suffixes ``lms`` (in order; ``by_symbol`` cuts them by first symbol) induce."""
    queue = np.full(len(t), -1, np.int64)
    write, symbols = starts.copy(), range(len(starts))

    def hand(taken: np.ndarray, want_small: bool, step: int) -> None:
        before = taken[taken > 0] - 1
        before = before[smaller[before] == want_small]
        _push(queue, write, before, t[before], step)

    for c in symbols:
        read = starts[c]
        while read < write[c]:
            stop = write[c]
            taken, read = queue[read:stop], stop
            hand(taken, False, 1)
        hand(lms[by_symbol[c] : by_symbol[c + 1]], False, 1)
    larger_end = write
    write = ends - 1
    for c in reversed(symbols):
        read = ends[c] - 1
        while read > write[c]:
            stop = write[c]
            taken, read = queue[stop + 1 : read + 1][::-1], stop
            hand(taken, True, -1)
        hand(queue[starts[c] : larger_end[c]][::-1], True, -1)
    queue[0] = len(t) - 1
    return queue


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``names`` by their first ``depth`` symbols at least."""
    rank, k, m = names.astype(np.int64), 1, len(names)
    while k < depth:
        key = rank * (m + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(m, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, k = new, 2 * k
        if rank[order[-1]] == m - 1 or k >= m:
            break
    return rank


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of ``t`` by their first ``depth`` symbols at least; symbols are small, the last is 0 and the only 0."""
    n = len(t)
    smaller = _types(t)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t)
    ends = np.cumsum(sizes)
    starts = ends - sizes

    def cut(order: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(t[order], minlength=len(sizes)))])

    draft = lms[np.argsort(t[lms], kind="stable")]
    rough = _induce(t, smaller, starts, ends, draft, cut(draft))
    rough = rough[is_lms[rough]]  # leftmost-S substrings in order
    # Equal substrings get one name: a hash of symbols and length stands for them.
    mix = np.uint64(0x9E3779B97F4A7C15)
    number = np.searchsorted(lms, rough)
    stop = np.append(lms[1:], n - 1)
    length = stop - lms + 1
    hashed = np.zeros(len(lms), np.uint64)
    live, step = np.arange(len(lms)), 0
    while len(live):
        hashed[live] = (hashed[live] ^ t[lms[live] + step].astype(np.uint64)) * mix
        hashed[live] ^= hashed[live] >> np.uint64(29)
        step += 1
        live = live[length[live] > step]
    hashed ^= length.astype(np.uint64) << np.uint64(40)
    ordered = hashed[number]
    names = np.empty(len(lms), np.int64)
    names[number] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    rank = _doubled(names, depth // 2 + 1)
    lms = lms[np.argsort(rank, kind="stable")]
    return _induce(t, smaller, starts, ends, lms, cut(lms))
