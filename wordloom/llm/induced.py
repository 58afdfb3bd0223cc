"""Suffix sorting by induction, with queues that spill to disk.

The suffixes of type S* (an S-type suffix right of an L-type one) are sorted by the
names of the substrings between them, reduced by doubling until names are unique;
from them all L-type suffixes are induced in ascending order of buckets, and from
those all S-type ones in descending order.  Both passes run on a monotone priority
queue by first symbol: whatever is pushed for a symbol pops in the order it was
pushed, which induction makes the order of the suffixes.  The queue holds LIMIT
entries in memory and keeps the rest in a scratch file of the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

LIMIT = 1 << 22
SYMBOLS = 257  # 0 ends a string; byte b is b + 1


class SymbolQueue:
    """Arrays of positions by symbol, first in, first out; beyond `limit` entries on disk."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit, self.held, self.file, self.end = limit, 0, None, 0
        self.runs: list[list] = [[] for _ in range(SYMBOLS)]

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for runs in self.runs:
            for k, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    self.file.write(run.tobytes())
                    runs[k] = (self.end, len(run))
                    self.end += run.nbytes
        self.held = 0

    def push(self, positions: np.ndarray, symbols: np.ndarray) -> None:
        """positions in order; they are dealt to their symbols stably."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        positions, symbols = positions[order], symbols[order]
        cut = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            self.runs[symbols[a]].append(positions[a:b])
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def pop(self, symbol: int) -> np.ndarray:
        parts = []
        for run in self.runs[symbol]:
            if isinstance(run, tuple):
                self.file.seek(run[0])
                run = np.frombuffer(self.file.read(run[1] * 8), np.int64)
            else:
                self.held -= len(run)
            parts.append(run)
        self.runs[symbol] = []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(sym: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (type S); ends (0) are S."""
    n = len(sym)
    smaller, equal = np.zeros(n, bool), np.zeros(n, bool)
    smaller[:-1], equal[:-1] = sym[:-1] < sym[1:], sym[:-1] == sym[1:]
    equal[sym == 0] = False
    smaller[sym == 0] = True
    # within a run of equal symbols the type is that of the run's last one
    last = np.flatnonzero(~equal)
    return smaller[last[np.searchsorted(last, np.arange(n))]]


def _sorted_stars(sym: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The S* positions in the order of their suffixes; ends count as distinct, by position."""
    m = len(stars)
    stop = np.append(stars[1:], stars[-1])  # inclusive end of the substring of each
    end = sym[stars] == 0
    stop[end] = stars[end]
    length = stop - stars + 1
    letter = (sym.astype(np.uint64) << np.uint64(1)) | is_s.astype(np.uint64)  # 10 bits; L before S on equal symbols
    name = np.zeros(m, np.int64)
    live = np.arange(m)
    at = 0
    while True:  # refine names by six letters at a time, for the substrings that go on
        key = np.zeros(len(live), np.uint64)
        for d in range(6):
            inside = at + d < length[live]
            value = np.where(inside, letter[np.minimum(stars[live] + at + d, len(sym) - 1)] + np.uint64(1), 0).astype(np.uint64)
            key = (key << np.uint64(10)) | value
        order = np.lexsort((key, name[live]))
        old, key = name[live][order], key[order]
        new = np.concatenate(([False], (old[1:] != old[:-1]) | (key[1:] != key[:-1])))
        # a name is the number of substrings before its class, so refined names keep their place
        first = np.flatnonzero(np.concatenate(([True], new[1:])))
        group = np.cumsum(np.concatenate(([0], new[1:].astype(np.int64))))
        base = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        start = base[np.cumsum(np.concatenate(([0], (old[1:] != old[:-1]).astype(np.int64))))]
        name[live[order]] = old + first[group] - start
        at += 6
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        tied = np.zeros(m, bool)
        same = ranked[1:] == ranked[:-1]
        tied[order[1:]] |= same
        tied[order[:-1]] |= same
        live = np.flatnonzero(tied & ~end & (length > at))
        # every substring of a tied class goes on or none does: equal letters so far include the type of the last
        if not len(live):
            break
        full = np.isin(name, np.unique(name[live])) & ~end
        live = np.flatnonzero(full)
    ends = np.flatnonzero(end)
    name[ends] = np.arange(len(ends))  # distinct, and below all others
    shift = 1
    while True:
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        tied = np.zeros(m, bool)
        same = ranked[1:] == ranked[:-1]
        tied[order[1:]] |= same
        tied[order[:-1]] |= same
        live = np.flatnonzero(tied)
        if not len(live):
            return stars[order]
        after = name[np.minimum(live + shift, m - 1)]
        inner = np.lexsort((after, name[live]))
        old, key = name[live][inner], after[inner]
        change = np.concatenate(([True], old[1:] != old[:-1]))
        new = change | np.concatenate(([True], key[1:] != key[:-1]))
        where = np.arange(len(live))
        base = where[change][np.cumsum(change) - 1]
        first = where[new][np.cumsum(new) - 1]
        name[live[inner]] = old + first - base
        shift *= 2


def suffix_array(sym: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Positions of all suffixes of `sym` but the ends, in ascending order.

    sym: integers below SYMBOLS, the last one 0. A 0 ends a string: suffixes are
    compared no further, and equal ones stand in no particular order."""
    n = len(sym)
    sym = sym.astype(np.int16)
    is_s = _types(sym)
    star = np.zeros(n, bool)
    star[1:] = is_s[1:] & ~is_s[:-1]
    star |= sym == 0
    stars = np.flatnonzero(star)
    order = _sorted_stars(sym, is_s, stars)
    edge = np.searchsorted(sym[order], np.arange(SYMBOLS + 1))

    def before(at: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        at = at[at > 0] - 1
        at = at[(is_s[at] == kind) & (sym[at] != 0)]
        return at, sym[at]

    queue, large = SymbolQueue(limit), [np.zeros(0, np.int64)] * SYMBOLS
    for c in range(SYMBOLS):
        done, now = [], queue.pop(c)
        while len(now):
            done.append(now)
            pred, symbol = before(now, False)
            queue.push(pred[symbol != c], symbol[symbol != c])
            now = pred[symbol == c]
        queue.push(*before(order[edge[c] : edge[c + 1]], False))
        if done:
            large[c] = np.concatenate(done)
    queue.close()
    queue, out = SymbolQueue(limit), []
    for c in range(SYMBOLS - 1, 0, -1):
        done, now = [], queue.pop(c)
        while len(now):
            done.append(now)
            pred, symbol = before(now, True)
            queue.push(pred[symbol != c], symbol[symbol != c])
            now = pred[symbol == c]
        queue.push(*before(large[c][::-1], True))
        out += [*done, large[c][::-1]]
    queue.close()
    return np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether text[a : a + length] equals text[b : b + length], for arrays of starts that leave room."""
    if len(text) < 8 or length < 8:
        return np.array([bytes(text[i : i + length]) == bytes(text[j : j + length]) for i, j in zip(a, b, strict=True)], dtype=bool)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    words = np.ascontiguousarray(words).view(np.uint64).reshape(-1)
    same = np.ones(len(a), bool)
    for d in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = words[a[live] + d] == words[b[live] + d]
    return same
