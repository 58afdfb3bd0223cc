"""Fuzzy passages by collinear chaining.

1. Seeds: all strings of SEED consecutive words of a document.  They travel as packed
   records by hash; those that stand once meet nothing.
2. Each occurrence of a seed that up to MATES + 1 documents have is matched with every
   earlier one of them.  Of a more common seed, what counts is how the text goes on: the
   documents that also share the seed LATER words further on (whatever stands between)
   are matched in the same way, and where those are more than MATES + 1 too, the first
   and the previous one, the first and the previous one that have the seed, and the
   first that shares MIN_WORDS words.
   So matches are linear in the number of occurrences, however common a seed is, and
   every exact repeat of MIN_WORDS words meets one source that holds all of it.
   Parts of documents that may have passages by the matches left out (see `stretches`)
   are compared with all earlier documents after step 3, exactly (see `_others`).
3. The matches of two documents that continue one another are one anchor.  Anchors are
   chained: they ascend in both documents, each adds its words, each word skipped in
   either costs GAP.  A Fenwick tree over the second positions gives the best
   predecessor of each anchor, exactly.  A chain ends where more than MOST_GAP words differ.
4. Per document, chains are aligned: word by word between their anchors
   and outwards from their ends.  A passage has at least MIN_WORDS matched words and
   matches PERCENT of both sides; where the whole alignment does not, the longest
   parts of it that do are passages.  Only passages (and, before, chains that are
   sure to be one) make another superfluous that has no more than MARGIN words of its own.

A seed that a large part of all documents have is matched where it is read: of each batch
only the documents that others can need as a source travel on, MATES of a seed and of
each way in which it goes on.

Words are runs of characters outside [\\x20\\x09-\\x0D], A-Z in lower case.  Every
passage of a document that chains to an earlier document is found with a source;
"earlier" is by id (null last), then by a hash of the text.  Repeat rows (equal id
and text) are one document.  Null, empty and short texts have no passages, nor have
empty tables.  A very long text costs what its words cost.  Of passages that tie, the
one with the smaller source counts.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .base import parts, store, table

SEED, LATER = 5, 7
MATES = 8
GAP, MOST_GAP = 0.15, 64
MIN_WORDS, PERCENT = 40, 80
MARGIN = 13
#: Words that the anchors of a chain cover at least; what alignment adds are words between and around them.
LEAST = 15
#: Matches that a task holds before it packs them.
HELD = 1 << 20
NULL_ID = (1 << 63) - 1
#: The two highest bits of a place in the source: the match goes on for MIN_WORDS words; there is another one LATER words further on.
RUN, PAIR = np.uint32(1 << 31), np.uint32(1 << 30)
#: The third: more documents have the seed than it is matched with. Of a seed's own place, the highest: not all that have it travel.
CUT, MANY = np.uint32(1 << 29), np.uint32(1 << 31)
#: Passages that one copy of their source's text serves.
PER_SOURCE = 500
#: Ids of several rows that are broadcast at most; their rows carry a hash of the text.
REPEATED_IDS = 100_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SEED = np.dtype([("hash", "<u8"), ("d", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("later", "<u4"), ("run", "<u4")])
#: Bytes of each field that travel: the part tells the top bits of the hash.
_SEED_BYTES = {"hash": 5, "later": 2, "run": 3}
_MATCH = np.dtype([("d", "<i8"), ("tag", "<u4"), ("s", "<i8"), ("stag", "<u4"), ("pos", "<u4"), ("spos", "<u4")])
#: A seed of a stretch whose sources are not all known; k: how many places of the document have it before.
_REST = np.dtype([("hash", "<u8"), ("d", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("k", "<u4")])
#: Records of such seeds that are compared with a document at a time; hits, and pairs of stretch and source, that are held.
BLOCK, HITS = 1 << 20, 1 << 22
#: Logarithm of the bits in the filter of their hashes.
FILTER = 24
_SPOT = "d long, tag long, s long, stag long, lo int, hi int, slo int, shi int, matched int, anchors array<int>"


def part_bits(spark: SparkSession) -> int:
    """Bits of a hash that name its part: several parts for each shuffle partition, whatever their number."""
    return min(16, max(10, (4 * parts(spark) - 1).bit_length()))


def seeds(h: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every string of SEED words."""
    x, n, first = K.shingles(h, rows, n_rows, SEED)
    words = np.bincount(rows, minlength=n_rows)
    ok = np.repeat(words >= SEED, n)
    row = np.repeat(np.arange(n_rows), n)[ok]
    return x[ok], row, first[ok] - (np.cumsum(words) - words)[row]


def runs(h: np.ndarray, words: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each seed a hash of the MIN_WORDS words that start there, 0 where the text ends before."""
    out = np.zeros(len(pos), np.uint32)
    ok = pos + MIN_WORDS <= words[row]
    at = (pos + (np.cumsum(words) - words)[row])[ok]
    out[ok] = (K.Rolling(h).ranges(at, at + MIN_WORDS) >> np.uint64(40)).astype(np.uint32) | np.uint32(1)
    return out


def later(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each seed 16 bits of the seed LATER words further on, 0 where there is none."""
    out = np.zeros(len(x), np.uint32)
    ok = np.flatnonzero(row[LATER:] == row[:-LATER]) if len(x) > LATER else np.zeros(0, np.int64)
    out[ok] = (x[ok + LATER] & np.uint64(0xFFFF)).astype(np.uint32) | np.uint32(1)
    return out


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _packed(r: np.ndarray, sizes: dict[str, int]) -> bytes:
    """Records that ascend by document as planes of bytes: what neighbours share becomes zeros."""
    out = []
    for name in r.dtype.names:
        x = r[name]
        if name in ("d", "s"):
            x = np.diff(x, prepend=0)
        elif name in ("tag", "stag"):
            x = x ^ np.concatenate((np.zeros(1, x.dtype), x[:-1]))
        size = sizes.get(name, x.dtype.itemsize)
        out.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(r), -1).T[:size].tobytes())
    return len(r).to_bytes(4, "little") + _codec().compress(b"".join(out), asbytes=True)


def _unpacked(blob: bytes, kind: np.dtype, sizes: dict[str, int]) -> np.ndarray:
    width = sum(sizes.get(name, kind[name].itemsize) for name in kind.names)
    r, at = np.zeros(int.from_bytes(blob[:4], "little"), kind), 0
    blob = _codec().decompress(blob[4:], width * len(r), asbytes=True)
    for name in kind.names:
        size, full = sizes.get(name, kind[name].itemsize), kind[name].itemsize
        planes = np.zeros((len(r), full), np.uint8)
        planes[:, :size] = np.frombuffer(blob, np.uint8, size * len(r), at).reshape(size, -1).T
        x = planes.view(kind[name])[:, 0]
        at += size * len(r)
        r[name] = np.cumsum(x) if name in ("d", "s") else np.bitwise_xor.accumulate(x) if name in ("tag", "stag") else x
    return r


_ROW = "kind int, part int, records binary"


def _blobs(kind: int, records: np.ndarray, to: np.ndarray, bits: int, sizes: dict[str, int]) -> pa.RecordBatch:
    """Rows (kind, part, records) of packed records."""
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange((1 << bits) + 1))
    used = np.flatnonzero(np.diff(edge))
    records = records[order]
    blobs = pa.array([_packed(records[edge[p] : edge[p + 1]], sizes) for p in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), pa.array(used.astype(np.int32)), blobs], ["kind", "part", "records"])


def _find(bits: int):
    """Rows of seeds (kind 0) and of matches (kind 1)."""

    def run(batches):
        for batch in batches:
            buf, off = K.buffer_of(batch.column(2))
            d = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tag = batch.column(1).to_numpy(zero_copy_only=False)
            found = []
            for i, j in K.chunks(off):
                part = K.lower_ascii(buf[off[i] : off[j]])
                s, e, rows = K.words(part, off[i : j + 1] - off[i])
                h = K.word_hashes(part, s, e)
                x, row, pos = seeds(h, rows, j - i)
                r = np.zeros(len(x), _SEED)
                r["hash"], r["d"], r["tag"], r["pos"] = x, d[row + i], tag[row + i], pos
                r["later"], r["run"] = later(x, row), runs(h, np.bincount(rows, minlength=j - i), row, pos)
                found.append(r)
            if not found:
                continue
            r = np.concatenate(found)
            if len(r):
                r, matches = _settled_here(r)
                yield from _by_document([matches], bits)
                to = (r["hash"] >> np.uint64(64 - bits)).astype(np.int64)
                yield _blobs(0, r, to, bits, _SEED_BYTES)

    return run


def _settled_here(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the seeds that travel, matches of those that do not): of a seed that more than twice
    MATES documents of a batch have, the first MATES travel, and the first MATES of those
    that share the seed LATER words further on, and the first that shares MIN_WORDS words."""
    low = (r["hash"] & np.uint64(0xFFFFF)).astype(np.int64)
    common = np.bincount(low, minlength=1 << 20)[low] > 2 * MATES
    r, c = r[~common], r[common]
    c = c[np.lexsort((c["pos"], c["tag"], c["d"], c["hash"]))]
    g = Grouped(c, np.arange(len(c)), ("hash",))
    stays = (g.rank < MATES) | (g.size <= 2 * MATES)
    if stays.all():
        return np.concatenate((r, c)), np.zeros(0, _MATCH)
    for field, most in (("later", MATES), ("run", 1)):
        sub = Grouped(c, np.lexsort((c["pos"], c["tag"], c["d"], c[field], c["hash"])), ("hash", field))
        stays[sub.order] |= (sub.rank < most) & (c[field][sub.order] > 0)
    many = g.size > 2 * MATES
    matches = _matched(c, ~stays, c["hash"][many])
    c["pos"][many] |= MANY
    return np.concatenate((r, c[stays])), matches


def _parts(batches, kind: np.dtype, sizes: dict[str, int], passing: int = -1) -> Iterator[np.ndarray | pa.RecordBatch]:
    """The records of each part; rows come by part. Rows of the kind `passing` come out as they are."""
    part, held = -1, []
    for batch in batches:
        kinds, names, blobs = (batch.column(k).to_pylist() for k in range(3))
        through = [k for k, x in enumerate(kinds) if x == passing]
        if through:
            yield batch.take(pa.array(through))
        for k in range(batch.num_rows):
            if kinds[k] == passing:
                continue
            if names[k] != part and held:
                yield np.concatenate(held)
                held = []
            part = names[k]
            held.append(_unpacked(blobs[k], kind, sizes))
    if held:
        yield np.concatenate(held)


class Grouped:
    """Records r[order] in groups of equal fields, within a group by document and place."""

    def __init__(self, r: np.ndarray, order: np.ndarray, fields: tuple[str, ...]) -> None:
        n = len(order)
        self.r, self.order = r, order
        differs = lambda names: np.concatenate((np.ones(min(n, 1), bool), np.logical_or.reduce([r[x][order[1:]] != r[x][order[:-1]] for x in names])))
        new = differs(fields)
        new_doc = new | differs(("d", "tag"))
        self.doc = np.cumsum(new_doc) - 1  # number of the document among all groups
        self.doc_start = np.append(np.flatnonzero(new_doc), n)
        first_doc = self.doc[np.flatnonzero(new)]
        group = np.cumsum(new) - 1
        docs = np.diff(np.append(first_doc, self.doc[-1] + 1 if n else 0))
        self.first = first_doc[group] if n else np.zeros(0, np.int64)
        self.rank = self.doc - self.first  # documents of the group before this one
        self.size = docs[group] if n else np.zeros(0, np.int64)

    def pairs(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, record of an earlier document) for the records `use` (flags in order): with every
        earlier document of groups of MATES + 1 at most, else with the first and the previous one. Of a
        document that has the seed several times, the first place and the place of the same number."""
        at = np.flatnonzero(use & (self.rank > 0))
        few = self.size[at] <= MATES + 1
        n = np.where(few, self.rank[at], 1)
        dst = np.repeat(at, n)
        doc = np.repeat(self.first[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        more = at[~few & (self.rank[at] > 1)]
        dst, doc = np.concatenate((dst, more)), np.concatenate((doc, self.doc[more] - 1))
        place = np.minimum(dst - self.doc_start[self.doc[dst]], self.doc_start[doc + 1] - self.doc_start[doc] - 1)
        again = place > 0
        dst, src = np.concatenate((dst, dst[again])), np.concatenate((self.doc_start[doc], self.doc_start[doc[again]] + place[again]))
        return self.order[dst], self.order[src]


def _matched(r: np.ndarray, use: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Matches of the records `use` (flags) of r, which is in the order of (hash, d, tag, pos).
    many: seeds that others have whose records are not in r."""
    g = Grouped(r, np.arange(len(r)), ("hash",))
    dst, src = g.pairs(use)
    out = [_matches(r, dst, src)]
    cut = g.size > MATES + 1
    if len(many):
        cut |= np.isin(r["hash"], many)
    out[0]["spos"][cut[dst]] |= CUT
    wide = np.flatnonzero((g.size > MATES + 1) & (r["later"] > 0))
    if len(wide):
        c = r[wide]
        sub = Grouped(c, np.lexsort((c["pos"], c["tag"], c["d"], c["later"], c["hash"])), ("hash", "later"))
        both = _matches(c, *sub.pairs(use[wide][sub.order]))
        both["spos"] |= PAIR
        out.append(both)
        crowded = np.zeros(len(c), bool)
        crowded[sub.order] = sub.size > MATES + 1
        wide = wide[crowded & (c["run"] > 0)]
        c = r[wide]
        sub = Grouped(c, np.lexsort((c["pos"], c["tag"], c["d"], c["run"], c["hash"])), ("hash", "run"))
        at = np.flatnonzero(use[wide][sub.order] & (sub.rank > 0))
        long = _matches(c, sub.order[at], sub.order[sub.doc_start[sub.first[at]]])
        long["spos"] |= RUN
        out.append(long)
    return np.concatenate(out)


def _match(bits: int):
    """Packed matches of seed occurrences, by the later document."""

    def run(batches):
        held: list[np.ndarray] = []
        for r in _parts(batches, _SEED, _SEED_BYTES, passing=1):
            if isinstance(r, pa.RecordBatch):
                yield r
                continue
            r = r[np.argsort(r["hash"])]
            same = r["hash"][1:] == r["hash"][:-1]
            r = r[np.concatenate((same, [False])) | np.concatenate(([False], same))]  # most seeds stand once
            many = np.unique(r["hash"][r["pos"] >= MANY])
            r["pos"] &= ~MANY
            r = r[np.lexsort((r["pos"], r["tag"], r["d"], r["hash"]))]
            again = np.ones(max(len(r) - 1, 0), bool)  # repeat rows are one document
            for name in ("hash", "d", "tag", "pos"):
                again &= r[name][1:] == r[name][:-1]
            r = r[np.concatenate((np.ones(min(len(r), 1), bool), ~again))]
            if not len(r):
                continue
            held.append(_matched(r, np.ones(len(r), bool), many))
            if sum(map(len, held)) >= HELD:
                yield from _by_document(held, bits)
                held = []
        yield from _by_document(held, bits)

    return run


def _matches(r: np.ndarray, dst: np.ndarray, src: np.ndarray) -> np.ndarray:
    m = np.zeros(len(dst), _MATCH)
    m["d"], m["tag"], m["pos"] = r["d"][dst], r["tag"][dst], r["pos"][dst]
    m["s"], m["stag"], m["spos"] = r["d"][src], r["tag"][src], r["pos"][src]
    return m


def _by_document(held: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    m = np.concatenate(held) if held else np.zeros(0, _MATCH)
    if len(m):
        m = m[np.lexsort((m["s"], m["d"]))]
        yield _blobs(1, m, (K.mix(m["d"].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), bits, {})


def anchored(m: np.ndarray) -> np.ndarray:
    """The anchors of matches: d, tag, s, stag, x, y and n, places and number of seeds, in order."""
    further = m[m["spos"] & PAIR > 0]
    further["pos"] += np.uint32(LATER)
    further["spos"] += np.uint32(LATER)
    m = np.concatenate((m, further))
    length = np.where(m["spos"] >= RUN, MIN_WORDS - SEED + 1, 1)
    y = (m["spos"] & ~(RUN | PAIR | CUT)).astype(np.int64)
    x = m["pos"].astype(np.int64)
    step = x - y
    order = np.lexsort((x, step, m["stag"], m["s"], m["tag"], m["d"]))
    m, x, y, step, end = m[order], x[order], y[order], step[order], (x + length)[order]
    new = np.ones(len(m), bool)
    new[1:] = step[1:] != step[:-1]
    for name in ("d", "tag", "s", "stag"):
        new[1:] |= m[name][1:] != m[name][:-1]
    # on one diagonal, what touches or overlaps is one anchor; ends are compared within their diagonal
    line = np.cumsum(new)
    base = line * np.int64(1 << 32)
    reach = np.maximum.accumulate(base + end)
    new[1:] |= (base + x)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    out = np.zeros(len(first), np.dtype([("d", "<i8"), ("tag", "<i8"), ("s", "<i8"), ("stag", "<i8"), ("x", "<i8"), ("y", "<i8"), ("n", "<i8")]))
    for name in ("d", "tag", "s", "stag"):
        out[name] = m[name][first]
    out["x"], out["y"] = x[first], y[first]
    out["n"] = (reach - base)[last] - x[first]
    return out[np.lexsort((out["y"], out["x"], out["stag"], out["s"], out["tag"], out["d"]))]


class Fenwick:
    """Prefix maxima with the place they came from."""

    def __init__(self, size: int) -> None:
        self.best = [(-1e18, -1)] * (size + 1)

    def raise_(self, at: int, value: float, place: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, place)
            at += at & -at

    def below(self, at: int) -> tuple[float, int]:
        """The best entry at a place smaller than `at`."""
        top = (-1e18, -1)
        while at > 0:
            top = max(top, self.best[at])
            at -= at & -at
        return top


def chains(x: list[int], y: list[int], n: list[int]) -> list[tuple[float, list[int]]]:
    """Disjoint chains of anchors (x, y, n), x ascending, best first: (score, places in order).

    An anchor follows another that ends, in seeds, before it starts in both documents. It adds
    the words that it covers, and each seed left out between the two costs GAP."""
    m = len(x)
    if m == 1:
        return [(float(n[0] + SEED - 1), [0])]
    ends = sorted({b + k for b, k in zip(y, n, strict=True)})
    rank = {v: i for i, v in enumerate(ends)}
    tree, open_ = Fenwick(len(ends)), []
    score, before = [0.0] * m, [-1] * m
    for i in range(m):
        while open_ and open_[0][0] <= x[i]:
            _, j = heapq.heappop(open_)
            tree.raise_(rank[y[j] + n[j]], score[j] + GAP * (x[j] + y[j] + 2 * n[j]), j)
        lo, hi = 0, len(ends)
        while lo < hi:  # ends up to y[i]
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= y[i] else (lo, mid)
        value, j = tree.below(lo)
        link = value - GAP * (x[i] + y[i])
        if link > 0:
            before[i] = j
        score[i] = n[i] + SEED - 1 + max(link, 0.0)
        heapq.heappush(open_, (x[i] + n[i], i))
    used, out = [False] * m, []
    for i in sorted(range(m), key=lambda k: -score[k]):
        if used[i]:
            continue
        path, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = before[at]
        out.append((score[i] - (score[at] if at >= 0 else 0.0), path[::-1]))
    return out


def _pieces(x: list[int], y: list[int], n: list[int], path: list[int]) -> Iterator[list[int]]:
    """A chain without its gaps of more than MOST_GAP words."""
    piece = path[:1]
    for i, j in zip(path[:-1], path[1:], strict=True):
        if max(x[j] - x[i] - n[i], y[j] - y[i] - n[i]) > MOST_GAP + SEED - 1:
            yield piece
            piece = []
        piece.append(j)
    yield piece


def stretches(m: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(d, tag, seeds) of the parts of documents that chains may span of which matches m do not have
    every source: places of seeds with a match, no two further apart than a chain allows, one of them CUT."""
    m = m[np.lexsort((m["pos"], m["tag"], m["d"]))]
    x = m["pos"].astype(np.int64)
    new = np.ones(len(m), bool)
    new[1:] = (np.diff(x) > MOST_GAP + SEED) | (m["d"][1:] != m["d"][:-1]) | (m["tag"][1:] != m["tag"][:-1])
    first, last, covers, span = _extents(x, new)
    open_ = np.logical_or.reduceat(m["spos"] & CUT > 0, first) & (covers >= LEAST) & (span + MARGIN >= MIN_WORDS)
    return [(int(m["d"][a]), int(m["tag"][a]), np.unique(x[a : b + 1])) for a, b in zip(first[open_].tolist(), last[open_].tolist(), strict=True)]


def _extents(x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending places of seeds in groups: first and last record, words covered and words from end to end."""
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    adds = np.full(len(x), SEED)
    adds[:-1] = np.where(new[1:], SEED, np.clip(np.diff(x), 0, SEED))
    return first, last, np.add.reduceat(adds, first), x[last] - x[first] + SEED


def _spot_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.list_(pa.int32())]
    out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SPOT.split(", ")])
    rows.clear()
    return out


def _chain(batches):
    """The chains of each document that cover words which no better chain that surely passes covers,
    and, with -1 words that match, the stretches that have more such words and may have other sources.
    Those come with the number of their seeds, their places, and what chains cover that surely pass."""
    rows: list[tuple] = []
    for m in _parts(batches, _MATCH, {}):
        covers: Covers = {}
        _chained(anchored(m), rows, covers)
        for d, tag, x in stretches(m):
            lo, hi, covered = int(x[0]), int(x[-1]) + SEED, covers.get((d, tag), [])
            if _fresh(lo, hi, covered) > MARGIN:
                rows.append((d, tag, 0, 0, lo, hi, 0, 0, -1, [len(x), *x.tolist(), *(v for r in covered for v in r)]))
        if len(rows) >= 1000:
            yield _spot_batch(rows)
    if rows:
        yield _spot_batch(rows)


def _fresh(lo: int, hi: int, covered: list[tuple[int, int]]) -> int:
    return hi - lo - sum(max(0, min(hi, b) - max(lo, a)) for a, b in covered)


Covers = dict[tuple[int, int], list[tuple[int, int]]]


def _chained(m: np.ndarray, rows: list[tuple], covers: Covers) -> None:
    """Adds the chains of anchors m to rows, and to covers what those of a document cover that surely pass."""
    doc = np.concatenate(([True], (m["d"][1:] != m["d"][:-1]) | (m["tag"][1:] != m["tag"][:-1])))
    pair = doc | np.concatenate(([True], (m["s"][1:] != m["s"][:-1]) | (m["stag"][1:] != m["stag"][:-1])))
    start = np.flatnonzero(pair)
    cut = np.append(start, len(m))
    # seeds that reach far enough, together with what alignment may add at the ends
    reach = np.maximum.reduceat(m["x"] + m["n"], start) - m["x"][start] + SEED - 1 + MARGIN >= MIN_WORDS
    reach &= np.add.reduceat(m["n"] + SEED - 1, start) >= LEAST
    whose = np.cumsum(doc)[start]
    xs, ys, ns = (m[c].tolist() for c in ("x", "y", "n"))
    pending: list[tuple] = []

    def settle() -> None:
        covered = covers.get(pending[0][:2], []) if pending else []  # by chains that pass whatever their ends align to
        for spot in sorted(pending, key=lambda p: (-p[8], p[2], p[3], p[4])):
            if _fresh(spot[4], spot[5], covered) > MARGIN:
                if _passes(spot):
                    covered = _joined(covered, spot[4], spot[5])
                rows.append(spot)
        if covered:
            covers[pending[0][:2]] = covered
        pending.clear()

    own = -1
    for g in np.flatnonzero(reach).tolist():
        if whose[g] != own:
            settle()
            own = whose[g]
        a, b = cut[g], cut[g + 1]
        x, y, n = xs[a:b], ys[a:b], ns[a:b]
        who = tuple(int(m[c][a]) for c in ("d", "tag", "s", "stag"))
        for _, path in chains(x, y, n):
            for piece in _pieces(x, y, n, path):
                lo, slo = x[piece[0]], y[piece[0]]
                hi, shi = (v[piece[-1]] + n[piece[-1]] + SEED - 1 for v in (x, y))
                if hi - lo + MARGIN < MIN_WORDS:
                    continue
                matched, flat, end, send = 0, [], 0, 0
                for i in piece:
                    size = n[i] + SEED - 1
                    matched += size - max(0, end - x[i], send - y[i])
                    end, send = x[i] + size, y[i] + size
                    flat += [x[i] - lo, y[i] - slo, size]
                if matched < LEAST:
                    continue
                pending.append((*who, lo, hi, slo, shi, matched, flat))
    settle()


def _numbers(r: np.ndarray) -> np.ndarray:
    """For each record how many places of its document have its seed before."""
    order = np.lexsort((r["pos"], r["tag"], r["d"], r["hash"]))
    g = Grouped(r, order, ("hash",))
    out = np.zeros(len(r), np.uint32)
    out[order] = np.arange(len(r)) - g.doc_start[g.doc]
    return out


def _records(d: np.ndarray, tag: np.ndarray, buf: np.ndarray, off: np.ndarray, seen: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Seeds of documents; seen: only those of which the filter has the bit."""
    for i, j in K.chunks(off):
        part = K.lower_ascii(buf[off[i] : off[j]])
        s, e, rows = K.words(part, off[i : j + 1] - off[i])
        x, row, pos = seeds(K.word_hashes(part, s, e), rows, j - i)
        if seen is not None:
            bit = x >> np.uint64(64 - FILTER)
            ok = seen[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0
            x, row, pos = x[ok], row[ok], pos[ok]
        r = np.zeros(len(x), _REST)
        r["hash"], r["d"], r["tag"], r["pos"] = x, d[row + i], tag[row + i], pos
        r["k"] = _numbers(r)
        yield r


def _rest_seeds(batches):
    """In: d, tag, text and the stretches of a document (numbers and places of seeds). Out: packed seeds of the stretches."""
    for batch in batches:
        buf, off = K.buffer_of(batch.column(2))
        d, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        lists = batch.column(3).to_pylist()
        own = [np.concatenate([np.array(x[1 : x[0] + 1], np.int64) for x in some]) for some in lists]
        covers = [(int(d[i]), int(tag[i]), *some[0][k : k + 2]) for i, some in enumerate(lists) for k in range(some[0][0] + 1, len(some[0]), 2)]
        held = []
        for i in range(batch.num_rows):
            r = np.concatenate(list(_records(d[i : i + 1], tag[i : i + 1], buf[off[i] : off[i + 1]], off[i : i + 2] - off[i])))
            held.append(r[np.isin(r["pos"], own[i])])
        sizes = [len(r) for r in held]
        blobs = [pa.array([x], pa.binary()) for x in (_packed(np.concatenate(held), {}), np.array(covers, np.int64).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)], pa.int64()), *blobs], ["n", "records", "covers"])


def _bits(batches):
    """The words of the filter that packed seeds set bits in, and the bits."""
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            bit = np.unique(_unpacked(blob, _REST, {})["hash"] >> np.uint64(64 - FILTER)).astype(np.int64)
            word = bit >> 5
            at = np.flatnonzero(np.diff(word, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(word[at].astype(np.int32)), pa.array(np.bitwise_or.reduceat(np.int64(1) << (bit & 31), at))], ["word", "mask"])


def _sources(seen: np.ndarray, slices: int):
    """Packed seeds of which the filter has the bit, by slices of the documents."""

    def run(batches):
        for batch in batches:
            buf, off = K.buffer_of(batch.column(2))
            d, tag = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            found = list(_records(d, tag, buf, off, seen))
            r = np.concatenate(found) if found else np.zeros(0, _REST)
            to = (K.mix(r["d"].astype(np.uint64)) % np.uint64(slices)).astype(np.int64)
            for p in np.unique(to).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(r[to == p], {})], pa.binary())], ["slice", "records"])

    return run


def _meet(batches):
    """Rows (part, kind, records) by part and kind, seeds of stretches (0) before those of sources (1). Chains of every
    stretch with every earlier document."""
    rows: list[tuple] = []
    part, rest, sources, sorted_ = -1, [], [], None
    covers: Covers = {}

    def meet() -> None:
        nonlocal sorted_, sources
        if rest and sources:
            if sorted_ is None:
                sorted_ = Stretches(np.concatenate(rest), covers)
            sorted_.meet(np.concatenate(sources), rows)
        sources = []

    for batch in batches:
        for p, kind, blob, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                meet()
                part, rest, sorted_, covers = p, [], None, {}
            for d, tag, lo, hi in np.frombuffer(known or b"", np.int64).reshape(-1, 4).tolist():
                covers.setdefault((d, tag), []).append((lo, hi))
            (sources if kind else rest).append(_unpacked(blob, _REST, {}))
            if sum(map(len, sources)) >= BLOCK:
                meet()
            if len(rows) >= 1000:
                yield _spot_batch(rows)
    meet()
    if rows:
        yield _spot_batch(rows)


class Stretches:
    """Seeds of stretches by hash, number of the place in the document, and document.
    number: that of a seed's stretch; doc: that of its document. covers: what chains of the documents
    cover that surely pass; stretches that have no more than MARGIN words besides need no other source."""

    def __init__(self, r: np.ndarray, covers: Covers) -> None:
        self.covers = covers
        r = r[np.lexsort((r["pos"], r["tag"], r["d"]))]
        x = r["pos"].astype(np.int64)
        other = np.ones(len(r), bool)
        other[1:] = (r["d"][1:] != r["d"][:-1]) | (r["tag"][1:] != r["tag"][:-1])
        new = other.copy()
        new[1:] |= np.abs(np.diff(x)) > MOST_GAP + SEED
        self.docs = r[["d", "tag"]][other]
        last = np.append(np.flatnonzero(new)[1:], len(r)) - 1
        self.spans = [(int(r["d"][k]), int(r["tag"][k]), int(x[a]), int(x[k]) + SEED) for a, k in zip(np.flatnonzero(new).tolist(), last.tolist(), strict=True)]
        self.closed = np.zeros(len(self.spans), bool)
        self.of: dict[tuple[int, int], list[int]] = {}
        for k, span in enumerate(self.spans):
            self.of.setdefault(span[:2], []).append(k)
        self.start, number, doc = np.flatnonzero(new), np.cumsum(new) - 1, np.cumsum(other) - 1
        self.where = number
        self.window = np.searchsorted(number * np.int64(1 << 33) + x, number * np.int64(1 << 33) + x + MIN_WORDS - MARGIN - SEED)
        self.order = np.lexsort((doc, r["k"], r["hash"]))
        self.r, self.number, self.doc = r[self.order], number[self.order], doc[self.order]
        h = self.r["hash"]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        self.hashes, self.ends = h[first], np.append(np.flatnonzero(first), len(h))
        self.most = np.uint32((1 << 21) - 1)
        self.key = self._key(np.cumsum(first) - 1, self.r["k"], self.doc)

    def _key(self, h: np.ndarray, k: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return (h.astype(np.int64) << 42) | (np.minimum(k, self.most).astype(np.int64) << 21) | doc

    def meet(self, c: np.ndarray, rows: list[tuple]) -> None:
        """Adds the chains with the documents whose seeds are c. A seed's place there meets the places of the same
        number (the last, of that and of higher numbers), the first place meets all (see `Grouped.pairs`)."""
        h = np.minimum(np.searchsorted(self.hashes, c["hash"]), len(self.hashes) - 1)
        some = self.hashes[h] == c["hash"]
        c = c[some]
        if not len(c):
            return
        order = np.lexsort((c["pos"], c["tag"], c["d"]))
        c, h = c[order], h[some][order]
        new = np.concatenate(([True], (c["d"][1:] != c["d"][:-1]) | (c["tag"][1:] != c["tag"][:-1])))
        doc, cut = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(c))
        # documents of stretches up to this one
        both = np.concatenate((self.docs, c[["d", "tag"]][new]))
        theirs = np.arange(len(both)) >= len(self.docs)
        order = np.lexsort((theirs, both["tag"], both["d"]))
        before = np.zeros(len(both), np.int64)
        before[order] = np.cumsum(~theirs[order])
        before = before[len(self.docs) :][doc]
        last = np.zeros(len(c), bool)
        order = np.lexsort((c["k"], h, doc))
        last[order] = np.concatenate(((np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0), [True]))
        lo = np.searchsorted(self.key, self._key(h, c["k"], before))
        end = np.searchsorted(self.key, self._key(h, c["k"], 0) + (1 << 21))
        n = end - lo
        # places of higher numbers, of all documents: seldom any
        more = np.where(last | (c["k"] == 0), self.ends[h + 1] - end, 0)
        hits = np.concatenate(([0], np.cumsum(n + more)))[cut]
        wide, i = max(1, HITS // len(self.start)), 0
        while i < len(cut) - 1:
            j = min(max(i + 1, int(np.searchsorted(hits, hits[i] + HITS, "right")) - 1), i + wide, len(cut) - 1)
            if hits[j] > hits[i]:
                at = slice(cut[i], cut[j])
                self._meet(c[at], lo[at], n[at], end[at], more[at], before[at], doc[at] - doc[cut[i]], rows)
            i = j

    def _meet(self, c: np.ndarray, lo: np.ndarray, n: np.ndarray, end: np.ndarray, more: np.ndarray, before: np.ndarray, doc: np.ndarray, rows: list[tuple]) -> None:
        """A chain spans more words than a window of MIN_WORDS - MARGIN - 1, and has three seeds at least. So of each stretch
        the window with most hits is set apart, and pairs that meet nowhere else or less than three times are dropped."""
        per = np.zeros(len(self.r) + 1, np.int64)
        for a, k in ((lo, n), (end, more)):
            per += np.bincount(a, k > 0, len(per)).astype(np.int64) - np.bincount(a + k, k > 0, len(per)).astype(np.int64)
        hit = np.zeros(len(self.r), np.int64)
        hit[self.order] = np.cumsum(per)[:-1]  # by document and place
        total = np.concatenate(([0], np.cumsum(hit)))
        sums = total[self.window] - total[:-1]
        top = np.flatnonzero(sums == np.maximum.reduceat(sums, self.start)[self.where])
        top = top[np.flatnonzero(np.diff(self.where[top], prepend=-1))]  # the first of each stretch
        place = np.arange(len(self.r))
        outside = ((place < top[self.where]) | (place >= self.window[top][self.where]))[self.order]

        docs = int(doc[-1]) + 1
        size = len(self.start) * docs
        seen, apart, steps, total = np.zeros(size, np.int32), np.zeros(size, bool), [0], np.cumsum(n + more)
        while steps[-1] < len(c):
            steps.append(max(steps[-1] + 1, int(np.searchsorted(total, (total[steps[-1] - 1] if steps[-1] else 0) + HITS, "right"))))

        def hits(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = []
            for at, k in ((lo[a:b], n[a:b]), (end[a:b], more[a:b])):
                src = np.repeat(np.arange(a, a + len(k)), k)
                dst = np.arange(len(src)) + np.repeat(at - (np.cumsum(k) - k), k)
                if found:
                    ok = self.doc[dst] >= before[src]
                    src, dst = src[ok], dst[ok]
                found.append((src, dst))
            src, dst = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found[1][0]) else found[0]
            return src, dst, self.number[dst] * docs + doc[src]

        for a, b in zip(steps[:-1], steps[1:], strict=True):
            src, dst, pair = hits(a, b)
            seen += np.bincount(pair, minlength=size).astype(np.int32)
            apart[pair[outside[dst]]] = True
        good = apart & (seen >= -(-LEAST // SEED))
        good.reshape(-1, docs)[self.closed] = False
        if not good.any():
            return
        found = []
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            if len(steps) > 2:
                src, dst, pair = hits(a, b)
            ok = good[pair]
            found.append((src[ok], dst[ok], pair[ok]))
        src, dst, pair = (np.concatenate(x) for x in zip(*found, strict=True))
        x = self.r["pos"][dst].astype(np.int64)
        order = np.argsort((pair << 32) | x)
        src, dst, pair, x = src[order], dst[order], pair[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (np.diff(x) > MOST_GAP + SEED)
        ok = _may_chain(x, new)
        if ok.any():
            src, dst = src[ok], dst[ok]
            m = np.zeros(len(src), _MATCH)
            m["d"], m["tag"], m["pos"] = self.r["d"][dst], self.r["tag"][dst], self.r["pos"][dst]
            m["s"], m["stag"], m["spos"] = c["d"][src], c["tag"][src], c["pos"][src]
            m = _near(anchored(m), self.covers)
            if len(m):
                made = len(rows)
                _chained(m, rows, self.covers)
                for who in {row[:2] for row in rows[made:]}:
                    for k in self.of[who]:
                        self.closed[k] = _fresh(*self.spans[k][2:], self.covers.get(who, [])) <= MARGIN


def _may_chain(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    first, last, covers, span = _extents(x, new)
    return np.repeat((covers >= LEAST) & (span + MARGIN >= MIN_WORDS), last - first + 1)


def _near(m: np.ndarray, covers: Covers) -> np.ndarray:
    """Anchors without those of no new passage's chain: anchors that are as near to one another as in a chain,
    directly or by others, have too few words, do not reach far enough or are covered."""
    x, y, n = m["x"], m["y"], m["n"]
    same = np.zeros(len(m), np.int64)
    same[1:] = np.cumsum(np.logical_or.reduce([m[name][1:] != m[name][:-1] for name in ("d", "tag", "s", "stag")]))
    place = (same << 33) + x
    lo = np.searchsorted(place, place + n)
    most = np.searchsorted(place, place + n + MOST_GAP + SEED - 1, "right") - lo
    group, step, links = np.arange(len(m)), 0, []
    at = np.flatnonzero(most > 0)
    while len(at):
        to = lo[at] + step
        gap = y[to] - y[at] - n[at]
        ok = (gap >= 0) & (gap <= MOST_GAP + SEED - 1)
        links.append((at[ok], to[ok]))
        step += 1
        at = at[most[at] > step]
    a, b = (np.concatenate(v) for v in zip(*links, strict=True)) if links else (group[:0], group[:0])
    while True:  # the smallest anchor of each group
        low = np.minimum(group[a], group[b])
        after = group.copy()
        np.minimum.at(after, group[a], low)
        np.minimum.at(after, group[b], low)
        after = after[after]
        if (after == group).all():
            break
        group = after
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    if not len(first):
        return m
    begin, end = np.minimum.reduceat(x[order], first), np.maximum.reduceat((x + n)[order], first) + SEED - 1
    reach = (end - begin + MARGIN >= MIN_WORDS) & (np.add.reduceat((n + SEED - 1)[order], first) >= LEAST)
    d, tag = m["d"][order[first]], m["tag"][order[first]]
    for k in np.flatnonzero(reach).tolist():
        known = covers.get((int(d[k]), int(tag[k])))
        if known and _fresh(int(begin[k]), int(end[k]), known) <= MARGIN:
            reach[k] = False
    keep = np.zeros(len(m), bool)
    keep[order] = np.repeat(reach, np.diff(np.append(first, len(m))))
    return m[keep]


def _unlike(batches):
    """Of the chains of each document, best first, those that cover words which none covers that surely passes; stretches, which come before, tell what is covered."""
    doc, covered = None, []
    for batch in batches:
        keep = []
        names = ("d", "tag", "lo", "hi", "slo", "shi", "matched", "anchors")
        for d, tag, lo, hi, slo, shi, matched, flat in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
            if doc != (d, tag):
                doc, covered = (d, tag), []
            if matched < 0:
                covered = list(zip(flat[flat[0] + 1 :: 2], flat[flat[0] + 2 :: 2], strict=True))
            keep.append(matched >= 0 and _fresh(lo, hi, covered) > MARGIN)
            if keep[-1] and _passes((d, tag, 0, 0, lo, hi, slo, shi, matched)):
                covered = _joined(covered, lo, hi)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _others(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """Chains of stretches (see `_chain`) with all earlier documents, however many have their seeds. Exact: seeds of
    stretches, in blocks, meet those of all documents, in slices, so the work grows with the product of both."""
    spark = texts.sparkSession
    own = rest.groupBy("d", "tag").agg(F.collect_list("anchors").alias("stretches")).hint("merge").join(texts, ["d", "tag"])
    wanted = store(own.select("d", "tag", "text", "stretches").mapInArrow(_rest_seeds, "n long, records binary, covers binary").withColumn("at", F.monotonically_increasing_id()), "chain-rest")
    words = wanted.select("n", "records").mapInArrow(_bits, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    seen = np.zeros(1 << (FILTER - 5), np.uint32)
    seen[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    blocks = -(-int(wanted.agg(F.sum("n")).first()[0]) // BLOCK)
    slices = max(1, parts(spark) // (2 * blocks))
    block = F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")
    theirs = texts.select("d", "tag", "text").mapInArrow(_sources(seen, slices), "slice int, records binary")
    ours = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), block.alias("block"), F.lit(0).alias("kind"), "records", "covers")
    theirs = theirs.select("slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "records", F.lit(None).cast("binary").alias("covers"))
    both = ours.unionByName(theirs).select((F.col("block") * slices + F.col("slice")).alias("part"), "kind", "records", "covers")
    found = both.repartitionById(blocks * slices, "part").sortWithinPartitions("part", "kind").mapInArrow(_meet, _SPOT)
    found = rest.drop("spot").unionByName(found).repartition(parts(spark), "d", "tag")
    found = found.sortWithinPartitions("d", "tag", F.col("matched") >= 0, F.desc("matched"), "s", "stag", "lo").mapInArrow(_unlike, _SPOT)
    return store(found.withColumn("spot", -1 - F.monotonically_increasing_id()), "chain-others")


def _passes(spot: tuple) -> bool:
    """Whether the anchors of a chain alone make it a passage: then it holds one, whatever its ends align to."""
    return spot[8] >= MIN_WORDS and 100 * spot[8] >= PERCENT * max(spot[5] - spot[4], spot[7] - spot[6])


def _joined(covered: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Disjoint ranges with one more range."""
    out = []
    for a, b in covered:
        if b < lo or a > hi:
            out.append((a, b))
        else:
            lo, hi = min(a, lo), max(b, hi)
    return [*out, (lo, hi)]


def _pairs(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; neither side has more than MOST_GAP words, or the other has none."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list[bytes], b: list[bytes], left: int, sleft: int, anchors: list[tuple[int, int, int]]) -> np.ndarray:
    """Two word lists aligned along a chain: (place in a, place in b) of each matched word.

    left, sleft: words before the chain starts; anchors: (place, place, words) from there on.
    Between anchors the longest common subsequence counts; at both ends the alignment goes
    on while words agree, over at most one differing word at a time."""
    i, j = left + anchors[0][0], sleft + anchors[0][1]
    start = _outwards(a[i - 1 :: -1] if i else [], b[j - 1 :: -1] if j else [])
    found = [(i - k, j - k) for k in range(start, 0, -1) if a[i - k] == b[j - k]]
    for p, q, size in anchors:
        p, q = left + p, sleft + q
        over = max(0, i - p, j - q)  # overlaps the anchor before
        if not over:
            found += [(i + u, j + v) for u, v in _pairs(a[i:p], b[j:q])] if p > i and q > j else []
        p, q, size = p + over, q + over, size - over
        found += [(p + k, q + k) for k in range(size) if a[p + k] == b[q + k]]
        if size > 0:
            i, j = p + size, q + size
    end = _outwards(a[i:], b[j:])
    found += [(i + k, j + k) for k in range(end) if a[i + k] == b[j + k]]
    return np.array(found, np.int64).reshape(-1, 2)


def split(found: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The passages within an alignment (see `aligned`), longest first: (from, to) in each and the number of
    matched words. Of an alignment that matches PERCENT of both sides that is the whole."""
    x, y = found.T
    count = 100 * np.arange(len(x))
    f, g = count - PERCENT * x + 100 - PERCENT, count - PERCENT * y + 100 - PERCENT
    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n < MIN_WORDS:
            continue
        # The passage from word u to word v needs f[v] >= f[u] - 100 + PERCENT, and the same of g. The last
        # v that each condition allows alone bounds the length; starts are tried from the highest bound on.
        most = np.full(n, hi)
        for z in (f[lo:hi], g[lo:hi]):
            after = np.maximum.accumulate(z[::-1])  # ascending: the maximum of the last 1, 2, ... entries
            most = np.minimum(most, hi - np.searchsorted(after, z - 100 + PERCENT, "left"))
        bound = most - lo - np.arange(n)
        size, at = 0, lo
        for u in np.argsort(-bound, kind="stable"):
            if bound[u] <= max(size, MIN_WORDS - 1):
                break
            u = int(u) + lo
            v = u + max(size, MIN_WORDS - 1)  # only what is longer than the best so far
            ok = np.flatnonzero((f[v : most[u - lo]] >= f[u] - 100 + PERCENT) & (g[v : most[u - lo]] >= g[u] - 100 + PERCENT))
            if len(ok):
                size, at = v + int(ok[-1]) + 1 - u, u
        if size:
            to = at + size
            out.append((int(x[at]), int(x[to - 1]) + 1, int(y[at]), int(y[to - 1]) + 1, size))
            todo += [(lo, at), (to, hi)]
    return sorted(out, key=lambda r: -r[4])


def _outwards(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest start of both in which no two words in a row differ, without a differing end."""
    at = 0
    for k, (w, v) in enumerate(zip(a, b, strict=False), 1):
        if w == v:
            at = k
        elif k - at > 1:
            break
    return at


_CASE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _slices(batches):
    """In: text, then a list of (spot, lo, hi). Out: the words of each spot and MARGIN words around it."""
    for batch in batches:
        spots, texts = [], []
        buf, off = K.buffer_of(batch.column(0))
        for i, wanted in enumerate(batch.column(1).to_pylist()):
            part = buf[off[i] : off[i + 1]]
            start, end, _ = K.words(part, np.array([0, len(part)]))
            raw = part.tobytes().translate(_CASE)
            for x in wanted:
                spots.append(x["spot"])
                texts.append(raw[start[max(x["lo"] - MARGIN, 0)] : end[min(x["hi"] + MARGIN, len(end)) - 1]])
        yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int64()), pa.array(texts, pa.binary())], ["spot", "words"])


def _align(batches):
    """In: d, tag, s, lo, slo, anchors, then the words around the passage in the document and in the source."""
    names = ["d", "tag", "s", "start", "end", "source_start", "source_end", "matched"]
    for batch in batches:
        rows = []
        for d, tag, s, lo, slo, flat, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            left, sleft = min(lo, MARGIN), min(slo, MARGIN)
            found = aligned(a.split(), b.split(), left, sleft, list(zip(flat[::3], flat[1::3], flat[2::3], strict=True)))
            for i, j, p, q, matched in split(found):
                rows.append((d, tag, s, lo - left + i, lo - left + j, slo - sleft + p, slo - sleft + q, matched))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _settle(batches):
    """Of the passages of each document, best first, those that cover words which no better one covers."""
    doc, covered = None, []
    for batch in batches:
        keep = []
        for d, tag, lo, hi in zip(*(batch.column(name).to_pylist() for name in ("d", "tag", "start", "end")), strict=True):
            if doc != (d, tag):
                doc, covered = (d, tag), []
            fresh = hi - lo - sum(max(0, min(hi, b) - max(lo, a)) for a, b in covered)
            keep.append(fresh > MARGIN)
            if keep[-1]:
                covered = _joined(covered, lo, hi)
        yield batch.filter(pa.array(keep, pa.bool_()))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words) of each passage, and where its words come from:
    source_doc_id, source_start, source_end; matched: the number of words that agree."""
    spark = docs.sparkSession
    d, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    texts = docs.select(d.alias("d"), "text")
    again = texts.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    repeats = again.limit(REPEATED_IDS + 1).count()
    if repeats <= REPEATED_IDS:  # of other rows the id says all
        again = F.broadcast(again.withColumn("again", F.lit(True)))
        texts = texts.join(again, "d", "left").select("d", F.when(F.col("again"), tag).otherwise(F.lit(0).cast("long")).alias("tag"), "text")
    else:
        texts = texts.select("d", tag.alias("tag"), "text")
    n, bits = parts(spark), part_bits(spark)
    found = texts.mapInArrow(_find(bits), _ROW).repartition(n, "part").sortWithinPartitions("part").mapInArrow(_match(bits), _ROW)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the files of both shuffles go when the spots are stored
    try:
        found = found.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_chain, _SPOT)
        spots = store(found.withColumn("spot", F.monotonically_increasing_id()), "chain-spots")
        rest, spots = spots.where("matched < 0"), spots.where("matched >= 0")
        if not rest.isEmpty():
            spots = spots.unionByName(_others(texts.dropDuplicates(["d", "tag"]) if repeats else texts, rest))
    finally:
        spark.conf.set(_CLEANUP, before)
    # Texts move once for their own passages and once for every PER_SOURCE of those that copy them; slices meet by spot.
    cut = "spot long, words binary"
    at = lambda lo, hi: F.collect_list(F.struct("spot", F.col(lo).alias("lo"), F.col(hi).alias("hi"))).alias("spots")
    load = spots.groupBy("s", "stag").agg(F.ceil(F.count("*") / PER_SOURCE).alias("heaps"))
    dealt = spots.join(load, ["s", "stag"]).withColumn("heap", F.pmod(F.xxhash64("spot"), F.col("heaps")))
    wanted = dealt.groupBy("s", "stag", "heap").agg(at("slo", "shi"))
    if repeats:
        texts = texts.dropDuplicates(["d", "tag"])
    own = spots.groupBy("d", "tag").agg(at("lo", "hi")).hint("merge").join(texts, ["d", "tag"]).select("text", "spots").mapInArrow(_slices, cut)
    source = texts.select(F.col("d").alias("s"), F.col("tag").alias("stag"), "text")
    theirs = wanted.hint("merge").join(source, ["s", "stag"]).select("text", "spots").mapInArrow(_slices, cut)
    both = spots.select("spot", "d", "tag", "s", "lo", "slo", "anchors").join(own, "spot").join(theirs.withColumnRenamed("words", "swords"), "spot").drop("spot")
    kind = "d long, tag long, s long, start long, end long, source_start long, source_end long, matched long"
    rows = both.mapInArrow(_align, kind).repartition(n, "d", "tag")
    rows = rows.sortWithinPartitions("d", "tag", F.desc("matched"), "s", "start", "end", "source_start", "source_end").mapInArrow(_settle, kind)
    null = F.lit(NULL_ID)
    return rows.select(F.nullif("d", null).alias("doc_id"), "start", "end", F.nullif("s", null).alias("source_doc_id"), "source_start", "source_end", "matched")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
