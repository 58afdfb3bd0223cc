"""Exact substring dedup: every byte of a string that also starts earlier goes.

A string of LENGTH bytes counts if it also starts earlier: in a document of smaller
id, or before in the same one.  Strings overlap freely and are judged on the input.

1. Each window of LENGTH bytes is known by its anchor, the K-byte string in it with
   the smallest hash, so equal windows have equal anchors.  A run is a maximal
   stretch of windows with one anchor occurrence.  Runs travel as packed records by
   anchor; runs whose anchor occurs once hold nothing that repeats, and of runs with
   equal text all but the first repeat whole.
2. What is left to decide, the first runs of texts that differ around one anchor,
   is sorted by anchor into shards; each shard is suffix-sorted by induction (see
   induced), and of the windows whose suffixes share LENGTH bytes all but the
   first repeat.
3. The repeated stretches of a document are united and cut out.

Texts are UTF-8 bytes; a null text is empty.  Repeat rows (equal id and text) are one
document, and each gets its result.  Rows that share an id but not a text are
ordered by a hash of the text.  A null id comes after all others.  Runs are told
apart by 64-bit hashes of anchors and texts together.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .base import parts, store, table
from .induced import common, suffix_array

LENGTH, ANCHOR = 100, 24
PARTS = 1024
#: A shard is sorted in blocks of about this many bytes, cut between anchors.
BLOCK = 1 << 21
NULL_ID = (1 << 63) - 1
_FIELDS = (("anchor", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("windows", "u1"))
_RUN = "d long, tag long, start long, windows int, anchor long"


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive entries."""
    span = 1
    out = x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(x) - width + 1
    return out[:n] if span == width else np.minimum(out[:n], out[width - span : width - span + n])


def runs_of(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Rows, first windows, numbers of windows, anchor hashes and text hashes of all runs."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(buf)
    if n < length:
        return empty
    roll = K.Rolling(K.byte_values(buf))
    at = np.arange(n - k + 1)
    h = roll.ranges(at, at + k)
    low = np.uint64(max(1, int(n).bit_length()))
    # ties in the leading bits go to the leftmost, which depends on the window alone
    best = _minima((h >> low << low) | at.astype(np.uint64), length - k + 1)
    where = (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    size = np.maximum(np.diff(off) - length + 1, 0)
    rows = np.repeat(np.arange(len(off) - 1), size)
    starts = np.repeat(off[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    if not len(starts):
        return empty
    where = where[starts]
    new = np.concatenate(([True], (where[1:] != where[:-1]) | (rows[1:] != rows[:-1])))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    return rows[first], begin - off[:-1][rows[first]], many, h[where[first]], roll.ranges(begin, begin + many + length - 1)


def _firsts(r: np.ndarray) -> np.ndarray:
    """Which of the runs, in the order of (anchor, text, doc, tag, start), is the first of its anchor and text."""
    return np.concatenate(([True], (r["anchor"][1:] != r["anchor"][:-1]) | (r["text"][1:] != r["text"][:-1])))


def _ordered(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((r["start"], r["tag"], r["doc"], r["text"], r["anchor"]))
    r = {name: r[name][order] for name, _ in _FIELDS}
    same = np.ones(max(len(order) - 1, 0), bool)
    for name in ("anchor", "text", "doc", "tag", "start"):
        same &= r[name][1:] == r[name][:-1]
    once = np.concatenate((np.ones(min(len(order), 1), bool), ~same))  # repeat rows are one document
    return {name: x[once] for name, x in r.items()}


def _as_rows(r: dict[str, np.ndarray], pick: np.ndarray, anchor: bool) -> list[pa.Array]:
    n = int(pick.sum())
    named = pa.array(r["anchor"][pick].view(np.int64)) if anchor else pa.nulls(n, pa.int64())
    return [pa.array(r["doc"][pick]), pa.array(r["tag"][pick].astype(np.int64)), pa.array(r["start"][pick].astype(np.int64)), pa.array(r["windows"][pick].astype(np.int32)), named]


def _planes(x: np.ndarray) -> bytes:
    """The first byte of every value, then the second of every value, and so on: bytes that
    are alike stand together, which is what the compression of shuffles and files needs."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _pack(batches):
    """Rows of runs that repeat an earlier one of the batch, and rows of packed runs by part."""
    names = ["part", "records", "d", "tag", "start", "windows", "anchor"]
    for batch in batches:
        buf, off = K.buffer_of(batch.column(2))
        doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tag = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
        found: list[tuple] = []
        for i, j in K.chunks(off):
            rows, start, many, anchor, text = runs_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            found.append((anchor, text, doc[rows + i], tag[rows + i], start.astype(np.uint32), many.astype(np.uint8)))
        if not found:
            continue
        r = _ordered(dict(zip([n for n, _ in _FIELDS], map(np.concatenate, zip(*found, strict=True)), strict=True)))
        if not len(r["doc"]):
            continue
        first = _firsts(r)
        if not first.all():
            n = int((~first).sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *_as_rows(r, ~first, False)], names)
        r = {name: x[first] for name, x in r.items()}
        to = r["anchor"] >> np.uint64(54)  # 10 bits: PARTS
        edge = np.searchsorted(to, np.arange(PARTS + 1, dtype=np.uint64))  # runs are in the order of anchors
        used = np.flatnonzero(np.diff(edge))
        packed = [b"".join(_planes(r[name][edge[p] : edge[p + 1]].astype(kind)) for name, kind in _FIELDS) for p in used]
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(packed, pa.binary()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names
        )


_WIDTH = sum(np.dtype(kind).itemsize for _, kind in _FIELDS)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n, at, out = len(blob) // _WIDTH, 0, []
    for _, kind in _FIELDS:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * size
    return out


def _decide(batches):
    """Of the runs of each part: the repeats (no anchor), and those to be sorted (with their anchor)."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(part, []).append(blob)
    for part in list(held):
        columns = zip(*map(_unpacked, held.pop(part)), strict=True)
        r = _ordered(dict(zip([n for n, _ in _FIELDS], map(np.concatenate, columns), strict=True)))
        first = _firsts(r)
        group = np.cumsum(np.concatenate(([True], r["anchor"][1:] != r["anchor"][:-1]))) - 1
        open_ = first & (np.bincount(group, weights=first)[group] > 1)
        for pick, anchor in ((~first, False), (open_, True)):
            yield pa.RecordBatch.from_arrays(_as_rows(r, pick, anchor), ["d", "tag", "start", "windows", "anchor"])


def _snippets(batches):
    """The text of each run to be sorted. In: d, tag, text, list of (start, windows, anchor)."""
    names = ["anchor", "d", "tag", "start", "snippet"]
    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
            runs = batch.column(3)[i].as_py()
            d, tag = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            cut = [text[x["start"] : x["start"] + x["windows"] + LENGTH - 1] for x in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["anchor"] for x in runs], pa.int64()), pa.array([d] * len(runs), pa.int64()), pa.array([tag] * len(runs), pa.int64()), pa.array([x["start"] for x in runs], pa.int64()), pa.array(cut, pa.binary())],
                names,
            )


def repeated(snippets: list[bytes], d: np.ndarray, tag: np.ndarray, start: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(snippet, offset) of each window that also starts earlier in another snippet.

    All suffixes of the shard are sorted; windows are neighbours in that order where
    they share `length` bytes, and the smallest (d, tag, position) is the first."""
    text = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    size = np.array([len(s) for s in snippets])
    begin = np.cumsum(size + 1) - size - 1
    symbol = text.astype(np.int16) + 1
    symbol[begin + size] = 0
    owner = np.repeat(np.arange(len(size)), size + 1)
    order = suffix_array(symbol)
    own = owner[order]
    offset = order - begin[own]
    window = offset <= size[own] - length
    order, own, offset = order[window], own[window], offset[window]
    if not len(order):
        return
    same = common(text, order[:-1], order[1:], length)
    group = np.cumsum(np.concatenate(([0], (~same).astype(np.int64))))
    many = np.bincount(group)[group] > 1
    order, own, offset, group = order[many], own[many], offset[many], group[many]
    rank = np.lexsort((start[own] + offset, tag[own], d[own], group))
    own, offset, group = own[rank], offset[rank], group[rank]
    later = np.concatenate((np.zeros(min(len(group), 1), bool), group[1:] == group[:-1]))
    yield from zip(own[later].tolist(), offset[later].tolist(), strict=True)


def _sort(batches):
    """Stretches (d, tag, start, end) of repeated windows; rows come in the order of anchors."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor, d, tag, start, cut = (list(x) for x in zip(*rows, strict=True))
        d, tag, start = (np.array(x, np.int64) for x in (d, tag, start))
        hits = np.array(sorted(repeated(cut, d, tag, start)), np.int64).reshape(-1, 2)
        new = np.concatenate((np.ones(min(len(hits), 1), bool), (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hits)) - 1
        own = hits[first, 0]
        a, b = start[own] + hits[first, 1], start[own] + hits[last, 1] + LENGTH
        return pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(tag[own]), pa.array(a), pa.array(b)], ["d", "tag", "start", "end"])

    held, bytes_ = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bytes_ >= BLOCK and row[0] != held[-1][0]:
                yield solve(held)
                held, bytes_ = [], 0
            held.append(row)
            bytes_ += len(row[4])
    if held:
        yield solve(held)


def united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches):
    """In: doc_id, text, list of (start, end). Out: doc_id, n_bytes, spans, kept."""
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans = united([(x["start"], x["end"]) for x in found or []])
            edges = [0, *(x for s in spans for x in s), len(raw)]
            rows.append((len(raw), spans, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
        spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each maximal removed stretch of bytes) and
    kept (the bytes that are left), one row per row of docs."""
    spark = docs.sparkSession
    d, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    texts = docs.select(d.alias("d"), tag.alias("tag"), "text")
    packed = store(texts.mapInArrow(_pack, f"part int, records binary, {_RUN}"), "suffix-runs", scanned=True)
    dealt = packed.where("part is not null").select("part", "records").repartition(parts(spark), "part")
    decided = store(dealt.mapInArrow(_decide, _RUN), "suffix-decided")
    # Both joins below read the same exchange of (d, tag, text), so whole texts move once.
    wanted = decided.where("anchor is not null").groupBy("d", "tag").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("runs"))
    open_ = texts.join(wanted.hint("merge"), ["d", "tag"]).select("d", "tag", "text", "runs").mapInArrow(_snippets, "anchor long, d long, tag long, start long, snippet binary")
    sorted_ = open_.repartition(parts(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_sort, "d long, tag long, start long, end long")
    whole = packed.where("part is null").unionByName(decided.where("anchor is null"), allowMissingColumns=True)
    whole = whole.select("d", "tag", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))
    found = whole.unionByName(sorted_).groupBy("d", "tag").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    out = texts.join(found.hint("merge"), ["d", "tag"], "left").select(F.nullif("d", F.lit(NULL_ID)).alias("doc_id"), "text", "found")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
