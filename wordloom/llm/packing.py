"""Packing by minimum bin slack.

Documents are cut into full windows and one remainder each.  Only lengths decide
how pieces meet, and there are at most `capacity` of them, so the plan is made on
the histogram of lengths, whatever the size of the corpus: seed a window with the
longest length left, find by a bitset subset-sum over the counts left the filling
closest to capacity, trace back how many of each length it takes, and repeat that
window as often as the counts allow.  Every piece then finds its sequence and its
offset from its rank among the pieces of its length.

A null or empty text is its end id alone; a very long one fills as many windows as it
needs.  Repeat rows, pieces that tie and null ids are packed like any others.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import tokens as T
from .base import staged, store, table
from .sharding import numbered

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (at most counts[l] of each l) whose sum is the
    largest that does not exceed room: {length: number}."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length)
        if most <= 0:
            continue
        layers.append((length, most, reach))
        left, step = most, 1
        while left:  # bounded multiples by binary splitting
            take = min(step, left)
            reach |= reach << (take * length) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, most, before in reversed(layers):
        for q in range(most + 1):
            if at >= q * length and before >> (at - q * length) & 1:
                if q:
                    out[length] = q
                at -= q * length
                break
    return out


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, times, first sequence, offset),
    ordered by length and rank, that place every piece of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        window = fill(capacity - seed, {n: c for n, c in rest.items() if c and n <= capacity - seed})
        window[seed] = window.get(seed, 0) + 1
        times = min(left[n] // q for n, q in window.items())
        offset = 0
        for n in sorted(window, reverse=True):
            rows.append((n, used[n], window[n], times, sequence, offset))
            used[n] += window[n] * times
            left[n] -= window[n] * times
            offset += n * window[n]
            if not left[n]:
                del left[n]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, capacity: int, vocab: str | None = None) -> DataFrame:
    path = vocab or T.vocabulary()

    @K.tidy
    def run(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), T.encoded(batch.column(1), path), strict=True):
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc, at, len(part), T.crc(part), len(ids)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, capacity: int = T.CAPACITY, vocab: str | None = None) -> DataFrame:
    """One row per piece of docs: where it lies in its document and in its sequence."""
    spark = docs.sparkSession
    cut = store(pieces(docs, capacity, vocab), "pack-pieces", scanned=True)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    placed = spark.sparkContext.broadcast(plan(histogram, capacity))  # bounded by capacity, like the histogram
    ranked = numbered(cut, "length", ["doc_id", "start", "ids_crc32"], "_rank")

    def run(batches):
        table_ = placed.value
        key = table_[:, 0] << np.int64(40) | table_[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            _, first, per, _, sequence, offset = table_[np.searchsorted(key, length << np.int64(40) | rank, "right") - 1].T
            at = rank - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + at // per), pa.array(offset + at % per * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank"]
    return ranked.select(*columns).mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@staged
def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the sequences that the documents are packed into."""
    return pack(docs)
