"""Fuzzy line dedup: of each component of similar lines, the first line stays.

Lines are split at newlines and compared between their first and last word,
letters A-Z in lower case, by the sets of their CHARS-character shingles; a link
needs a Jaccard similarity of 0.8; a line of fewer characters than CHARS is one
shingle, so it meets its exact copies.  Every line that has a word is compared;
lines without one are no rows and are never removed.  "First" is by doc_id, null
last, then by line number.

Lines that are equal in this form are one node, named by a 64-bit hash.  BANDS
keys of ROWS min-hashes each are computed per node: at similarity 0.8 two nodes
share none with probability (1 - 0.8**ROWS)**BANDS, 6e-4 (4e-6 at 0.87).  Keys travel packed, a
block of bytes per part of the key space, and only keys that several nodes share
become rows; what follows (stars, exact verification, components) is as in linking.

Repeat rows (equal id and text) are one document: the same lines of each go.
Rows that share an id but not a text are ordered by a hash of the text.  A null,
empty or blank text has no lines, an empty table no rows.  A very long text is read
on its own.  Other columns, whatever their names, pass through unchanged.

A component that holds more than one in HOT of all lines (there are fewer than HOT of
them) is dealt to SALTS tasks, where its lines meet the one that stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import linking as L
from .base import discard, new_path, parts, staged, store, table

CHARS, PERCENT = 8, 80
BANDS, ROWS = 14, 4
HOT, SALTS = 1000, 64
#: Parts of the key space; what a task holds of the keys is its parts' share.
PARTS = 1024
_TURNS = K.permutations(BANDS * ROWS, 9)
_RECORD = np.dtype([("key", "<u4"), ("node", "<i8")])
_LINE = "node long, doc_id long, text_key long, line int, n_shingles int"


def line_offsets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows (a newline ends its line), the row and the number in it of each."""
    breaks = np.flatnonzero(buf == 10)
    pos = np.concatenate((off[:-1], breaks + 1))
    row = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1))
    order = np.lexsort((row, pos))
    pos, row = pos[order], row[order]
    first = np.searchsorted(row, np.arange(len(off) - 1))
    return np.append(pos, len(buf)), row, np.arange(len(row)) - first[row]


@K.tidy
def _read(batches):
    """A row per line with a word, and rows of packed (band key, node) records, one per part."""
    none = lambda n, kind: pa.nulls(n, kind)
    for batch in batches:
        buf, off = K.buffer_of(batch.column(2))
        keys, nodes = [], []
        for i, j in K.chunks(off):
            part = K.lower_ascii(buf[off[i] : off[j]])
            lines, row, number = line_offsets(part, off[i : j + 1] - off[i])
            begin, end = K.trimmed(part, lines)
            roll = K.Rolling(K.byte_values(part))
            x, n = K.char_shingles(part, begin, end, CHARS, roll)
            filled = n > 0  # a line without words has no shingles
            n, row, number = n[filled], row[filled], number[filled]
            node = roll.ranges(begin[filled], end[filled]).view(np.int64)
            at = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["line"] * len(n), pa.string()),
                    none(len(n), pa.int32()),
                    none(len(n), pa.binary()),
                    pa.array(node),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(number.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["kind", "part", "records", "node", "doc_id", "text_key", "line", "n_shingles"],
            )
            low = K.minhash(x, n, _TURNS).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), low.shape[:2])
            for r in range(ROWS):
                key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
            keys.append(key)
            nodes.append(node)
        if not keys:
            continue
        node, once = np.unique(np.concatenate(nodes), return_index=True)
        key, node = np.concatenate(keys)[once].reshape(-1), np.repeat(node, BANDS)
        to = (key >> np.uint64(32)) % np.uint64(PARTS)
        order = np.argsort(to.astype(np.uint16), kind="stable")  # PARTS are few: a radix sort
        records = np.zeros(len(key), _RECORD)
        records["key"], records["node"] = key[order].astype(np.uint32), node[order]
        edge = np.searchsorted(to[order], np.arange(PARTS + 1, dtype=np.uint64))
        used = np.flatnonzero(np.diff(edge))
        packed = [records[edge[p] : edge[p + 1]].tobytes() for p in used]
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["keys"] * n, pa.string()), pa.array(used.astype(np.int32)), pa.array(packed, pa.binary()), *(none(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
            ["kind", "part", "records", "node", "doc_id", "text_key", "line", "n_shingles"],
        )


@K.tidy
def _shared(batches):
    """(key, node, mates) of the keys that several nodes have; `part` makes a 32-bit key unique enough."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(part, []).append(records)
    for part, blobs in held.items():
        r = np.frombuffer(b"".join(blobs), _RECORD)
        r = r[np.argsort(r["key"])]
        same = r["key"][1:] == r["key"][:-1]
        r = r[np.concatenate((same, [False])) | np.concatenate(([False], same))]  # most keys have one node
        if not len(r):
            continue
        r = r[np.lexsort((r["node"], r["key"]))]
        r = r[np.concatenate(([True], (r["key"][1:] != r["key"][:-1]) | (r["node"][1:] != r["node"][:-1])))]
        new = np.concatenate(([True], r["key"][1:] != r["key"][:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(r)))
        mates = np.repeat(size, size)
        many = mates > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(r["key"][many].astype(np.int64) | (part << 32)), pa.array(r["node"][many]), pa.array(mates[many].astype(np.int64))], ["key", "node", "mates"]
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def judged(docs: DataFrame) -> DataFrame:
    """Every line with a word: doc_id, text_key, line, n_shingles, and first: the
    (missing, doc_id, text_key, line) of the line that stays for it."""
    spark, rows = docs.sparkSession, _keyed(docs)
    path = new_path(spark, "lines")
    rows.mapInArrow(_read, f"kind string, part int, records binary, {_LINE}").write.partitionBy("kind").parquet(path)
    schema = f"kind string, part int, records binary, {_LINE}"
    read = spark.read.schema(schema).parquet(path)
    lines = read.where("kind = 'line'").select("node", "doc_id", "text_key", "line", "n_shingles")
    packed = read.where("kind = 'keys'").select("part", "records").repartition(parts(spark), "part")
    shared = packed.mapInArrow(_shared, "key long, node long, mates long")
    alive = shared.groupBy("node").agg(F.collect_list("key").alias("a"), F.array(F.lit(0).cast("long")).alias("b"), F.sum("mates").alias("mates"))
    alive = store(alive.withColumnRenamed("node", "doc"), "lines-alive")
    name = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key", "line")

    def texts_of(met: DataFrame) -> DataFrame:
        # Any line of a node has its text; three firsts are of one row. Each task sends a node once, however common its line.
        one = lines.groupBy("node").agg(F.first("doc_id").alias("d"), F.first("text_key").alias("k"), F.first("line").alias("line"))
        where = one.join(met.withColumnRenamed("doc", "node").hint("merge"), "node")
        at = F.struct((F.col("line") + 1).alias("n"), "node")
        want = where.groupBy("d", "k").agg(F.collect_list(at).alias("at"))
        both = rows.join(want.hint("merge"), (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
        each = both.select(F.split("text", "\n").alias("lines"), F.explode("at").alias("at"))
        return each.select(F.col("at.node").alias("doc"), F.element_at("lines", F.col("at.n")).alias("text"))

    found = L.components(alive, texts_of, L.char_shingles(CHARS), PERCENT, counted=False)
    discard(alive)
    member = lines.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    # A line that is alone in its component stays, and is joined with nothing.
    first = member.groupBy("component").agg(F.min(name).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = store(first, "lines-first")
    is_hot = F.col("n") * HOT > lines.count()  # fewer than HOT components
    hot = F.broadcast(first.where(is_hot).select("component", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = member.join(hot, "component", "left").withColumn("salt", salt).drop("hot")
    out = dealt.join(first.select("component", "first", F.explode(salts).alias("salt")), ["component", "salt"], "left")
    return out.withColumn("first", F.coalesce("first", name)).drop("component", "salt")


def _stays() -> Column:
    return F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key")) & (F.col("first.line") == F.col("line"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 0), n_shingles, kept, and the line that stays for it: kept_doc_id, kept_line."""
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line", "n_shingles", _stays().alias("kept"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line").alias("kept_line"))


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of the numbers given; null where there are none."""
    out: list[str | None] = []
    for x, drop in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(drop or ())
        out.append(None if x is None else "\n".join([line for k, line in enumerate(x.split("\n")) if k not in drop]))
    return pa.array(out, pa.string())


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the lines that copy an earlier one. A document that had words
    and has none left goes; all others stay, with all their columns."""
    gone = judged(docs).where(~_stays()).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"))
    both = own.join(gone, (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id")), "left")
    cut = F.arrow_udf(_without, "string")(F.when(F.col("gone").isNotNull(), F.col("row.text")), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cut)
    both = both.select("row", "gone", text.alias("left")).where(F.col("gone").isNull() | F.col("left").rlike("[^ \\t-\\r]"))
    return both.select(*[F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


@staged
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines that copy an earlier one go, and documents that nothing is left of; n_chars follows the text."""
    out = dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
