"""Links between texts with similar shingle sets: tensored banding, hub stars, exact verification.

Two collections of M half-keys (HALF min-hashes each) are computed per text.  A
table key is a pair (A_i, B_j): M * M tables of 2 * HALF min-hashes come from
only 2 * M * HALF of them.  At similarity s two texts meet in no table with
probability below 2 * (1 - s**HALF)**M: 9e-5 at s = 0.8, 4e-6 at 0.85.

1. Equal texts are one class, and only classes take part.
2. Half-keys held by a single class cannot meet anything; they are dropped
   before the tables are formed, which leaves unique text with no table rows.
3. In each table bucket every class is paired with the one that shares most
   half-keys overall (linear in the bucket; in a group of copies that is the
   text they derive from), the pairs are verified on the full shingle sets, and
   components are formed.
4. Buckets that still hold several components: members of different components
   are verified too, as far as two exact bounds on what they can share and a
   sketch allow. So a link is found whenever its ends share any bucket or are
   connected otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .base import CONTROL, connected_components, discard, store

HALF, M = 3, 14
#: Min-hashes of a sketch, BITS of each; two unlike ones agree by chance in one of 16.
SKETCH, BITS = 1024, 4
_TURNS = K.permutations(2 * M * HALF, 4)

#: From the bytes and offsets of some texts to the shingle hashes of all, and their number per text.
Shingler = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_shingles(k: int) -> Shingler:
    """k words, letters A-Z in lower case; a text of fewer words is one shingle, a blank one has none."""

    def of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buf = K.lower_ascii(buf)
        s, e, rows = K.words(buf, off)
        x, n, _ = K.shingles(K.word_hashes(buf, s, e), rows, len(off) - 1, k)
        return x, n

    return of


def char_shingles(k: int) -> Shingler:
    """k characters between a text's first and last word, A-Z in lower case; a shorter text is one shingle."""

    def of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buf = K.lower_ascii(buf)
        begin, end = K.trimmed(buf, off)
        return K.char_shingles(buf, begin, end, k)

    return of


def sets_of(column: pa.Array, shingler: Shingler) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    buf, off = K.buffer_of(column)
    for i, j in K.chunks(off):
        x, n = shingler(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        ends = np.cumsum(n)
        for a, b in zip(ends - n, ends, strict=True):
            yield K.distinct(x[a:b])


def signature(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Half-keys (rows, 2 * M), set sizes and set digests of texts given by their shingles."""
    low = K.minhash(x, n, _TURNS).reshape(len(n), 2 * M, HALF).astype(np.uint64)
    key = np.zeros(low.shape[:2], np.uint64)
    for h in range(HALF):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, h] + np.uint64(h + 1))
    ends = np.cumsum(n)
    own = [K.distinct(x[a:b]) for a, b in zip(ends - n, ends, strict=True)]
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32), [len(s) for s in own], [hashlib.blake2b(s, digest_size=16).digest() for s in own]


def half_lists(halves: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(halves).reshape(-1) if halves else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(np.arange(len(flat) // (2 * M) + 1, dtype=np.int32) * (2 * M), pa.array(flat, pa.int32()))


def verified(pairs: DataFrame, texts: DataFrame, shingler: Shingler, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose whole shingle sets reach the threshold. texts: (doc, text)."""

    @K.tidy
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(sets_of(batch.column(2), shingler), sets_of(batch.column(3), shingler), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], ["a", "b"])

    a = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _tables(alive: DataFrame) -> DataFrame:
    """alive's columns, key and x: a row for each table (of half-key x and another) in which a class has a bucket that others may share."""
    own = [c for c in alive.columns if c not in ("a", "b")]
    rows = alive.select(*own, "b", F.explode("a").alias("x")).select(*own, "x", F.explode("b").alias("y"))
    return rows.select(F.xxhash64("x", "y").alias("key"), "x", *own)


def _bounds(docs: DataFrame, named: DataFrame, shingler: Shingler, counted: bool) -> DataFrame:
    """(doc, n, sketch, alone) of the classes in `docs`: the size of the set, the low
    bits of SKETCH min-hashes, sixteen to a long, and, if counted, how many shingles no
    other of them has (a row per shingle is shuffled for it: short texts do without)."""
    turns = K.permutations(SKETCH, 5)
    kind = docs.schema["doc"].dataType.simpleString()

    @K.tidy
    def sketches(batches):
        for batch in batches:
            buf, off = K.buffer_of(batch.column(1))
            for i, j in K.chunks(off):
                x, n = shingler(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                low = K.minhash(x, n, turns).astype(np.uint8) & np.uint8(15)
                longs = np.ascontiguousarray(low[:, 0::2] | low[:, 1::2] << np.uint8(4)).view(np.int64)
                flat = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * longs.shape[1], pa.array(longs.reshape(-1)))
                ends = np.cumsum(n)
                size = [len(K.distinct(x[a:b])) for a, b in zip(ends - n, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), flat], ["doc", "n", "sketch"])

    @K.tidy
    def rows(batches):
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                own = list(sets_of(part.column(1), shingler))
                docs = part.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), docs], ["h", "doc"])

    own = store(named.select("doc", "text").join(docs.hint("merge"), "doc", "left_semi"), "link-rest")
    drawn = own.mapInArrow(sketches, f"doc {kind}, n long, sketch array<long>").groupBy("doc").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    if not counted:
        return drawn.withColumn("alone", F.lit(0).cast("long"))
    once = own.mapInArrow(rows, f"h long, doc {kind}").groupBy("h").agg(F.count("*").alias("c"), F.min("doc").alias("doc"))
    alone = once.where("c = 1").groupBy("doc").agg(F.count("*").alias("alone"))
    return drawn.join(alone, "doc", "left")


def _folded(by: int) -> Callable[[Column], Column]:
    return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, by))


def _near(longs: int, similarity: float) -> Column:
    """Whether the first `longs` longs of x.sketch and y.sketch agree in as many places as
    sets of this similarity do, less four standard deviations (3e-5)."""
    cut = lambda c: F.slice(c, 1, longs) if longs * 64 // BITS < SKETCH else F.col(c)
    d = F.zip_with(cut("x.sketch"), cut("y.sketch"), lambda a, b: a.bitwiseXOR(b))
    for by in (2, 1):  # the lowest bit of each place becomes the union of its bits
        d = F.transform(d, _folded(by))
    places = longs * 64 // BITS
    ones = F.lit(0x1111111111111111)
    unlike = F.aggregate(d, F.lit(0), lambda n, v: n + F.bit_count(v.bitwiseAND(ones)).cast("int"))
    p = similarity + (1 - similarity) / (1 << BITS)
    return unlike <= places - int(places * p - 4 * (places * p * (1 - p)) ** 0.5)


def _rest(docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a table bucket, lie in different components and may reach the threshold.

    docs: (doc, n, a, b, component, sketch, alone), a in order and of mixed buckets
    only. The shingles two sets share are
    no more than what either shares with anyone, c = n - alone, and a link needs
    (100 + percent) * shared >= percent * (n + n'). So a class with too many shingles
    of its own drops out, and the bound is tested on each pair; both tests are exact.
    Sketches then estimate the similarity, a short part of them first. A pair comes
    out once, at the first A it shares."""
    c = F.col("n") - F.coalesce("alone", F.lit(0))
    rows = docs.withColumn("c", c).where(f"100 * c >= {percent} * n").withColumn("key", F.explode("a"))
    x, y = rows.alias("x"), rows.alias("y")
    fits = F.expr(f"{100 + percent} * least(x.c, y.c) >= {percent} * (x.n + y.n)")
    near = _near(8, percent / 100) & _near(SKETCH * BITS // 64, percent / 100)
    first = F.get(F.array_intersect(F.col("x.a"), F.col("y.a")), F.lit(0)) == F.col("x.key")
    other = F.col("x.component") < F.col("y.component")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & other & fits & first & F.arrays_overlap("x.b", "y.b") & near)
    return pairs.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def half_keys(classes: DataFrame) -> DataFrame:
    """(doc, a, b, mates): the half-keys of each class that other classes have too,
    and how many there are of them in all. classes: (doc, halves)."""
    half = classes.select("doc", F.posexplode("halves").alias("pos", "h"))
    shared = half.groupBy("pos", "h").count().where("count > 1")
    first, item = F.col("pos") < M, F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("h").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    alive = half.join(shared, ["pos", "h"]).groupBy("doc").agg(
        F.collect_list(F.when(first, item)).alias("a"), F.collect_list(F.when(~first, item)).alias("b"), F.sum("count").alias("mates")
    )
    return alive.where("size(a) > 0 and size(b) > 0")


def components(alive: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingler: Shingler, percent: int, counted: bool = True) -> DataFrame:
    """(node, component): the smallest class reachable, for every class with a link.

    alive: a stored table (doc, a, b, mates); the tables of a class are the pairs
    of an a and a b. texts_of: from (doc) to (doc, text)."""
    rows = _tables(alive)
    top = F.max(F.struct("mates", "doc")).alias("top")
    hub = rows.groupBy("key").agg(top, F.count("*").alias("members")).where("members > 1").select("key", F.col("top.doc").alias("hub"))
    stars = rows.select("key", "doc").join(hub, "key").where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    stars = store(stars.distinct(), "link-stars", files=CONTROL)
    met = stars.select(F.col("a").alias("doc")).union(stars.select("b")).distinct()
    # The only time whole texts move: those of classes that met another one.
    named = store(texts_of(met), "link-texts")
    edges = store(verified(stars, named, shingler, percent), "link-edges", files=CONTROL)

    label = alive.drop("mates").join(connected_components(edges).withColumnRenamed("node", "doc"), "doc", "left")
    label = label.withColumn("component", F.coalesce("component", "doc"))
    rows = _tables(label)
    mixed = rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
    docs = store(rows.join(mixed, "key").select("doc").distinct(), "link-mixed", files=CONTROL)
    rest = label.join(_bounds(docs, named, shingler, counted), "doc")
    pairs = store(_rest(rest, percent), "link-pairs", files=CONTROL)
    rest = pairs.join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti")
    found = store(verified(rest, named, shingler, percent), "link-found", files=CONTROL)
    out = connected_components(edges.unionByName(found))
    discard(stars, named, edges, docs, pairs, found)
    return out
