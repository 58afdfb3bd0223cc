"""Benchmark decontamination, in DataFrame operations only.

Words are maximal runs of letters and digits, in lower case.  A document is
contaminated by an item if one of its windows as long as the item has a similarity
of at least 0.8 with it: the Jaccard similarity of the two multisets of K-word
shingles, each shingle weighted by its number of occurrences.

1. Item-sized windows: of the windows of all documents, those that cannot reach the
   threshold with any item get no fingerprint.  A window that reaches it holds at
   least 0.8 / 1.8 of the shingles of both, and moving a window right to its first
   shared shingle never lowers the similarity, so the windows that start at a shared
   shingle and hold enough of them are all that are left.  This loses nothing.
2. Each such window gets a SimHash of its words, BITS bits; so do the items.
   Fingerprints are cut into RADIUS + 1 blocks: two within RADIUS bits agree on
   some block whole, so an equi-join on block and size finds all of them.  Which
   item a window is compared with is decided here alone.
3. Pairs within RADIUS bits are verified by the exact similarity.

An item or a window of fewer than K words is one shingle, the whole of it; it is
met only by documents that are as short.  Null and empty texts have no words; items
without words are left out; null item ids are an id like any other, and items that
share an id are one item with several texts.  Repeat rows have the same rows of
results, once; of windows that tie the first counts.  A very long text costs what its
words cost; it has as many rows as it has windows to compare.  Empty tables give no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, staged, store, table

K, PERCENT = 5, 80
BITS, RADIUS = 128, 32
#: An item table of up to this many shingles (about 2 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingles(hashes: str) -> Column:
    """Hashes of K consecutive words, from the hashes of the words."""
    h = F.col(hashes)
    at = lambda i, d: F.get(h, i + d)
    many = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[at(i, d) for d in range(K)]))
    return F.when(F.size(h) >= K, many).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))


def _majority(hashes: Column) -> Column:
    """Bit b is set if it is in more than half of the hashes."""
    half = F.size(hashes) / 2
    one = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(one(b) > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def simhash(hashes: Column) -> Column:
    """BITS / 64 longs; all but the first are of the words hashed again."""
    again = [hashes]
    for _ in range(BITS // 64 - 1):
        again.append(F.transform(again[-1], lambda h: F.xxhash64(h)))
    return F.array(*[_majority(x) for x in again])


def blocks(fingerprint: str) -> Column:
    """(block, value) of RADIUS + 1 blocks that cover all bits, none across two longs."""
    longs, out = BITS // 64, []
    for k in range(longs):
        n = (RADIUS + 1) * (k + 1) // longs - (RADIUS + 1) * k // longs
        edges = [64 * i // n for i in range(n + 1)]
        for i in range(n):
            value = F.shiftrightunsigned(F.get(fingerprint, F.lit(k)), edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long"))
            out.append(F.struct(F.lit(len(out)).alias("block"), value.alias("value")))
    return F.array(*out)


def _distance(x: str, y: str) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(BITS // 64)), F.lit(0))


def _overlap(x: Column, y: Column) -> Column:
    """Sum over distinct elements of the smaller number of occurrences."""
    times = lambda a, e: F.size(F.filter(a, lambda z: z == e))
    both = F.array_intersect(x, y)
    plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, e: n + F.least(times(x, e), times(y, e))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, hashes of the words, shingles, fingerprint; texts without words are left out."""
    rows = benchmark.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).where("size(h) > 0")
    return rows.select("item_id", "h", F.size("h").alias("n"), shingles("h").alias("shingles"), simhash(F.col("h")).alias("print"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, start (word), n_words, distance, similarity: the
    best window, of equals the first, for each contaminated document and item."""
    items = store(items_of(benchmark).withColumn("item", F.monotonically_increasing_id()), "decontam-items")
    seeds = items.select("item", "n", F.size("shingles").alias("m"), F.explode(F.array_distinct("shingles")).alias("s"))
    small = bounded(seeds, BROADCAST_ROWS)
    near = F.broadcast if small else lambda x: x
    # 1. Where documents share shingles with items.
    keyed = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("text_key"), "text")
    hashed = keyed.select("text_key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    at = hashed.select("text_key", F.posexplode(shingles("h")).alias("pos", "s"))
    hits = at.join(near(seeds), "s").select("text_key", "item", "n", "m", "pos").distinct()
    grouped = hits.groupBy("text_key", "item", "n", "m").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    # A window that starts at hit i holds hits i .. i + m - 1 at most.
    inside = lambda x, i: F.size(F.filter(F.slice("at", i + 1, F.col("m")), lambda y: y < x + F.col("m")))
    enough = lambda x, i: inside(x, i) * (100 + PERCENT) >= PERCENT * (F.col("m") + inside(x, i))
    starts = grouped.select("text_key", "n", F.explode(F.filter("at", enough)).alias("start")).distinct()
    starts = store(starts.groupBy("text_key").agg(F.collect_list(F.struct("start", "n")).alias("windows")), "decontam-starts")
    # 2. Fingerprints of those windows; whole texts move once, those without a window nowhere further.
    both = keyed.join(starts, "text_key").select("doc_id", "text_key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), "windows")
    windows = both.select("doc_id", "text_key", "h", F.explode("windows").alias("w")).select(
        "doc_id", "text_key", F.col("w.start").alias("start"), F.col("w.n").alias("size"), F.slice("h", F.col("w.start") + 1, F.col("w.n")).alias("h")
    )
    windows = windows.select("*", shingles("h").alias("shingles"), simhash(F.col("h")).alias("print"))
    windows = store(windows.distinct(), "decontam-windows")
    cut = windows.select("doc_id", "text_key", "start", "size", "print", F.explode(blocks("print")).alias("b"))
    own = items.select("item", F.col("n").alias("size"), F.col("print").alias("item_print"), F.explode(blocks("print")).alias("b"))
    close = cut.join(near(own), ["b", "size"]).withColumn("distance", _distance("print", "item_print"))
    close = close.where(F.col("distance") <= RADIUS).select("doc_id", "text_key", "start", "size", "item", "distance").distinct()
    # 3. Exact similarity of the pairs found.
    texts = windows.select("text_key", "start", "size", F.size("h").alias("w_n"), "shingles").dropDuplicates(["text_key", "start", "size"])
    pairs = close.join(texts, ["text_key", "start", "size"]).join(near(items.select("item", "item_id", F.col("shingles").alias("wanted"))), "item")
    shared = _overlap(F.col("wanted"), F.col("shingles"))
    pairs = pairs.withColumn("shared", shared).withColumn("total", F.size("wanted") + F.size("shingles") - F.col("shared"))
    pairs = pairs.where(f"100 * shared >= {PERCENT} * total").withColumn("similarity", F.col("shared") / F.col("total"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "w_n", (-F.col("distance")).alias("near"))).alias("best")
    found = pairs.groupBy("doc_id", "text_key", "item_id").agg(best)
    return found.select(
        "doc_id",
        "text_key",
        "item_id",
        (-F.col("best.minus")).alias("start"),
        F.col("best.w_n").alias("n_words"),
        (-F.col("best.near")).alias("distance"),
        F.col("best.similarity").alias("similarity"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start (word), n_words and similarity of the best window of each contaminated document and item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key", "distance")


#: The same windows and similarities, without fingerprints.
SQL = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ds as (select doc_id, len(w) as n, unnest(range(0, greatest(len(w) - 4, 1))) as pos, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from dw where len(w) > 0),
its as (select item_id, len(w) as n, greatest(len(w) - 4, 1) as m, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from iw where len(w) > 0),
ic as (select item_id, n, m, s, count(*) as c from its group by all),
hit as (select d.doc_id, d.n as words, d.pos, d.s, i.item_id, i.n, i.m, i.c from ds d join ic i on i.s = d.s),
win as (select a.doc_id, a.item_id, a.pos as start, a.words, a.n, a.m, h.s, least(count(*), max(h.c)) as shared
    from (select distinct doc_id, words, item_id, n, m, pos from hit) a join hit h on h.doc_id = a.doc_id and h.item_id = a.item_id and h.pos >= a.pos and h.pos < a.pos + a.m group by all),
sim as (select doc_id, item_id, start, least(n, words - start) as n_words, sum(shared) as shared, m + least(m, greatest(words - 4, 1) - start) - sum(shared) as total from win group by doc_id, item_id, start, words, n, m)
select doc_id, item_id, cast(start as int) as start, cast(n_words as int) as n_words, cast(shared as double) / cast(total as double) as similarity
from (select *, row_number() over (partition by doc_id, item_id order by cast(shared as double) / cast(total as double) desc, start) as rn from sim where 100 * shared >= 80 * total) t where rn = 1
"""


@staged
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, each for its own text; the others stay with all their columns."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.xxhash64("doc_id", "text").alias("k"))
    return own.join(found, (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")
