"""Near-duplicate documents by MinHash with tensored banding (see linking).

Texts with equal shingle sets are one class (a 128-bit digest of the set), and only
classes are linked, so repeat rows, copies, rows that share an id but not a text, and
rows without an id all take part by their text.  A component is named by its smallest
id; where no row of it has one the name is null.  A null, empty or blank text has an
empty set, is linked with nothing and is its own component.  A very long text has one
signature, like any other.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import linking as L
from .base import discard, staged, store, table


def _signatures(shingler: L.Shingler):
    @K.tidy
    def run(batches):
        for batch in batches:
            buf, off = K.buffer_of(batch.column(2))
            sizes, digests, halves = [], [], []
            for i, j in K.chunks(off):
                h, n, d = L.signature(*shingler(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                halves.append(h)
                sizes += n
                digests += d
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), L.half_lists(halves)],
                ["doc", "text_key", "n_shingles", "digest", "halves"],
            )

    return run


def judged(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc, text_key, n_shingles, and first: the (missing, doc,
    text_key) of the row that stays for its component, the smallest (null ids last).

    docs: doc_id long, text string. Links: Jaccard similarity of the sets of k-word
    shingles of at least percent / 100. See the module's text for special rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    shingler = L.word_shingles(k)
    sig = store(texts.mapInArrow(_signatures(shingler), "doc long, text_key long, n_shingles long, digest binary, halves array<int>"), "minhash", scanned=True)
    at = F.struct(F.col("doc").isNull().alias("missing"), "doc", "text_key")
    classes = sig.where("n_shingles > 0").groupBy("digest").agg(F.min(at).alias("at"), F.first("halves").alias("halves"))
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-class")
    alive = store(L.half_keys(classes.select(F.col("node").alias("doc"), "halves")), "minhash-alive")

    def texts_of(met: DataFrame) -> DataFrame:
        """(doc, text) of some classes, each by one of its rows."""
        want = met.join(classes.select(F.col("node").alias("doc"), "at"), "doc").select(F.col("doc").alias("node"), F.col("at.doc").alias("d"), F.col("at.text_key").alias("k"))
        both = texts.join(want.hint("merge"), (F.col("text_key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")))
        return both.select(F.col("node").alias("doc"), "text").dropDuplicates(["doc"])

    parts = L.components(alive, texts_of, shingler, percent)
    discard(alive)
    labels = classes.select("digest", "node", "at").join(parts, "node", "left").select("digest", "at", F.coalesce("component", "node").alias("component"))
    first = labels.groupBy("component").agg(F.min("at").alias("first"))
    by_class = labels.join(first, "component").select("digest", "first")
    out = sig.select("doc", "text_key", "n_shingles", "digest").join(by_class, "digest", "left")
    return out.select("doc", "text_key", "n_shingles", F.coalesce("first", at).alias("first"))


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (null only where no row of the component has an
    id) and kept (doc_id is component_id) for every row of docs."""
    rows = judged(docs, k, percent)
    kept = F.col("doc").eqNullSafe(F.col("first.doc"))
    return rows.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("first.doc").alias("component_id"), kept.alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), k=4, percent=80)


#: Exact links by an inverted index, and reachability.
SQL = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as w from documents),
sh as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on b.s = a.s and b.doc_id > a.doc_id group by 1, 2),
link as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(node, label) as (select doc_id, doc_id from n union select r.node, e.b from reach r join edge e on e.a = r.label),
low as (select node, min(label) as component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(low.component_id, d.doc_id) as component_id, coalesce(low.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join low on low.node = d.doc_id
"""


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays (that of the smallest id, null
    last), with all its columns. A row goes only for its own text: of rows that share an
    id each is judged by itself, and of repeat rows one stays. Blank texts all stay."""
    rows = store(judged(docs.select("doc_id", "text")).where("n_shingles > 0"), "near-judged")
    stays = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.text_key") == F.col("text_key"))
    gone = rows.where(~stays).select("doc", "text_key").distinct()
    again = rows.where(stays).groupBy("doc", "text_key").count().where("count > 1").select("doc", "text_key")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"))
    here = F.col("d").eqNullSafe(F.col("doc")) & (F.col("k") == F.col("text_key"))
    if again.isEmpty():
        return own.join(gone, here, "left_anti").select("row.*")
    once = own.join(again, here, "left_semi").dropDuplicates(["d", "k"])
    return own.join(gone.unionByName(again), here, "left_anti").unionByName(once).select("row.*")
