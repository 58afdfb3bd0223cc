"""Remaining reads, functions and saves over the corpus tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, matching
from ..functions.spelling import Rule, problem
from ..plans.catalog import query
from ..plans.domain import run_sql, sql_query
from . import alignment, state

Q = {
    "s2_lazy_scan": lambda d: "select id, verse_id from translation_words where translation_id = 3",
    "s20_cached_aggregate": lambda d: "select book_id, count(*) as words from source_words group by book_id",
    "f46_crop_to_words": lambda d: f"select doc_id, {d.replace_all(d.replace_all('substr(text, 11, 60)', '^[^ ]* '), ' [^ ]*$')} as crop from documents",
    "f47_array_to_text": lambda d: f"select work_id, {d.listagg('heading', ',', 'seq, id')} as headings from segment group by work_id",
    "f48_exploded_parts": lambda d: f"select id, position, word as part from ({d.tokens('(select id, scope_id from (select event_id as id, scope_id from review_lock) x) y', 'id', 'scope_id', '[.]')}) t",
    "f49_vocabulary": lambda d: "select distinct lower(substr(word, 1, 4)) as start from token where is_word",
    "f51_lock_expiry": lambda d: "select event_id, expires > 1704067200000000 as live, cast(floor((expires - acquired) / 60000000) as bigint) as minutes from review_lock",
    "f38_rule_shape": lambda d: f"select id, {d.matches('source', '^[A-Z]')} as capital, source = target as unchanged, length(trim(source)) = 0 as empty from rules",
    "f39_unknown_words": lambda d: f"""
        select lemma, count(*) as n from token t where is_word and length(lemma) > 1 and not exists (select 1 from (select lower(p_name) as w from part) v where v.w = t.lemma) group by lemma order by n desc, lemma limit 80""",
    "r5_sentence_tokens": lambda d: """
        select t.segment_id, b.n, t.position - b.lo as rebased, t.word from token t join (
            select segment_id, position as lo, lead(position, 1, 1000000) over (partition by segment_id order by position) as hi,
                   cast(row_number() over (partition by segment_id order by position) as bigint) as n from token where word like '%.' or position = 1) b
        on b.segment_id = t.segment_id and t.position >= b.lo and t.position < b.hi""",
    "r8_word_map": lambda d: "select distinct t.work_id, t.chapter, t.lemma, e.strongs_id from token t join strongs_entries e on e.strongs_id = concat('H', cast(length(t.lemma) as varchar(3)))",
    "r23_reference_list": lambda d: f"""
        select book_id, chapter, min(verse) as verse_start, max(verse) as verse_end from (
            select book_id, chapter, verse, verse - cast(row_number() over (partition by book_id, chapter order by verse) as bigint) as run from verses) t group by book_id, chapter, run""",
    "r25_sentence_starts": lambda d: "select segment_id, position, position = 1 or lag(word) over (partition by segment_id order by position) like '%.' as starts from token",
    "r27_patch_rows": lambda d: """
        select w.verse_id, w.id, w.word_position as new_position, o.old_position from translation_words w join (
            select id, cast(row_number() over (partition by verse_id order by word_position) as bigint) as old_position from translation_words where not is_filler) o on o.id = w.id where w.word_position <> o.old_position""",
    "r28_best_confidence": lambda d: "select link_id, max(score) as score, count(*) as methods from link_confidence group by link_id",
    "r29_second_layer_tokens": lambda d: "select segment_id, count(*) as tokens, count(distinct translate(lemma, 'vj', 'ui')) as norms from token where is_word group by segment_id",
    "m29_lemma_export": lambda d: "select lemma, count(*) as freq, count(distinct segment_id) as n_segments from token where is_word group by lemma order by freq desc, lemma",
    "m24_computed_export": lambda d: """
        select s.lang as source_language, k.source_id, k.tw_id, c.method, c.score from word_links k join source_words s on s.id = k.source_id
        left join link_confidence c on c.link_id = k.id where coalesce(c.method, '') not in ('manual', 'manual_hint')""",
    "m24_manual_export": lambda d: """
        select t.code, v.book_id, v.chapter, v.verse, w.word_position, k.source_id from word_links k join link_confidence c on c.link_id = k.id and c.method = 'manual'
        join translation_words w on w.id = k.tw_id join translation_verses v on v.id = w.verse_id join translations t on t.id = v.translation_id""",
    "m35_boundary_assertion": lambda d: """
        select segment_id, count(*) filter (where not ok) as violations from (
            select segment_id, position > coalesce(lag(position) over (partition by segment_id order by position), 0) as ok from token where position % 10 = 1) t group by segment_id""",
    "c25_anchor_words": lambda d: """
        select a.work_id, a.lemma from (select work_id, lemma from token where is_word group by work_id, lemma having count(*) = 1) a
        join (select lemma from token where is_word group by lemma having count(distinct work_id) = 2) b on b.lemma = a.lemma""",
}

for _name, _text in Q.items():
    sql_query(_name, _text)


@query("c12_assignment")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the least-cost assignment of its lines to the price bands of its parts."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"), F.sort_array(F.collect_list("l_discount")).alias("d"))

    def f(row):
        cost = [[abs(q / 50 - 10 * x) for x in row["d"]] for q in row["q"]]
        yield from ((row["l_orderkey"], r, c) for r, c in matching.assignment(cost))

    return alignment._rows(rows, f, "l_orderkey long, row int, column int")


def historical_run(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A run over verse pairs against the state: (new links, notes).

    pairs: (pair, source, target, source_ids, target_ids); links: (word_a_id, word_b_id, method, score).
    Links set by hand are forced and stay; all others between the words of a pair are replaced; words
    of particles and dropped prefixes get a note."""
    ids = pairs.select("pair", F.explode("source_ids").alias("word_a_id"))
    manual = links.where(F.col("method").isin("manual", "manual_empty"))
    forced = ids.join(manual.where("method = 'manual'"), "word_a_id").select("pair", "word_a_id", "word_b_id")
    known = forced.groupBy("pair").agg(F.collect_list(F.struct("word_a_id", "word_b_id")).alias("ids"))
    both = pairs.join(known, "pair", "left")
    place = lambda ids, x: (F.array_position(ids, x) - 1).cast("int")
    found = F.filter(
        F.transform(F.coalesce("ids", F.array()), lambda x: F.struct(place(F.col("source_ids"), x["word_a_id"]).alias("src"), place(F.col("target_ids"), x["word_b_id"]).alias("tgt"))), lambda x: (x["src"] >= 0) & (x["tgt"] >= 0)
    )
    out = alignment.historical(both.select("pair", "source", "target", found.alias("forced"))).join(pairs.select("pair", "source_ids", "target_ids"), "pair")
    word = F.get("source_ids", F.col("src"))
    new = out.where(~F.col("kind").isin("manual", "particle_drop", "prefix_drop")).select(word.alias("word_a_id"), F.explode("tgt").alias("j"), "kind", "score", "target_ids")
    new = new.select("word_a_id", F.get("target_ids", F.col("j")).alias("word_b_id"), F.col("kind").alias("method"), "score")
    notes = out.where(F.col("kind").isin("particle_drop", "prefix_drop")).select(word.alias("id"), F.col("kind").alias("note"))
    kept = links.join(ids.select("word_a_id").distinct(), "word_a_id", "left_anti").unionByName(manual.join(ids.select("word_a_id").distinct(), "word_a_id", "left_semi"))
    return kept.unionByName(new.select(*links.columns)), notes


@query("c13_historical_run")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = run_sql(spark, sf_dir, "select verse, translation_id, word_position, id, word_text from translation_words where translation_id <= 2")
    side = lambda t, w, i: (
        words.where(F.col("translation_id") == t).groupBy("verse").agg(F.array_sort(F.collect_list(F.struct("word_position", "id", "word_text"))).alias("x"))
        .select(F.col("verse").alias("pair"), F.transform("x", lambda y: y["word_text"]).alias(w), F.transform("x", lambda y: y["id"]).alias(i))
    )
    links = run_sql(spark, sf_dir, "select i.word_a_id, i.word_b_id, i.method, cast(null as double) as score from itl i join translation_words a on a.id = i.word_a_id and a.translation_id = 1")
    return historical_run(side(1, "source", "source_ids").join(side(2, "target", "target_ids"), "pair"), links)[0]


@query("m17_save_links")
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of one word after its targets are set by hand."""
    links = run_sql(spark, sf_dir, "select id, source_id, tw_id, notes from word_links")
    words = run_sql(spark, sf_dir, "select id, translation_id from translation_words")
    empty = spark.createDataFrame([], "source_id long, translation_id long")
    kept, _ = state.save_links(links, empty, 9, 1, [80000009], words)
    return kept.where("source_id = 9").select("source_id", "tw_id")


@query("m28_flags_by_key")
def m28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of documents as JSON keyed by place, imported again into a state that has some of them."""
    flags = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("segment"), F.lit("text").alias("field"), F.substring("text", 1, 12).alias("snippet"), "lang")
    line = flags.select(F.to_json(F.struct("segment", "field", "snippet", "lang")).alias("j"))
    back = line.select(F.from_json("j", "segment long, field string, snippet string, lang string").alias("f")).select("f.*")
    return state.insert_absent(flags.where("segment % 2 = 0"), back, ["segment", "field", "snippet"])


@query("m33_translation_save")
def m33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new layer text replaces the old one; what hangs on the old text goes; the status follows."""
    old = run_sql(spark, sf_dir, "select id, text, status from segment")
    new = old.where("id % 5 = 0").select("id", F.upper("text").alias("text"), F.lit("translated").alias("status"))
    tokens = run_sql(spark, sf_dir, "select segment_id as id, count(*) as n from token group by segment_id")
    kept = tokens.join(new.select("id"), "id", "left_anti")
    return state.upsert(old, new, ["id"]).join(kept, "id", "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("aligned"))


@query("m36_token_link_save")
def m36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token links of some segments are replaced as a set."""
    old = run_sql(spark, sf_dir, "select segment_id, position, word from token")
    parents = old.where("segment_id % 7 = 0").select("segment_id").distinct()
    new = parents.select("segment_id", F.lit(1).cast("long").alias("position"), F.lit("set by hand").alias("word"))
    return state.replace_children(old, parents, new, ["segment_id"]).groupBy("segment_id").agg(F.count("*").alias("links"))


@query("m37_bulk_load")
def m37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works, then their segments, upserted by natural key; segments take the id of their work."""
    seg = run_sql(spark, sf_dir, "select work_id, seq, text from segment")
    works = state.with_new_ids(spark.createDataFrame([], "id long, slug string"), seg.select(F.concat(F.lit("work-"), "work_id").alias("slug")).distinct(), ["slug"])
    rows = seg.withColumn("slug", F.concat(F.lit("work-"), "work_id")).join(works, "slug").select(F.col("id").alias("work"), "seq", F.length("text").alias("chars"))
    return rows.groupBy("work").agg(F.count("*").alias("segments"), F.sum("chars").alias("chars")).select("segments", "chars")


@query("f26_overlaid_notes")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: forms.with_notes(t, [(len(t) // 2, "[n]"), (len(t), "[e]")]), na_action="ignore")

    return run_sql(spark, sf_dir, "select id, text from segment").select("id", run("text").alias("text"))


@query("f43_differing_ranges")
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([" ".join(f"{x}-{y}" for x, y in forms.differing_ranges(p, q)) for p, q in zip(a, b, strict=True)])

    return run_sql(spark, sf_dir, "select id, text, replace(text, 'th', 'tb') as other from segment").select("id", run("text", "other").alias("ranges"))


@query("f38_rule_problems")
def f38(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([problem(Rule(x or "", y or "")) for x, y in zip(a, b, strict=True)])

    return run_sql(spark, sf_dir, "select id, source, case when id % 3 = 0 then source when id % 3 = 1 then '*x' else target end as target from rules").select("id", run("source", "target").alias("problem"))
