"""The corpus tables (books, words, links, ...) as views over the star-schema tables.

An order plays a verse and its line numbers the word positions, parts give word
forms and dictionary ids, return flags give link methods.  Line numbers are not
unique within an order, so lines are first reduced to one per position.  Each view
is one SQL text that both engines read; CTES lists them in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import query
from .dialect import DUCKDB, SPARK, Dialect

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CTES: dict[str, Callable[[Dialect], str]] = {
    "line": lambda d: """
        select l_orderkey as o, cast(l_linenumber as bigint) as n, min(l_partkey) as p, min(l_suppkey) as s,
               min(l_returnflag) as r, min(l_linestatus) as ls, min(l_discount) as disc, min(l_quantity) as qty
        from lineitem group by l_orderkey, l_linenumber""",
    "books": lambda d: """
        select cast(n_nationkey + 1 as bigint) as id, upper(substr(n_name, 1, 3)) as usfm_code, n_name as name,
               case when n_regionkey < 2 then 'OT' when n_regionkey < 4 then 'NT' else 'APOC' end as testament from nation""",
    "translations": lambda d: """
        select cast(r_regionkey + 1 as bigint) as id, concat('T', cast(r_regionkey + 1 as varchar(2))) as code,
               case when r_regionkey < 3 then 'old' else 'new' end as family, r_regionkey = 0 as authority,
               r_regionkey = 1 as pivot, case when r_regionkey < 4 then cast(r_regionkey as bigint) end as seq from region""",
    "verses": lambda d: f"""
        select distinct o as verse, 1 + o % 25 as book_id, 1 + {d.idiv("o", "25")} % 10 as chapter from line""",
    "source_words": lambda d: f"""
        select o * 8 + n as id, case when o % 2 = 0 then 'HE' else 'GR' end as lang, 1 + o % 25 as book_id,
               1 + {d.idiv("o", "25")} % 10 as chapter, o as verse, n as word_position, concat('w', {d.text("p % 500")}) as word_text,
               concat(case when o % 2 = 0 then 'H' else 'G' end, lpad({d.text("p % 700 + 1")}, 4, '0'), case when p % 11 = 0 then 'G' else '' end) as strongs,
               concat('HV', substr('qpNQHt', cast(1 + p % 6 as int), 1), substr('pqiwvcras', cast(1 + s % 9 as int), 1), '3ms') as morph_code
        from line""",
    "translation_verses": lambda d: f"""
        select t.id * 10000000 + v.verse as id, t.id as translation_id, v.book_id, v.chapter, v.verse
        from verses v join translations t on t.id <= 3 and (t.id < 3 or v.verse % 9 <> 0)""",
    "translation_words": lambda d: f"""
        select tv.id * 8 + l.n as id, tv.id as verse_id, tv.translation_id, tv.book_id, tv.chapter, tv.verse, l.n as word_position,
               case tv.translation_id when 1 then concat('w', {d.text("l.p % 500")}) when 2 then concat('w', {d.text("(l.p + case when l.p % 3 = 0 then 1 else 0 end) % 500")})
                    else concat('v', {d.text("l.p % 400")}) end as word_text,
               l.s % 13 = 0 as is_filler, case when l.s % 29 = 0 then 'particle_drop' end as alignment_note
        from line l join translation_verses tv on tv.verse = l.o where tv.translation_id < 3 or l.n < 6""",
    "word_links": lambda d: """
        select w.id as id, l.o * 8 + l.n as source_id, w.id as tw_id, case when l.s % 5 = 0 then 'manual_hint:x' end as notes
        from line l join translation_words w on w.verse = l.o and w.word_position = l.n and w.translation_id <= 2 and l.p % 5 <> 0
        union all
        select w.id + 1000000000000 as id, l.o * 8 + l.n as source_id, w.id as tw_id, null as notes
        from line l join translation_words w on w.verse = l.o and w.word_position = l.n + 1 and w.translation_id <= 2 and l.p % 7 = 0""",
    "link_confidence": lambda d: """
        select k.id as link_id, case l.r when 'R' then 'manual' when 'A' then 'proper_noun' else 'positional' end as method,
               case when l.s % 17 <> 0 then round((1 - l.disc) * 1000) / 1000 end as score
        from word_links k join line l on k.source_id = l.o * 8 + l.n
        union all
        select k.id as link_id, 'manual_hint' as method, 0.8 as score from word_links k where k.notes is not null""",
    "itl": lambda d: """
        select a.id * 4 as id, a.id as word_a_id, b.id as word_b_id,
               case when l.s % 31 = 0 then 'manual_empty' when l.r = 'R' then 'manual' when l.r = 'A' then 'needleman' else 'source_pivot' end as method,
               case when l.s % 19 <> 0 then cast(100 - l.p % 50 as bigint) end as confidence
        from translation_words a join translation_words b on a.verse = b.verse and a.word_position = b.word_position and b.translation_id = a.translation_id + 1
        join line l on l.o = a.verse and l.n = a.word_position where l.p % 4 <> 0""",
    "strongs_entries": lambda d: f"""
        select strongs_id, min(def) as short_def from (
            select concat('H', {d.text("p_partkey % 700 + 1")}) as strongs_id, p_type as def from part where p_partkey % 3 = 0
            union all select concat('G', {d.text("p_partkey % 700 + 1")}) as strongs_id, p_type as def from part where p_partkey % 3 = 1) x group by strongs_id""",
    "segment": lambda d: """
        select conv_id * 100 + turn as id, conv_id as work_id, turn as seq, conv_id % 7 as chapter, text, role as heading,
               case when turn % 3 = 0 then 'translated' else 'tokenized' end as status from conversations""",
    "token": lambda d: f"""
        select id as segment_id, work_id, chapter, position, word, lower(word) as lemma, {d.matches("word", "^[A-Za-z]+$")} as is_word
        from ({d.tokens("segment", "id, work_id, chapter", "text")}) t""",
    "review_lock": lambda d: f"""
        select event_type as scope_type, concat(event_type, '.', {d.text("user_id % 40")}, '.', {d.text("user_id % 7")}) as scope_id, user_id,
               event_id, {d.seconds("ts")} as acquired, {d.seconds("ts")} + 600000000 * (1 + event_id % 3) as expires from events""",
    "rules": lambda d: """
        select p_partkey as id, p_brand as kind, p_type as source, p_name as target, p_size % 2 = 0 as active, p_size as note_no from part""",
    "old_state": lambda d: """
        select o_orderkey as k, o_custkey as owner, o_orderstatus as status, cast(floor(o_totalprice) as double) as score, o_orderpriority as note
        from orders where o_orderkey % 3 <> 0""",
    "delta": lambda d: """
        select o_orderkey as k, o_custkey % 100 as owner, 'ingested' as status, cast(floor(o_totalprice) % 1000 as double) as score,
               case when o_orderkey % 5 = 0 then null else 'delta' end as note
        from orders where o_orderkey % 3 <> 1""",
}


def needed(sql: str) -> tuple[list[str], list[str]]:
    """The views and base tables that a query reads, views in dependency order."""
    views: set[str] = set()
    tables: set[str] = set()

    def add(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+([a-z_]+)", text):
            if name in BASE:
                tables.add(name)
            elif name in CTES and name not in views:
                views.add(name)
                add(CTES[name](SPARK))

    add(sql)
    return [v for v in CTES if v in views], sorted(tables)


def with_views(sql: str, d: Dialect) -> str:
    views, _ = needed(sql)
    body = sql.strip()
    head = ",\n".join(f"{v} as ({CTES[v](d)})" for v in views)
    if not views:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Runs a query over the corpus views. The tables are named as arguments, not as
    temporary views, so that concurrent calls over other folders do not meet. given: base
    tables that are not read from the folder."""
    text = with_views(sql, SPARK)
    _, tables = needed(sql)
    for t in tables:
        text = re.sub(rf"(\bfrom|\bjoin)\s+{t}\b", rf"\1 {{{t}}} as {t}", text)
    text = re.sub(r"(\{\w+\}) as \w+ (as )?(?!(?:where|join|on|group|order|left|inner|lateral|union|limit|cross|semi|anti|having)\b)([a-z]\w*)", r"\1 as \3", text)
    return spark.sql(text, **{t: (given or {}).get(t) or spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def sql_query(name: str, text: Callable[[Dialect], str]) -> None:
    """Registers one SQL text as a query and as its own oracle in the other dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, text(SPARK))

    run.__doc__ = text(SPARK)
    query(name, with_views(text(DUCKDB), DUCKDB))(run)
