"""Composite reads: passages, statistics, propagation, scores, coverage, library and lemma pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.dialect import DUCKDB, Dialect
from ..plans.domain import run_sql, sql_query, with_views
from ..plans.storage import store

#: Links reach this many edges from an authority word at most.
MAX_DEPTH = 4


def _reach(d: Dialect, seeds: str) -> str:
    """(source_id, word_id, depth): words within MAX_DEPTH edges of a source word's own links.

    Edges are symmetrised and de-duplicated once; of a step only the new (source, word)
    pairs go on, which gives the same shortest depths as paths without revisits do."""
    steps = ["reach0 as (select distinct source_id, word_id, 0 as depth from seeds)"]
    for k in range(1, MAX_DEPTH + 1):
        seen = " union all ".join(f"select source_id, word_id from reach{i}" for i in range(k))
        steps.append(
            f"reach{k} as (select distinct r.source_id, e.b as word_id, {k} as depth from reach{k - 1} r join edges e on e.a = r.word_id "
            f"where not exists (select 1 from ({seen}) x where x.source_id = r.source_id and x.word_id = e.b))"
        )
    every = " union all ".join(f"select * from reach{i}" for i in range(MAX_DEPTH + 1))
    return f"""with seeds as ({seeds}), edges as (select distinct a, b from (
            select word_a_id as a, word_b_id as b from itl where method <> 'manual_empty' union all select word_b_id as a, word_a_id as b from itl where method <> 'manual_empty') z),
        {", ".join(steps)}, reached as ({every})"""


_SCORED = """with edges as (
        select word_a_id as a, word_b_id as b, method, confidence from itl where method <> 'manual_empty'
        union all select word_b_id as a, word_a_id as b, method, confidence from itl where method <> 'manual_empty'),
    live as (select id, translation_id, book_id, chapter, verse from translation_words where alignment_note is null),
    pairs as (select 1 as x, 2 as y union all select 2 as x, 3 as y),
    sides as (select x as own, y as other from pairs union all select y as own, x as other from pairs),
    best as (select w.id, s.other, w.book_id, w.chapter, w.verse, max(cast(case when o.id is null then 0 when e.method = 'manual' then 100 else coalesce(e.confidence, 0) end as double) / 100) as score
        from live w join sides s on s.own = w.translation_id left join edges e on e.a = w.id
        left join translation_words o on o.id = e.b and o.translation_id = s.other group by w.id, s.other, w.book_id, w.chapter, w.verse)"""

Q = {
    "c1_passage": lambda d: f"""
        select s.verse, s.word_position, s.id, s.word_text, s.strongs, coalesce(l.links, '') as links from source_words s left join (
            select source_id, {d.listagg(f"concat({d.text('tw_id')}, '/', method)", ",", "tw_id")} as links from (
                select k.source_id, k.tw_id, coalesce(c.method, '-') as method,
                       row_number() over (partition by k.source_id, k.tw_id order by c.score desc nulls last, c.method, k.id) as rn
                from word_links k left join link_confidence c on c.link_id = k.id) t where rn = 1 group by source_id) l on l.source_id = s.id""",
    "c1_target_words": lambda d: """
        select w.verse_id, w.id, w.word_position, w.word_text, b.method as best_method, b.score as best_score, e.method as edge_method from translation_words w
        left join (select k.tw_id, c.method, c.score, row_number() over (partition by k.tw_id order by c.score desc nulls last, c.method, k.id) as rn
            from word_links k join link_confidence c on c.link_id = k.id) b on b.tw_id = w.id and b.rn = 1
        left join (select word, method, row_number() over (partition by word order by case method when 'manual' then 0 when 'manual_empty' then 1 else 2 end, id) as rn from (
            select word_a_id as word, method, id from itl union all select word_b_id as word, method, id from itl) z) e on e.word = w.id and e.rn = 1""",
    "c2_link_detail": lambda d: f"""
        select w.translation_id, k.source_id, w.id as tw_id, w.word_text, {d.listagg(f"concat(c.method, '=', coalesce({d.text('cast(c.score * 1000 as int)')}, '-'))", ";", "c.method, c.score desc nulls last")} as confidences
        from word_links k join translation_words w on w.id = k.tw_id left join link_confidence c on c.link_id = k.id group by w.translation_id, k.source_id, k.id, w.id, w.word_text""",
    "c3_translation_stats": lambda d: f"""
        select t.strongs, t.phrase, t.n, t.total, t.rn, e.short_def from (
            select strongs, phrase, n, cast(sum(n) over (partition by strongs) as bigint) as total, cast(row_number() over (partition by strongs order by n desc, phrase) as bigint) as rn from (
                select strongs, phrase, count(*) as n from (
                    select {d.replace_all('s.strongs', '[A-Z]+$', '')} as strongs, s.id, {d.listagg('w.word_text', ' ', 'w.word_position, w.id')} as phrase
                    from source_words s join word_links k on k.source_id = s.id join translation_words w on w.id = k.tw_id and w.translation_id = 1
                    join link_confidence c on c.link_id = k.id and c.method = 'manual' group by s.strongs, s.id) o group by strongs, phrase) p) t
        left join strongs_entries e on e.strongs_id = {d.replace_all('t.strongs', '^([HG])0*', chr(92) + '1')} where t.rn <= 5""",
    "c5_topology": lambda d: """
        select 'star' as topology, a.code as a, b.code as b, b.id as rank from translations a join translations b on a.family = b.family and a.pivot and b.id <> a.id
        union all select 'chain' as topology, a.code as a, b.code as b, a.seq as rank from translations a join translations b on b.family = a.family and b.seq = a.seq + 1""",
    "c7_source_pivot": lambda d: """
        select distinct least(x.tw_id, y.tw_id) as word_a_id, greatest(x.tw_id, y.tw_id) as word_b_id, 100 as confidence from word_links x join word_links y on y.source_id = x.source_id
        join translation_words a on a.id = x.tw_id and a.translation_id = 1 join translation_words b on b.id = y.tw_id and b.translation_id = 2""",
    "c14_verse_score": lambda d: f"""
        {_SCORED}
        select book_id, chapter, verse, count(*) as positions, round(sum(score), 6) as total, round(100 * sum(score) / count(*), 6) as percent from best group by book_id, chapter, verse""",
    "c14_unlinked": lambda d: f"{_SCORED} select id from best group by id having max(score) = 0",
    "c22_alignment_coverage": lambda d: """
        select s.book_id, count(*) as joined, count(k.id) as aligned, count(distinct s.id) as words, count(distinct k.source_id) as words_aligned
        from source_words s left join word_links k on k.source_id = s.id group by s.book_id""",
    "c26_incremental_by_status": lambda d: "select status, count(*) as n, min(id) as next_id from segment group by status",
    "m23_lock_status": lambda d: """
        select scope_type, scope_id, user_id, expires from (select *, row_number() over (partition by scope_type, scope_id order by acquired desc, event_id desc) as rn from review_lock) t where rn = 1""",
    "c29_chapter_navigation": lambda d: """
        select book_id, chapter, verses, lag(chapter) over (partition by book_id order by chapter) as prev_chapter, lead(chapter) over (partition by book_id order by chapter) as next_chapter
        from (select book_id, chapter, count(*) as verses from verses group by book_id, chapter) t""",
    "c30_alignment_rows": lambda d: f"""
        select t.segment_id, b.row_no, {d.listagg('t.word', ' ', 't.position')} as text from token t join (
            select segment_id, position as lo, lead(position, 1, 1000000) over (partition by segment_id order by position) as hi,
                   cast(row_number() over (partition by segment_id order by position) - 1 as bigint) as row_no from token where position % 12 = 1) b
        on b.segment_id = t.segment_id and t.position >= b.lo and t.position < b.hi group by t.segment_id, b.row_no
        union all select id as segment_id, cast(-1 as bigint) as row_no, heading as text from segment""",
    "c31_word_link_model": lambda d: """
        select w.id as tw_id, max(case when c.method = 'manual' then 2 when c.method is not null then 1 else 0 end) as best from translation_words w
        left join word_links k on k.tw_id = w.id left join link_confidence c on c.link_id = k.id group by w.id""",
    "c19_group_validation": lambda d: """
        select segment_id, count(*) = max(position) and min(position) = 1 and count(distinct position) = count(*) as covers from (
            select segment_id, position - (select 0) as position from token where word is not null) t group by segment_id""",
    "r1_segment_tokens": lambda d: f"""
        select s.id, s.work_id, s.seq, coalesce(t.words, '') as words, coalesce(t.n, 0) as n from segment s left join (
            select segment_id, {d.listagg('word', ' ', 'position')} as words, count(*) as n from token group by segment_id) t on t.segment_id = s.id""",
    "r2_lemma_variants": lambda d: "select lemma, word, count(*) as freq, count(distinct work_id) as works from token where is_word group by lemma, word",
    "r2_lemma_page": lambda d: """
        select lemma, freq, number from (select lemma, freq, cast(row_number() over (order by freq desc, lemma) as bigint) as number from (
            select lemma, count(*) as freq from token where is_word group by lemma) t) u where number > 100 and number <= 200""",
    "r3_lemma_by_number": lambda d: """
        select lemma, number from (select lemma, cast(row_number() over (order by freq desc, lemma) as bigint) as number from (
            select lemma, count(*) as freq from token where is_word group by lemma) t) u where number = 301""",
    "r4_two_layers": lambda d: """
        select s.id, a.text as layer_a, b.text as layer_b from segment s left join (select work_id, seq, text from segment where heading = 'user') a on a.work_id = s.work_id and a.seq = s.seq
        left join (select work_id, seq, text from segment where heading = 'assistant') b on b.work_id = s.work_id and b.seq = s.seq + 1""",
    "r6_sections": lambda d: """
        select work_id, chapter, count(*) as sections, count(*) filter (where seq = 0) as unnumbered, min(id) as first_id from segment group by work_id, chapter""",
    "r7_anchors_by_layer": lambda d: f"""
        select work_id, {d.listagg("concat(heading, '->', status)", ';', 'seq, id')} as anchors from segment group by work_id""",
    "r9_verses_for_references": lambda d: """
        select r.ref, v.id from (select 'a' as ref, 3 as book_id, 1 as lo, 900 as hi union all select 'b', 4, 200, 2000) r join translation_verses v
        on v.translation_id = 1 and v.book_id = r.book_id and v.verse between r.lo and r.hi""",
    "r10_history_newest_first": lambda d: "select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as bigint) as age from events",
    "r11_proposal_timeline": lambda d: f"select user_id, {d.listagg('event_type', '>', 'ts, event_id')} as timeline, count(*) as events from events where event_type <> 'click' group by user_id",
    "r12_flag_counts": lambda d: "select source, count(*) as n, count(*) filter (where lang = 'en') as english from documents group by source",
    "r13_rule_order": lambda d: "select id, kind, source, target from rules where active order by case when kind like 'Brand#1%' then 0 else 1 end, length(source) desc, source, id",
    "r14_xref_source": lambda d: "select t.code, coalesce(m.source, t.code) as source from translations t left join (select 'T1' as code, 'T3' as source) m on m.code = t.code",
    "r15_authority": lambda d: "select b.code, a.code as authority from translations b join translations a on a.family = b.family and a.authority and a.id <> b.id",
    "r16_verse_pair_links": lambda d: """
        select i.id, a.word_text as a, b.word_text as b, i.method from itl i join translation_words a on a.id = i.word_a_id and a.translation_id = 1 join translation_words b on b.id = i.word_b_id and b.translation_id = 2""",
    "r17_entry_with_count": lambda d: f"""
        select e.strongs_id, e.short_def, coalesce(c.n, 0) as occurrences from strongs_entries e left join (
            select {d.replace_all(d.replace_all('strongs', '[A-Z]+$', ''), '^([HG])0*', chr(92) + '1')} as strongs_id, count(*) as n from source_words group by 1) c on c.strongs_id = e.strongs_id""",
    "r18_scope_read": lambda d: f"""
        select w.translation_id, w.verse, {d.listagg('w.word_text', ' ', 'w.word_position')} as words, count(i.a) as edges from translation_words w
        left join (select distinct word_a_id as a from itl) i on i.a = w.id where w.book_id = 7 group by w.translation_id, w.verse""",
    "r19_library": lambda d: "select source, count(*) as targets, min(target) as target from rules where active group by source having count(*) > 1",
    "r20_manual_hints": lambda d: """
        select strongs, form, cast(sum(n) as bigint) as n from (
            select s.strongs, w.word_text as form, count(*) as n from word_links k join source_words s on s.id = k.source_id join translation_words w on w.id = k.tw_id
            join link_confidence c on c.link_id = k.id and c.method = 'manual' where s.lang = 'HE' group by 1, 2
            union all select s.strongs, w.word_text as form, count(*) as n from word_links k join source_words s on s.id = k.source_id join translation_words w on w.id = k.tw_id
            join link_confidence c on c.link_id = k.id and c.method = 'manual' where s.lang = 'GR' group by 1, 2
            union all select strongs, '__empty__' as form, count(*) as n from source_words s where not exists (select 1 from word_links k where k.source_id = s.id) group by strongs) u group by strongs, form""",
    "r21_verse_walk": lambda d: """
        select verse, ordinal from (select verse, cast(row_number() over (order by book_id, chapter, verse) as bigint) as ordinal from verses where book_id = 2) t where ordinal between 5 and 34""",
    "r26_parser_diagnostics": lambda d: f"select count(*) as notes, count(*) filter (where {d.matches('text', '[0-9]+')}) as resolved from segment",
    "s19_lemma_view": lambda d: "select lemma, count(*) as freq, count(distinct segment_id) as n_segments from token where is_word group by lemma",
    "s4_fetch_join": lambda d: "select k.id, k.source_id, w.word_text, c.method, c.score from word_links k left join link_confidence c on c.link_id = k.id left join translation_words w on w.id = k.tw_id",
    "t1_unknown_word_rate": lambda d: """
        select t.segment_id, count(*) as words, count(*) filter (where v.lemma is null) as unknown from token t left join (
            select lemma from token where is_word group by lemma having count(*) > 2) v on v.lemma = t.lemma where t.is_word group by t.segment_id""",
    "t8_shared_words": lambda d: """
        select a.segment_id as a, b.segment_id as b, count(*) as shared from (select distinct segment_id, work_id, lemma from token) a
        join (select distinct segment_id, work_id, lemma from token) b on b.work_id = a.work_id and b.lemma = a.lemma and b.segment_id > a.segment_id group by 1, 2 having count(*) >= 2""",
    # --- scalar functions
    "f1_normalised_strongs": lambda d: f"select id, {d.replace_all(d.replace_all('strongs', '[A-Za-z]+$', ''), '^([HG])0*([0-9])', chr(92) + '1' + chr(92) + '2')} as strongs_base from source_words",
    "f2_padded_strongs": lambda d: f"select strongs_id, concat(substr(strongs_id, 1, 1), lpad({d.extract('strongs_id', '([0-9]+)')}, 4, '0'), {d.extract('strongs_id', '([A-Z])$')}) as padded from strongs_entries",
    "f3_root_strongs": lambda d: f"select id, cast({d.extract('strongs', '^[HG]0*([0-9]+)')} as bigint) as number from source_words where cast({d.extract('strongs', '^[HG]0*([0-9]+)')} as bigint) < 9000",
    "f8_verse_tokens": lambda d: f"select segment_id, position, {d.replace_all(d.replace_all('word', '^[^A-Za-z0-9]+'), '[^A-Za-z0-9]+$')} as bare from token",
    "f9_word_offsets": lambda d: """
        select segment_id, position, cast(sum(length(word) + 1) over (partition by segment_id order by position rows between unbounded preceding and current row) - length(word) - 1 as bigint) as char_start from token""",
    "f11_latin_form": lambda d: "select distinct lemma, translate(lower(lemma), 'vj', 'ui') as norm from token where is_word",
    "f16_separators": lambda d: f"select id, {d.replace_all('word_text', '[/.]')} as clean from source_words",
    "f30_reference_code": lambda d: f"""
        select distinct book_id, concat(usfm_code, '.', {d.text('chapter')}, '.', {d.text('lo')}, '-', {d.text('hi')}) as ref from (
            select v.book_id, b.usfm_code, v.chapter, min(v.verse) as lo, max(v.verse) as hi from verses v join books b on b.id = v.book_id group by 1, 2, 3) t""",
    "f36_features": lambda d: f"select doc_id, {d.extract('props', 'Case=([A-Za-z]+)')} as feature_case, {d.extract('props', 'Number=([A-Za-z]+)')} as feature_number from (select doc_id, concat('Case=Nom|Number=', case when doc_id % 2 = 0 then 'Sing' else 'Plur' end) as props from documents) t",
    "f40_marker_stripping": lambda d: f"select id, {d.replace_all(d.replace_all(chr(34) + 'text' + chr(34) if False else 'marked', '⟦H:[^⟧]*⟧', ' '), '⟦C:([^‖]*)‖[^⟧]*⟧', chr(92) + '1')} as plain from (select id, concat('⟦H:', heading, '⟧', '⟦C:new‖old⟧ ', status) as marked from segment) t",
    "f44_letter_ordinal": lambda d: "select distinct l_linenumber as n, case when l_linenumber <= 26 then chr(cast(96 + l_linenumber as int)) else concat('a', chr(cast(96 + l_linenumber - 26 as int))) end as letter from lineitem",
    "f45_reference_parts": lambda d: f"""
        select scope_id, {d.extract('scope_id', '^([a-z_]+)\\.')} as kind, cast({d.extract('scope_id', '^[a-z_]+\\.([0-9]+)')} as bigint) as a, cast({d.extract('scope_id', '([0-9]+)$')} as bigint) as b from (select distinct scope_id from review_lock) t""",
    "f50_case_insensitive_lookup": lambda d: "select id, upper(usfm_code) as code from books where lower(name) = lower((select max(name) from books))",
    "f52_half_even": lambda d: f"select id, {'bround' if d.spark else 'round_even'}(cast(word_position as double) / 2.0{'' if d.spark else ', 0'}) as half from source_words",
    "p5_optional_filter": lambda d: "select id from segment where (cast(null as string) is null or status = 'x') and (cast('user' as string) is null or heading = 'user')" if d.spark else "select id from segment where (cast(null as varchar) is null or status = 'x') and (cast('user' as varchar) is null or heading = 'user')",
}

for _name, _text in Q.items():
    sql_query(_name, _text)


_EDGES = """select word_a_id as a, word_b_id as b from itl where method <> 'manual_empty'
    union all select word_b_id as a, word_a_id as b from itl where method <> 'manual_empty'"""


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, word_id, depth): words within MAX_DEPTH edges of a source word's own links,
    with the length of the shortest way.

    seeds: (source_id, word_id); edges: (a, b), in both directions. Breadth first: of a step
    only the new pairs go on. Each step is stored, so the plan of one does not hold those before."""
    edges = store(edges.distinct(), "reach-edges")
    front = store(seeds.distinct().withColumn("depth", F.lit(0)), "reach-0")
    found = front
    for depth in range(1, MAX_DEPTH + 1):
        step = front.join(edges, F.col("word_id") == F.col("a")).select("source_id", F.col("b").alias("word_id")).distinct()
        front = store(step.join(found, ["source_id", "word_id"], "left_anti").withColumn("depth", F.lit(depth)), f"reach-{depth}")
        found = found.unionByName(front)
    return found


_OWN = "select source_id, tw_id as word_id from word_links"


@query(
    "c4_propagated_suggestions",
    with_views(
        f"""{_reach(DUCKDB, "select source_id, tw_id as word_id from word_links where id < 1000000000000")}
        select r.source_id, w.translation_id, r.word_id, min(r.depth) as depth from reached r join translation_words w on w.id = r.word_id
        where r.depth > 0 and not exists (select 1 from word_links k where k.source_id = r.source_id and k.tw_id = r.word_id) group by r.source_id, w.translation_id, r.word_id""",
        DUCKDB,
    ),
)
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reached(run_sql(spark, sf_dir, f"{_OWN} where id < 1000000000000"), run_sql(spark, sf_dir, _EDGES)).where("depth > 0")
    new = found.join(run_sql(spark, sf_dir, _OWN).distinct(), ["source_id", "word_id"], "left_anti")
    words = run_sql(spark, sf_dir, "select id as word_id, translation_id from translation_words")
    return new.join(words, "word_id").select("source_id", "translation_id", "word_id", "depth")


@query("u4_reachability", with_views(f"{_reach(DUCKDB, _OWN)} select source_id, word_id, min(depth) as depth from reached group by source_id, word_id", DUCKDB))
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached(run_sql(spark, sf_dir, _OWN), run_sql(spark, sf_dir, _EDGES))
