"""Filters, joins, aggregates, windows, ordering and set operations over the corpus tables."""

from __future__ import annotations

from ..plans.domain import sql_query

Q = {
    # --- projections, filters, predicates
    "p1_natural_key": lambda d: "select id, word_text, strongs from source_words where book_id = 3 and lang = 'HE'",
    "p2_in_list": lambda d: "select id, word_text from translation_words where word_position in (1, 3, 5) and translation_id = 1",
    "p3_member_of_array": lambda d: f"select o_orderkey, o_orderpriority from orders where {'array_contains(array(1, 2, 3), o_orderkey % 10)' if d.spark else 'list_contains([1, 2, 3], o_orderkey % 10)'}",
    "p4_either_endpoint": lambda d: """
        select id, word_a_id, word_b_id from (
            select i.* from itl i join translation_words w on w.id = i.word_a_id where w.book_id = 5
            union select i.* from itl i join translation_words w on w.id = i.word_b_id where w.book_id = 5) u""",
    "p6_null_safe_equal": lambda d: """
        select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on b.o_orderkey = a.o_orderkey + 1
        where (case when a.o_orderkey % 4 = 0 then null else a.o_orderstatus end) is not distinct from (case when b.o_orderkey % 4 = 1 then null else b.o_orderstatus end)""",
    "p7_regex": lambda d: f"select strongs_id, short_def from strongs_entries where {d.matches('strongs_id', '^H[0-9]+$')} and not {d.matches('lower(short_def)', 'brushed|plated')}",
    "p8_script_ranges": lambda d: f"select doc_id from documents where {d.matches('text', '[\\u00c0-\\u024f]' if d.spark else '[À-ɏ]')}",
    "p9_like_prefix": lambda d: "select scope_id, user_id, event_id from review_lock where scope_id like 'click.1%'",
    "p10_search_or_number": lambda d: f"""
        select p_partkey, p_name from part where p_name ilike '%e%1%' or p_partkey = cast({d.extract("'l301'", "^l?([0-9]+)$")} as bigint)""",
    "p11_dynamic_filters": lambda d: "select k, owner, status from old_state where (null is null or status = null) and status = 'O' and score > 1000",
    "p12_case": lambda d: """
        select r_regionkey, case r_name when 'ASIA' then 'a' when 'EUROPE' then 'e' else 'x' end as simple,
               case when r_regionkey > 2 then 'high' else 'low' end as searched from region""",
    "p13_flag_from_null": lambda d: """
        select s.id, cast(case when k.source_id is not null then 1 else 0 end as bigint) as linked
        from source_words s left join (select distinct source_id from word_links) k on k.source_id = s.id""",
    "p14_falsy_fallback": lambda d: "select p_partkey, coalesce(nullif(case when p_size % 3 = 0 then '' else p_brand end, ''), p_type) as shown from part",
    "p15_casts": lambda d: "select id, cast(confidence as double) / 100.0 as score, cast(method = 'manual' as int) as manual from itl",
    "p16_scalar_subquery": lambda d: """
        select r.id, r.kind, coalesce(c.n, 0) as used from rules r left join (select l_partkey as id, count(*) as n from lineitem group by l_partkey) c on c.id = r.id""",
    "p17_uncorrelated_scalar": lambda d: "select id, code from translations where family = (select family from translations where authority limit 1)",
    "p18_existence_probe": lambda d: "select cast(count(*) as bigint) as found from (select 1 as x from word_links where notes is not null limit 1) t",
    "p19_all_ids_exist": lambda d: "select count(distinct id) = 3 as all_known from translation_words where id in (10000008 + 1, 10000008 + 2, 10000008 + 3)",
    "p20_role_gate": lambda d: """
        select t.code, g.role from translations t join (select 'T1' as code, 'editor' as role union all select 'T2', 'reviewer') g on g.code = t.code""",
    # --- joins
    "j1_inner_chain": lambda d: """
        select b.usfm_code, t.code, count(*) as links from word_links k join translation_words w on w.id = k.tw_id join translation_verses v on v.id = w.verse_id
        join translations t on t.id = v.translation_id join books b on b.id = v.book_id group by b.usfm_code, t.code""",
    "j2_filter_in_on": lambda d: """
        select s.id, count(w.id) as linked_in_2 from source_words s left join word_links k on k.source_id = s.id
        left join translation_words w on w.id = k.tw_id and w.translation_id = 2 group by s.id""",
    "j3_composite_expression_key": lambda d: """
        select s.id, x.n from segment s left join (select work_id, coalesce(nullif(chapter, 3), 0) as chapter, count(*) as n from segment group by 1, 2) x
        on x.work_id = s.work_id and x.chapter = coalesce(nullif(s.chapter, 3), 0)""",
    "j4_star_pairs": lambda d: """
        select a.code as a, b.code as b from translations a join translations b on a.family = b.family and a.authority and not b.authority""",
    "j5_chain_pairs": lambda d: "select a.code as a, b.code as b from translations a join translations b on b.family = a.family and b.seq = a.seq + 1",
    "j6_verse_pairs": lambda d: """
        select a.id as a, b.id as b, a.book_id, a.chapter, a.verse from translation_verses a join translation_verses b
        on b.book_id = a.book_id and b.chapter = a.chapter and b.verse = a.verse and a.translation_id = 1 and b.translation_id = 2""",
    "j7_either_key_join": lambda d: """
        select distinct a, b from (
            select x.id as a, y.id as b from source_words x join source_words y on x.strongs = y.strongs and x.verse = y.verse and x.id < y.id
            union all select x.id as a, y.id as b from source_words x join source_words y on x.word_text = y.word_text and x.verse = y.verse and x.id < y.id) u""",
    "j8_either_endpoint_join": lambda d: """
        select w.id, count(*) as edges from translation_words w join (
            select word_a_id as word_id from itl union all select word_b_id as word_id from itl) e on e.word_id = w.id group by w.id""",
    "j9_verse_range": lambda d: """
        select r.id, v.id as verse_id from (select id, book_id, chapter, verse as v1, verse + 60 as v2 from translation_verses where translation_id = 1) r
        left join translation_verses v on v.translation_id = 2 and v.book_id = r.book_id and v.chapter = r.chapter and v.verse between r.v1 and r.v2""",
    "j10_containment": lambda d: """
        select t.segment_id, t.position, b.row_no from token t join (
            select segment_id, position as lo, lead(position, 1, 1000000) over (partition by segment_id order by position) as hi,
                   cast(row_number() over (partition by segment_id order by position) as bigint) as row_no
            from token where position % 10 = 1) b on b.segment_id = t.segment_id and t.position >= b.lo and t.position < b.hi""",
    "j11_as_of": lambda d: """
        select user_id, event_id, max(case when event_type = 'purchase' then event_id end) over
               (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events""",
    "j12_top1_confidence": lambda d: """
        select id, method, score from (
            select k.id, c.method, c.score, row_number() over (partition by k.id order by c.score desc nulls last, c.method) as rn
            from word_links k left join link_confidence c on c.link_id = k.id) t where rn = 1""",
    "j13_best_link_per_target": lambda d: """
        select w.id, b.source_id, b.score from translation_words w left join (
            select k.tw_id, k.source_id, c.score, row_number() over (partition by k.tw_id order by c.score desc nulls last, k.id) as rn
            from word_links k left join link_confidence c on c.link_id = k.id) b on b.tw_id = w.id and b.rn = 1""",
    "j14_priority_lateral": lambda d: """
        select id, other, method from (
            select e.id, e.other, e.method, row_number() over (partition by e.id order by case e.method when 'manual' then 0 when 'needleman' then 1 else 2 end, e.link_id) as rn
            from (select word_a_id as id, word_b_id as other, method, id as link_id from itl union all select word_b_id as id, word_a_id as other, method, id as link_id from itl) e) t
        where rn = 1""",
    "j15_constant_pair": lambda d: """
        select a.id as a, b.id as b from (select id from translations where code = 'T1') a join (select id from translations where code = 'T2') b on true""",
    "j16_semi": lambda d: "select s.id from source_words s where exists (select 1 from word_links k where k.source_id = s.id and k.notes is not null)",
    "j17_unlinked_words": lambda d: """
        select s.id, s.strongs from source_words s where not exists (select 1 from word_links k where k.source_id = s.id)
        and not exists (select 1 from itl i where i.word_a_id = s.id and i.method = 'manual_empty')""",
    "j18_left_is_null": lambda d: "select w.id from translation_words w left join word_links k on k.tw_id = w.id where k.id is null",
    "j19_not_in": lambda d: "select k, status from old_state where k not in (select k from delta where k is not null)",
    "j20_lookup": lambda d: """
        select s.id, h.n as hints from source_words s join (
            select x.strongs, count(*) as n from word_links k join source_words x on x.id = k.source_id join link_confidence c on c.link_id = k.id and c.method = 'manual' group by x.strongs) h
        on h.strongs = s.strongs""",
    "j21_direct_else_propagated": lambda d: """
        select source_id, tw_id, true as direct from word_links where id < 1000000000000
        union all
        select distinct k.source_id, i.word_b_id as tw_id, false as direct from word_links k join itl i on i.word_a_id = k.tw_id and i.method <> 'manual_empty'
        where not exists (select 1 from word_links x where x.source_id = k.source_id and x.tw_id = i.word_b_id)""",
    "j22_attach_markers": lambda d: f"""
        select w.id, m.refs from translation_words w left join (
            select l_orderkey as o, cast(l_linenumber as bigint) as n, {d.listagg(d.text("l_suppkey"), ",", "l_suppkey, l_partkey, l_quantity, l_extendedprice")} as refs
            from lineitem where l_returnflag = 'R' group by l_orderkey, l_linenumber) m on m.o = w.verse and m.n = w.word_position where w.translation_id = 1""",
    # --- aggregates
    "a1_group_count": lambda d: "select method, count(*) as n from link_confidence group by method",
    "a2_distinct_rows": lambda d: "select count(*) as n from (select distinct book_id, chapter, verse from source_words where lang = 'HE') t",
    "a3_conditional_distinct": lambda d: """
        select s.lang, count(distinct s.id) as words, count(distinct k.source_id) as linked, count(distinct case when c.method = 'manual' then k.source_id end) as by_hand
        from source_words s left join word_links k on k.source_id = s.id left join link_confidence c on c.link_id = k.id group by s.lang""",
    "a4_nested_rows": lambda d: f"""
        select s.id, {d.listagg(f"concat({d.text('w.id')}, ':', w.word_text)", "|", "w.id", "w.translation_id = 1")} as links
        from source_words s left join word_links k on k.source_id = s.id left join translation_words w on w.id = k.tw_id group by s.id""",
    "a5_ordered_text": lambda d: f"select verse_id, {d.listagg('word_text', ' ', 'word_position')} as text from translation_words group by verse_id",
    "a6_distinct_array": lambda d: f"""
        select work_id, {d.listagg('heading', ',', "case heading when 'user' then 0 when 'assistant' then 1 else 2 end, heading")} as headings
        from (select distinct work_id, heading from segment) t group by work_id""",
    "a7_filtered_counts": lambda d: "select work_id, count(*) as segments, count(*) filter (where status = 'translated') as translated from segment group by work_id",
    "a8_min_max": lambda d: "select book_id, max(chapter) as chapters, min(verse) as first_verse, max(word_text) as last_word from source_words group by book_id",
    "a9_lemma_stats": lambda d: "select lemma, count(*) as freq, count(distinct segment_id) as n_segments from token where is_word group by lemma",
    "a10_corpus_stats": lambda d: """
        select s.work_id, count(*) as segments, cast(sum(coalesce(t.words, 0)) as bigint) as words, max(l.lemmas) as lemmas from segment s
        left join (select segment_id, count(*) filter (where is_word) as words from token group by segment_id) t on t.segment_id = s.id
        left join (select work_id, count(distinct lemma) filter (where is_word) as lemmas from token group by work_id) l on l.work_id = s.work_id group by s.work_id""",
    "a11_two_levels": lambda d: f"""
        select strongs, cast(sum(n) as bigint) as total, count(*) as phrases from (
            select strongs, phrase, count(*) as n from (
                select s.id, s.strongs, {d.listagg('w.word_text', ' ', 'w.word_position, w.id')} as phrase from source_words s join word_links k on k.source_id = s.id
                join translation_words w on w.id = k.tw_id and w.translation_id = 1 group by s.id, s.strongs) x group by strongs, phrase) y group by strongs""",
    "a12_having_regex": lambda d: f"select lemma, count(*) as freq from token where {d.matches('word', '^[a-z][a-z][a-z]+$')} group by lemma having count(*) >= 3",
    "a13_first_appearance": lambda d: "select heading, min(id) as first_id from segment group by heading order by first_id",
    "a14_coverage_report": lambda d: """
        select 'HE' as testament, count(distinct s.id) as words, count(distinct k.source_id) as linked, count(distinct case when c.method = 'positional' then k.id end) as positional
        from source_words s left join word_links k on k.source_id = s.id left join link_confidence c on c.link_id = k.id where s.lang = 'HE'
        union all
        select 'GR' as testament, count(distinct s.id) as words, count(distinct k.source_id) as linked, count(distinct case when c.method = 'positional' then k.id end) as positional
        from source_words s left join word_links k on k.source_id = s.id left join link_confidence c on c.link_id = k.id where s.lang = 'GR'""",
    "a15_score_rollup": lambda d: """
        select book_id, chapter, cast(sum(total) as bigint) as total, cast(sum(positions) as bigint) as positions, min(case when total * 1000 < positions * 999 then verse end) as first_gap from (
            select s.book_id, s.chapter, s.verse, count(distinct k.source_id) as total, count(distinct s.id) as positions
            from source_words s left join word_links k on k.source_id = s.id group by s.book_id, s.chapter, s.verse) v group by book_id, chapter""",
    "a16_word_frequency": lambda d: "select lower(word) as word, count(*) as n from token where is_word group by lower(word)",
    "a17_dominant_value": lambda d: """
        select strongs, form, n, total from (
            select strongs, form, n, cast(sum(n) over (partition by strongs) as bigint) as total, row_number() over (partition by strongs order by n desc, form) as rn from (
                select s.strongs, w.word_text as form, count(*) as n from word_links k join source_words s on s.id = k.source_id join translation_words w on w.id = k.tw_id group by 1, 2) x) y
        where rn = 1 and n >= 3 and 2 * n >= total""",
    "a18_canonical_variant": lambda d: """
        select lemma, word, n from (select lemma, word, n, row_number() over (partition by lemma order by n desc, word) as rn from (
            select lemma, word, count(*) as n from token group by lemma, word) x) y where rn = 1""",
    "a19_contents": lambda d: "select distinct work_id, chapter, heading from segment",
    "a20_key_value_counts": lambda d: "select user_id, count(*) as n from events group by user_id",
    "a21_group_by_primary_key": lambda d: """
        select s.id, s.word_text, s.strongs, coalesce(k.n, 0) as links from source_words s left join (select source_id, count(*) as n from word_links group by source_id) k on k.source_id = s.id""",
    # --- windows
    "w1_top_n_per_group": lambda d: """
        select strongs, form, n, rn from (select strongs, form, n, cast(row_number() over (partition by strongs order by n desc, form) as bigint) as rn from (
            select s.strongs, w.word_text as form, count(*) as n from word_links k join source_words s on s.id = k.source_id join translation_words w on w.id = k.tw_id group by 1, 2) x) y where rn <= 3""",
    "w2_frequency_number": lambda d: "select lemma, freq, cast(row_number() over (order by freq desc, lemma) as bigint) as number from (select lemma, count(*) as freq from token where is_word group by lemma) t",
    "w3_distinct_on": lambda d: """
        select source_id, tw_id, method from (select k.source_id, k.tw_id, c.method, row_number() over (partition by k.source_id, k.tw_id order by c.score desc nulls last, c.method, k.id) as rn
            from word_links k join link_confidence c on c.link_id = k.id) t where rn = 1""",
    "w4_neighbours": lambda d: "select id, lag(id) over (partition by work_id order by seq) as prev_id, lead(id) over (partition by work_id order by seq) as next_id from segment where length(text) > 20",
    "w5_next_boundary": lambda d: """
        select segment_id, position as lo, lead(position, 1, n + 1) over (partition by segment_id order by position) as hi from (
            select segment_id, position, count(*) over (partition by segment_id) as n from token) t where position % 10 = 1""",
    "w6_occurrence_number": lambda d: "select segment_id, position, lemma, cast(row_number() over (partition by segment_id, lemma order by position) as bigint) as occurrence from token",
    "w7_gap_runs": lambda d: f"""
        select user_id, event_id, cast(sum(new_run) over (partition by user_id order by moment, event_id rows between unbounded preceding and current row) as bigint) as run from (
            select user_id, event_id, moment, case when moment - lag(moment) over (partition by user_id order by moment, event_id) > 3600000000 then 1 else 0 end as new_run
            from (select user_id, event_id, {d.seconds("ts")} as moment from events) e) t""",
    "w8_words_before_marker": lambda d: """
        select segment_id, position, cast(sum(case when is_word then 1 else 0 end) over (partition by segment_id order by position rows between unbounded preceding and current row) as bigint) as words_before from token""",
    "w9_first_of_chapter": lambda d: "select id, seq = min(seq) over (partition by work_id, chapter) as is_first from segment",
    # --- ordering, limits
    "o1_null_order": lambda d: "select id, confidence from itl order by confidence asc nulls first, id",
    "o2_priority_sort": lambda d: "select code, family from translations order by case family when 'new' then 0 else 1 end, id",
    "o3_page": lambda d: "select id, heading from segment order by id limit 30 offset 60",
    "o4_shared_page": lambda d: """
        with page as (select verse, min(book_id) as book_id from source_words group by verse order by verse limit 30 offset 30)
        select p.verse, count(s.id) as words, count(k.source_id) as linked from page p join source_words s on s.verse = p.verse
        left join (select distinct source_id from word_links) k on k.source_id = s.id group by p.verse""",
    "o5_top_k": lambda d: "select strongs, count(*) as n from source_words group by strongs order by n desc, strongs limit 50",
    "o6_literal_rank": lambda d: "select t.code, r.rank from translations t join (select 'T3' as code, 1 as rank union all select 'T1', 2 union all select 'T2', 3) r on r.code = t.code order by r.rank",
    "o7_merged_lists": lambda d: """
        select kind, id, moment from (select 'lock' as kind, event_id as id, acquired as moment from review_lock
            union all select 'lapse' as kind, event_id as id, expires as moment from review_lock) t order by moment desc, kind, id""",
    "o8_keyset_neighbours": lambda d: "select c.chapter, (select max(x.chapter) from segment x where x.chapter < c.chapter) as prev, (select min(x.chapter) from segment x where x.chapter > c.chapter) as next from (select distinct chapter from segment) c",
    # --- sets, recursion
    "u1_union_all": lambda d: "select 'HE' as lang, count(*) as n from source_words where lang = 'HE' union all select 'GR' as lang, count(*) as n from source_words where lang = 'GR'",
    "u2_symmetric_edges": lambda d: "select word_a_id as a, word_b_id as b from itl union all select word_b_id as a, word_a_id as b from itl",
    "u6_library_over_defaults": lambda d: """
        select source, target, origin from (select source, target, origin, row_number() over (partition by source order by case origin when 'library' then 0 else 1 end, target) as rn from (
            select source, target, 'default' as origin from rules where active union all select source, concat(target, '!') as target, 'library' as origin from rules where not active) x) y where rn = 1""",
}

for _name, _text in Q.items():
    sql_query(_name, _text)
