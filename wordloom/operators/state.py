"""Table mutations as pure functions from an old state and a change to the new state.

Parquet tables have no in-place update, so every function returns the whole new
table.  Keys are lists of column names; equal keys match null-safely only where said.
All are equi-joins on the key: nothing is collected, and a state laid out by its
key (bucketed) is joined without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.dialect import DUCKDB
from ..plans.domain import run_sql, with_views

Keys = Sequence[str]


def insert_absent(old: DataFrame, delta: DataFrame, keys: Keys) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows of delta whose key is new; one of equal keys in delta."""
    fresh = first_by(delta, keys, [F.col(c).asc_nulls_last() for c in delta.columns])
    return old.unionByName(fresh.join(old, list(keys), "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, delta: DataFrame, keys: Keys, merge: dict[str, Column] | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE. Without `merge` delta's row replaces; else `merge` gives columns
    of the row that both sides have as expressions over o.* (old) and d.* (delta)."""
    if merge is None:
        return old.join(delta, list(keys), "left_anti").unionByName(delta)
    o, d = old.withColumn("_o", F.lit(True)).alias("o"), delta.withColumn("_d", F.lit(True)).alias("d")
    on = [F.col(f"o.{k}") == F.col(f"d.{k}") for k in keys]
    both = o.join(d, on, "full")
    columns = []
    for c in old.columns:
        new = F.col(f"d.{c}") if c in delta.columns else F.lit(None)
        shared = merge.get(c, F.col(f"o.{c}"))
        columns.append(F.when(F.col("_o").isNull(), new).when(F.col("_d").isNull(), F.col(f"o.{c}")).otherwise(shared).alias(c))
    return both.select(*columns)


def keep_first_creator(old: DataFrame, delta: DataFrame, keys: Keys, creator: str) -> DataFrame:
    """Delta's values win, but an existing creator stays."""
    merge = {c: F.col(f"d.{c}") for c in old.columns if c not in keys and c != creator}
    return upsert(old, delta, keys, merge | {creator: F.coalesce(F.col(f"o.{creator}"), F.col(f"d.{creator}"))})


def upsert_with_reset(old: DataFrame, delta: DataFrame, keys: Keys, content: str, status: str, reset: str) -> DataFrame:
    """Delta's values win; the status goes back to `reset` where the content changed."""
    same = F.col(f"o.{content}").eqNullSafe(F.col(f"d.{content}"))
    merge = {c: F.col(f"d.{c}") for c in old.columns if c not in keys}
    return upsert(old, delta, keys, merge | {status: F.when(same, F.col(f"o.{status}")).otherwise(F.lit(reset))})


def upsert_if(old: DataFrame, delta: DataFrame, keys: Keys, allowed: Column) -> DataFrame:
    """DO UPDATE ... WHERE: an existing row gives way only where `allowed` (over o.* and d.*) holds."""
    merge = {c: F.when(F.coalesce(allowed, F.lit(False)), F.col(f"d.{c}")).otherwise(F.col(f"o.{c}")) for c in old.columns if c not in keys}
    return upsert(old, delta, keys, merge)


def upsert_partial(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """A unique index on non-null keys only: rows without a key are appended as they are."""
    keyed = upsert(old.where(F.col(key).isNotNull()), delta.where(F.col(key).isNotNull()), [key])
    return keyed.unionByName(old.where(F.col(key).isNull())).unionByName(delta.where(F.col(key).isNull()))


def with_new_ids(old: DataFrame, delta: DataFrame, order: Keys, id_column: str = "id") -> DataFrame:
    """delta with ids that follow old's largest, in the order of the natural key.

    Numbers are dealt by range partition: rows of a range are numbered within it
    and shifted by the rows of the ranges before, so no task sees all rows."""
    n = max(2, int(delta.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = delta.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    shift = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))  # one row
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_own", own).join(F.broadcast(shift), "_part").join(F.broadcast(top))
    return out.withColumn(id_column, F.col("_top") + F.col("_shift") + F.col("_own")).drop("_part", "_own", "_shift", "_top")


def replace_children(old: DataFrame, parents: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """Deletes the rows of the given parents, then inserts."""
    return old.join(parents.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_rows(old: DataFrame, gone: Column, new: DataFrame) -> DataFrame:
    """Rows of old for which `gone` is false, and every row of new, whatever keys the two share."""
    return old.where(~gone).unionByName(new)


def delete_where_exists(old: DataFrame, doomed: DataFrame, keys: Keys, keep: DataFrame | None = None) -> DataFrame:
    """Deletes rows whose key is in doomed and not in keep."""
    gone = doomed.select(*keys).distinct()
    if keep is not None:
        gone = gone.join(keep.select(*keys), list(keys), "left_anti")
    return old.join(gone, list(keys), "left_anti")


def first_by(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order` (null keys are keys)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_keep_min(df: DataFrame, keys: Keys, id_column: str = "id") -> DataFrame:
    """Rows with a null in the key stay; of the others the smallest id per key."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    return first_by(df.where(full), keys, [F.col(id_column)]).unionByName(df.where(~full))


def update_from(old: DataFrame, source: DataFrame, keys: Keys, columns: Keys) -> DataFrame:
    """UPDATE ... FROM: columns of matched rows come from source, null included."""
    hit = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = old.join(hit, list(keys), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def set_where(old: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    return old.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))


def canonical_edge(links: DataFrame, a: str = "word_a_id", b: str = "word_b_id") -> DataFrame:
    """The smaller endpoint first."""
    return links.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def approve(links: DataFrame, words: DataFrame) -> DataFrame:
    """Every link that touches any of the words becomes manual, score 1, without confidence
    (explicitly empty ones too)."""
    w = words.select(F.col("id").alias("_w")).distinct()
    hit = links.join(w, F.col("word_a_id") == F.col("_w"), "left_semi").select("id").union(links.join(w, F.col("word_b_id") == F.col("_w"), "left_semi").select("id"))
    out = links.join(hit.distinct().withColumn("_hit", F.lit(True)), "id", "left")
    changed = {"method": F.lit("manual"), "confidence": F.lit(None).cast("long")}
    return out.select(*[F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in links.columns], F.when(F.col("_hit"), F.lit(1.0)).alias("score"))


def save_links(links: DataFrame, empty: DataFrame, source_id: int, translation_id: int, targets: Sequence[int], words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the links of a source word in one translation; no targets marks it as empty by hand."""
    if source_id <= 0 or translation_id <= 0:
        raise ValueError("ids are positive")
    spark = links.sparkSession
    scope = words.where(F.col("translation_id") == translation_id).select(F.col("id").alias("tw_id"))
    doomed = links.where(F.col("source_id") == source_id).join(scope, "tw_id", "left_semi").select("id")
    kept = links.join(doomed, "id", "left_anti")
    mark = spark.createDataFrame([(source_id, translation_id)], "source_id long, translation_id long")
    if not targets:
        return kept, upsert(empty, mark, ["source_id", "translation_id"])
    new = spark.createDataFrame([(int(t),) for t in targets], "tw_id long").distinct()
    new = with_new_ids(links, new.withColumn("source_id", F.lit(source_id).cast("long")).withColumn("notes", F.lit(None).cast("string")), ["tw_id"])
    return kept.unionByName(new.select(*links.columns)), empty.join(mark, ["source_id", "translation_id"], "left_anti")


def promote_default(rules: DataFrame, deleted: DataFrame, group: Keys, id_column: str = "id", flag: str = "is_default") -> DataFrame:
    """After deletions each group has one default: the one it has, else its oldest rule."""
    left = rules.join(deleted.select(id_column), id_column, "left_anti")
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(flag).desc(), F.col(id_column)))
    return left.withColumn(flag, first == 1)


def shift_words(words: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves the first `n` words of verse v + 1 to the end of verse v and renumbers.

    words: (id, verse, word_position, strongs); moves: (verse, n, expected) where expected is
    the list of dictionary ids of the words to move. A move whose words are not the expected ones
    does nothing, so a second run changes nothing."""
    target = moves.select((F.col("verse") + 1).alias("verse"), "n", "expected")
    heads = words.join(target, "verse").where(F.col("word_position") <= F.col("n"))
    seen = heads.groupBy("verse").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_position", "strongs"))), lambda x: x.strongs).alias("seen"))
    good = target.join(seen, "verse").where(F.col("seen") == F.col("expected")).select("verse", F.col("n").alias("_n"))
    size = words.groupBy((F.col("verse") + 1).alias("verse")).agg(F.max("word_position").alias("_size"))
    out = words.join(F.broadcast(good.join(size, "verse", "left")), "verse", "left")
    moved = F.col("_n").isNotNull() & (F.col("word_position") <= F.col("_n"))
    position = F.when(moved, F.coalesce("_size", F.lit(0)) + F.col("word_position")).when(F.col("_n").isNotNull(), F.col("word_position") - F.col("_n")).otherwise(F.col("word_position"))
    return out.withColumns({"word_position": position, "verse": F.when(moved, F.col("verse") - 1).otherwise(F.col("verse"))}).select(*words.columns)


def import_guarded(old: DataFrame, delta: DataFrame, keys: Keys, method: str = "method") -> tuple[DataFrame, DataFrame]:
    """Imports rows unless a manual row has their key: (new state, counts of inserted, replaced, skipped)."""
    manual = old.where(F.col(method) == "manual").select(*keys).distinct()
    tagged = delta.join(manual.withColumn("_m", F.lit(True)), list(keys), "left").join(old.select(*keys).distinct().withColumn("_o", F.lit(True)), list(keys), "left")
    outcome = F.when(F.col("_m"), "skipped").when(F.col("_o"), "replaced").otherwise("inserted")
    tagged = tagged.withColumn("outcome", outcome)
    state = upsert(old, tagged.where("outcome <> 'skipped'").select(*old.columns), keys)
    return state, tagged.groupBy("outcome").count()


def export_csv(df: DataFrame, path: str) -> None:
    """Header-named CSV; null is the empty string."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


_KEY = ["k"]


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return run_sql(spark, sf_dir, "select * from old_state"), run_sql(spark, sf_dir, "select * from delta")


def _register(name: str, sql, run) -> None:
    query(name, with_views(sql(DUCKDB) if callable(sql) else sql, DUCKDB))(run)


_COALESCED = "select coalesce(o.k, d.k) as k, {owner} as owner, {status} as status, {score} as score, {note} as note from old_state o full join delta d on d.k = o.k"
_PICK = "case when d.k is null then o.{c} else d.{c} end"


def _sql(**given: str) -> str:
    return _COALESCED.format(**{c: given.get(c, _PICK.format(c=c)) for c in ("owner", "status", "score", "note")})


_register("m1_insert_if_absent", "select * from old_state union all select d.* from delta d where d.k not in (select k from old_state)", lambda s, p: insert_absent(*_state(s, p), _KEY))
_register("m2_upsert", _sql(), lambda s, p: upsert(*_state(s, p), _KEY))
_register("m3_first_creator_stays", _sql(owner="coalesce(o.owner, d.owner)"), lambda s, p: keep_first_creator(*_state(s, p), _KEY, "owner"))
_register(
    "m4_status_reset",
    _sql(status="case when o.k is null then d.status when d.k is null then o.status when o.note is not distinct from d.note then o.status else 'ingested' end"),
    lambda s, p: upsert_with_reset(*_state(s, p), _KEY, "note", "status", "ingested"),
)
_IF = "case when o.k is null then d.{c} when d.k is not null and (o.score < 50000 or o.owner = d.owner) then d.{c} else o.{c} end"
_register(
    "m5_conditional_upsert",
    _sql(**{c: _IF.format(c=c) for c in ("owner", "status", "score", "note")}),
    lambda s, p: upsert_if(*_state(s, p), _KEY, (F.col("o.score") < 50000) | (F.col("o.owner") == F.col("d.owner"))),
)
_register(
    "m6_partial_unique_upsert",
    "select * from old_state where note not in (select note from delta where note is not null) union all select * from delta",
    lambda s, p: upsert_partial(*_state(s, p), "note"),
)
_register(
    "m7_new_ids",
    "select count(*) as n, min(id) > (select max(k) from old_state) as above, count(distinct id) = count(*) and max(id) - min(id) + 1 = count(*) as gapless from (select (select max(k) from old_state) + row_number() over (order by k) as id from delta) t",
    lambda s, p: _new_ids(s, p),
)
_register(
    "m8_replace_children",
    "select * from old_state where owner not in (select owner from delta) union all select * from delta",
    lambda s, p: (lambda o, d: replace_children(o, d, d, ["owner"]))(*_state(s, p)),
)
_register("m9_delete_exists", "select * from old_state o where not exists (select 1 from delta d where d.owner = o.owner)", lambda s, p: delete_where_exists(*_state(s, p), ["owner"]))
_register(
    "m10_delete_unconfirmed",
    "select k.id, k.source_id, k.tw_id, k.notes from word_links k where exists (select 1 from link_confidence c where c.link_id = k.id and c.method = 'manual') or not exists (select 1 from translation_words w where w.id = k.tw_id and w.translation_id = 1)",
    lambda s, p: delete_where_exists(
        run_sql(s, p, "select * from word_links"),
        run_sql(s, p, "select k.id from word_links k join translation_words w on w.id = k.tw_id and w.translation_id = 1"),
        ["id"],
        run_sql(s, p, "select link_id as id from link_confidence where method = 'manual'"),
    ),
)
_register(
    "m11_dedupe_keep_min",
    "select k, owner, status, score, note from (select *, row_number() over (partition by owner, status order by k) as n from old_state) t where n = 1",
    lambda s, p: dedupe_keep_min(_state(s, p)[0], ["owner", "status"], "k"),
)
_register(
    "m12_update_from_join",
    "select o.k, o.owner, o.status, case when d.k is null then o.score else d.score end as score, case when d.k is null then o.note else d.note end as note from old_state o left join delta d on d.k = o.k",
    lambda s, p: update_from(*_state(s, p), _KEY, ["score", "note"]),
)
_register(
    "m13_update_by_ids",
    "select k, owner, status, score, case when k % 7 = 0 and note is null then 'particle' when k % 7 = 0 then note else note end as note from delta",
    lambda s, p: set_where(_state(s, p)[1], "note", F.lit("particle"), (F.col("k") % 7 == 0) & F.col("note").isNull()),
)
_register(
    "m14_approve",
    "select i.id, i.word_a_id, i.word_b_id, case when h.hit then 'manual' else i.method end as method, case when h.hit then null else i.confidence end as confidence, case when h.hit then cast(1 as double) end as score from itl i left join (select distinct i.id, true as hit from itl i join (select id from translation_words where book_id = 4) w on w.id = i.word_a_id or w.id = i.word_b_id) h on h.id = i.id",
    lambda s, p: approve(run_sql(s, p, "select * from itl"), run_sql(s, p, "select id from translation_words where book_id = 4")),
)
_register(
    "m15_canonical_edge",
    "select least(word_a_id, word_b_id) as word_a_id, greatest(word_a_id, word_b_id) as word_b_id, method from (select word_b_id as word_a_id, word_a_id as word_b_id, method from itl) t",
    lambda s, p: canonical_edge(run_sql(s, p, "select word_b_id as word_a_id, word_a_id as word_b_id, method from itl")),
)
_register("m16_reset_automatic", "select * from itl where method in ('manual', 'manual_empty')", lambda s, p: run_sql(s, p, "select * from itl").where(F.col("method").isin("manual", "manual_empty")))
_register("m18_toggle", "select id, kind, source, target, case when id % 10 = 0 then not active else active end as active, note_no from rules", lambda s, p: set_where(run_sql(s, p, "select * from rules"), "active", ~F.col("active"), F.col("id") % 10 == 0))
_register(
    "m19_promote_default",
    "select id, kind, row_number() over (partition by kind order by d desc, id) = 1 as is_default from (select id, kind, note_no = 7 as d from rules where id % 4 <> 0) t",
    lambda s, p: promote_default(run_sql(s, p, "select id, kind, note_no = 7 as is_default from rules"), run_sql(s, p, "select id from rules where id % 4 = 0"), ["kind"]),
)
_register(
    "m20_audited_correction",
    "select o.k, o.note as old_text, d.note as new_text from old_state o join delta d on d.k = o.k where o.note is distinct from d.note",
    lambda s, p: (lambda o, d: o.join(d.select("k", F.col("note").alias("new_text")), "k").where(~F.col("note").eqNullSafe(F.col("new_text"))).select("k", F.col("note").alias("old_text"), "new_text"))(*_state(s, p)),
)
_register(
    "m21_latest_event",
    "select user_id, event_type as state, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) t where n = 1",
    lambda s, p: s.read.parquet(f"{p}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
)
_register(
    "m22_resolved_once",
    "select k, status, case when status = 'F' then coalesce(note, 'now') end as resolved from delta union all select k, status, case when status = 'F' then coalesce(note, 'now') end from old_state",
    lambda s, p: (lambda o, d: d.unionByName(o).select("k", "status", F.when(F.col("status") == "F", F.coalesce("note", F.lit("now"))).alias("resolved")))(*_state(s, p)),
)
_register(
    "m25_guarded_import",
    "select outcome, count(*) as count from (select case when m.k is not null then 'skipped' when o.k is not null then 'replaced' else 'inserted' end as outcome from delta d left join (select k from old_state where status = 'O') m on m.k = d.k left join old_state o on o.k = d.k) t group by outcome",
    lambda s, p: (lambda o, d: import_guarded(o.withColumn("status", F.when(F.col("status") == "O", "manual").otherwise(F.col("status"))), d, _KEY, "status")[1])(*_state(s, p)),
)
_register(
    "m26_portable_keys",
    "select count(*) as rows, count(w.id) as resolved, count(*) - count(w.id) as unresolved from (select concat('T', cast(1 + l_suppkey % 4 as varchar(2))) as code, l_orderkey as verse, cast(l_linenumber as bigint) as position from lineitem) x left join translations t on t.code = x.code left join translation_words w on w.translation_id = t.id and w.verse = x.verse and w.word_position = x.position",
    lambda s, p: run_sql(s, p, "select count(*) as rows, count(w.id) as resolved, count(*) - count(w.id) as unresolved from (select concat('T', cast(1 + l_suppkey % 4 as varchar(2))) as code, l_orderkey as verse, cast(l_linenumber as bigint) as position from lineitem) x left join translations t on t.code = x.code left join translation_words w on w.translation_id = t.id and w.verse = x.verse and w.word_position = x.position"),
)
_register(
    "m27_replace_import",
    "select id, kind, target from (select id, kind, target from rules where id % 3 <> 0 union all select id + 1000000, kind, target from rules where id % 50 = 0) t",
    lambda s, p: replace_rows(run_sql(s, p, "select id, kind, target from rules"), F.col("id") % 3 == 0, run_sql(s, p, "select id + 1000000 as id, kind, target from rules where id % 50 = 0")),
)
_register(
    "m30_shift_verse_boundary",
    "select id, case when verse % 40 = 1 and word_position <= 2 and w2 then verse - 1 else verse end as verse, case when verse % 40 = 1 and w2 then case when word_position <= 2 then coalesce(size, 0) + word_position else word_position - 2 end else word_position end as word_position, strongs from (select s.id, s.verse, s.word_position, s.strongs, z.size, x.verse is not null as w2 from source_words s left join (select verse + 1 as verse, max(word_position) as size from source_words group by verse) z on z.verse = s.verse left join (select verse from source_words where verse % 40 = 1 and word_position <= 2 group by verse) x on x.verse = s.verse) t",
    lambda s, p: _shifted(s, p),
)
_register(
    "m31_normalised_ids",
    lambda d: f"select id, concat(substr(strongs, 1, 1), {d.replace_all('substr(strongs, 2)', '^0+', '')}) as strongs from source_words",
    lambda s, p: run_sql(s, p, "select id, strongs from source_words").select("id", F.concat(F.left("strongs", F.lit(1)), F.ltrim(F.expr("substr(strongs, 2)"), F.lit("0"))).alias("strongs")),
)
_register("m32_reclassified", "select id, case when notes like 'manual_hint:%' then 'manual_hint' else 'computed' end as method from word_links", lambda s, p: run_sql(s, p, "select id, notes from word_links").select("id", F.when(F.col("notes").like("manual_hint:%"), "manual_hint").otherwise("computed").alias("method")))


def _new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, delta = _state(spark, sf_dir)
    ids = with_new_ids(old, delta.withColumnRenamed("k", "natural"), ["natural"], "k")
    top = old.agg(F.max("k").alias("top"))
    return ids.agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_distinct("k").alias("u")).join(top).select(
        "n", (F.col("lo") > F.col("top")).alias("above"), ((F.col("u") == F.col("n")) & (F.col("hi") - F.col("lo") + 1 == F.col("n"))).alias("gapless")
    )


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = run_sql(spark, sf_dir, "select id, verse, word_position, strongs from source_words")
    heads = words.where((F.col("verse") % 40 == 1) & (F.col("word_position") <= 2)).groupBy((F.col("verse") - 1).alias("verse"))
    moves = heads.agg(F.lit(2).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("word_position", "strongs"))), lambda x: x.strongs).alias("expected"))
    return shift_words(words, moves)
