"""Text operators as queries over documents and conversations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, morphology, references
from ..functions.spelling import Rule, Speller, udf_spelling
from ..plans.catalog import query
from ..plans.domain import run_sql

RULES = (Rule("the", "de"), Rule("and", "en"), Rule("of the", "van de"), Rule("*tion", "*tie"), Rule("th*", "t*"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query("f4_f13_unaccented", "select doc_id, lower(strip_accents(text)) as plain from documents")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.lower(forms.udf_unaccented()("text")).alias("plain"))


@query("f5_raw_forms")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "select distinct word from token").select("word", forms.udf_raw_form()("word").alias("form"))


@query("f6_normal_forms")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "select distinct word from token").select("word", forms.udf_normal_form()("word").alias("form"))


@query("f7_tokens")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(forms.udf_tokens()("text")).alias("position", "token"))


@query("f10_sentences")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _documents(spark, sf_dir).select("doc_id", F.posexplode(forms.udf_sentences()("text")).alias("n", "s"))
    return each.select("doc_id", "n", "s.start", "s.end")


@query("f12_offset_map")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How offsets move from a turn's text to its Latin form."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: forms.char_map(x, forms.latin_form(x)), na_action="ignore")

    return run_sql(spark, sf_dir, "select id, text from segment").select("id", F.array_join(run("text"), ",").alias("offsets"))


@query("f18_matching_ratio")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([forms.ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])

    pairs = run_sql(spark, sf_dir, "select distinct a.word_text as a, b.word_text as b from itl i join translation_words a on a.id = i.word_a_id join translation_words b on b.id = i.word_b_id")
    return pairs.select("a", "b", run("a", "b").alias("ratio"))


@query("f23_punctuated_words")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a turn with the punctuation that follows it."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: forms.with_punctuation(x, [w.strip(".,;:!?") for w in x.split()]), na_action="ignore")

    return run_sql(spark, sf_dir, "select id, text from segment").select("id", F.array_join(run("text"), " ").alias("words"))


@query("f25_text_parts")
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn as parts: words that begin with t, and the text between them."""
    import re

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        cut = lambda x: [{"kind": k, "text": t} for k, t in forms.parts(x, [m.span() for m in re.finditer(r"\bt\w+", x)])]
        return s.map(cut, na_action="ignore")

    return run_sql(spark, sf_dir, "select id, text from segment").select("id", F.posexplode(run("text")).alias("n", "p")).select("id", "n", "p.kind", "p.text")


@query("f27_anchor_places")
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the second `the` of a document ends."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: forms.after_occurrence(x, "the", 2), na_action="ignore").astype("Int32")

    return _documents(spark, sf_dir).select("doc_id", run("text").alias("after"))


@query("f37_modern_spelling")
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "select id, text from segment").select("id", udf_spelling(RULES)("text").alias("text"))


@query("f39_rule_hits")
def f39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct words each rule changes, and how often they stand in the corpus."""
    words = run_sql(spark, sf_dir, "select word, count(*) as n from token group by word")
    spellers = [(r.source, Speller([r])) for r in RULES]

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: [name for name, sp in spellers if sp.apply(w) != w], na_action="ignore")

    return words.select("word", "n", F.explode(run("word")).alias("rule")).groupBy("rule").agg(F.count("*").alias("words"), F.sum("n").alias("hits"))


@query("f42_word_diff")
def f42(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = run_sql(spark, sf_dir, "select a.id, a.text as a, b.text as b from segment a join segment b on b.work_id = a.work_id and b.seq = a.seq + 1")
    return pairs.select("id", F.posexplode(forms.udf_word_diff()("a", "b")).alias("n", "d")).select("id", "n", "d.op", "d.text")


def merged_readings(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, merged) of (id, text, other): of what differs, the reading with the larger share of words in vocabulary (word) stays."""

    @F.pandas_udf("array<string>")
    def differing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for op, t in forms.word_diff(x or "", y or "") if op != "equal" for w in t.split()}) for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, words: pd.Series) -> pd.Series:
        def one(x: str, y: str, known: set[str]) -> str:
            runs, out, k = forms.word_diff(x, y), [], 0
            while k < len(runs):
                if runs[k][0] == "delete" and k + 1 < len(runs) and runs[k + 1][0] == "insert":
                    score = lambda t: sum(w in known for w in t.split()) / max(len(t.split()), 1)
                    out.append(max(runs[k][1], runs[k + 1][1], key=score))
                    k += 2
                else:
                    out.append(runs[k][1])
                    k += 1
            return " ".join(out)

        return pd.Series([one(x or "", y or "", set() if w is None else set(w)) for x, y, w in zip(a, b, words, strict=True)])

    found = pairs.select("id", F.explode(differing("text", "other")).alias("word")).join(vocabulary.select("word").distinct(), "word")
    known = found.groupBy(F.col("id").alias("_id")).agg(F.collect_set("word").alias("known"))
    both = pairs.join(known, F.col("id").eqNullSafe(F.col("_id")), "left")
    return both.select("id", run("text", "other", "known").alias("merged"))


@query("t2_merged_readings")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a text word by word: of what differs, the reading with more known words stays."""
    pairs = run_sql(spark, sf_dir, "select id, text, replace(text, 'th', 'tb') as other from segment")
    return merged_readings(pairs, run_sql(spark, sf_dir, "select distinct word from token where is_word"))


@query("t3_one_letter_corrections")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rare word the most frequent word that differs in one letter: both are keyed by their
    forms with one letter blanked, so candidates meet by an equi-join."""
    words = run_sql(spark, sf_dir, "select lemma as word, count(*) as n from token where is_word group by lemma").where("length(word) >= 4")
    masks = F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substr("word", F.lit(1), k - 1), F.lit("_"), F.substr("word", k + 1)))
    keyed = words.select("word", "n", F.explode(masks).alias("mask"))
    rare, common = keyed.where("n <= 2"), keyed.where("n > 20").select(F.col("word").alias("better"), F.col("n").alias("m"), "mask")
    best = F.max(F.struct("m", "better")).alias("best")
    return rare.join(common, "mask").groupBy("word").agg(best).select("word", F.col("best.better").alias("better"), F.col("best.m").alias("n"))


@query(
    "t6_clean_characters",
    "select doc_id, regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '[|*#$%&]+', '', 'g'), ' +', ' ', 'g') as clean from documents",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.replace("text", F.lit("-\n"), F.lit(""))
    return _documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.regexp_replace(joined, r"[|*#$%&]+", ""), " +", " ").alias("clean"))


@query("t7_paragraphs", "select doc_id, count(*) as paragraphs, max(length(p)) as longest from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) t group by doc_id")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return each.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("p")).cast("long").alias("longest"))


@query("f28_dutch_references")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a made-up apparatus: book, chapter and verses from the verse table, in running text."""
    return _references(spark, sf_dir, dutch=True)


@query("f29_latin_references")
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir, dutch=False)


def _references(spark: SparkSession, sf_dir: str, dutch: bool) -> DataFrame:
    find = references.dutch if dutch else references.latin

    @F.pandas_udf("array<struct<start:int,end:int,code:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": x.start, "end": x.end, "code": references.encode(list(x.refs))} for x in find(t)], na_action="ignore")

    body = "concat('Zie (Rom. ', chapter, ':', verse % 30 + 1, ', ', verse % 30 + 2, '; 2:3). Voorts 1 Kor. 2:4-6.')" if dutch else "concat('Rom. iii. ', verse % 30 + 1, ' dicit. Ver. 23 omnes; et 1 Cor. 2, 4, 5.')"
    notes = run_sql(spark, sf_dir, "select book_id, chapter, verse from verses").selectExpr("verse", f"{body} as note")
    return notes.select("verse", F.posexplode(run("note")).alias("n", "r")).select("verse", "n", "r.start", "r.end", "r.code")


@query("f34_greek_morphology")
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(c,) for c in ("V-2AAI-3S", "V-PAP-NSM", "N-GSF", "P-1GS", "A-NSM-C", "CONJ", "")], "code string")
    return codes.select("code", forms._series(morphology.greek, "string")("code").alias("label"))


@query("f35_hebrew_morphology")
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = run_sql(spark, sf_dir, "select distinct morph_code from source_words")
    return codes.select("morph_code", forms._series(morphology.hebrew, "string")("morph_code").alias("label"))


@query("f36_latin_morphology")
def f36(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Case=Gen|Number="), F.when(F.col("doc_id") % 2 == 0, "Sing").otherwise("Plur")).alias("features"))
    return codes.select("doc_id", forms._series(morphology.latin, "string")("features").alias("label"))
