"""Semantic traps, one test each, by the survey's number."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import forms, matching
from wordloom.operators import state, text
from wordloom.plans import catalog, inventory, load
from wordloom.sources import readers


def ids(df, column="k"):
    return [r[column] for r in df.collect()]


def test_h1_h2_null_order_and_ties(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 2, 0.5), (1, 1, 0.5), (2, 9, None)], "k long, id long, score double")
    top = state.first_by(df, ["k"], [F.col("score").desc_nulls_last(), F.col("id")])
    assert sorted((r["k"], r["id"]) for r in top.collect()) == [(1, 1), (2, 9)]


def test_h3_lengths_are_bytes():
    assert matching.word_score("één", "éénd") == 1 and matching.word_score("eén", "eënd") == -1
    assert forms.edit_distance("é".encode(), b"e") == 2


def test_h5_ties_of_the_dominant_form():
    source = [{"id": 1, "strongs": "H1"}]
    assert matching.heuristic_links(source, [(7, "b"), (8, "a")], {"H1": {"b": 2, "a": 2}})[0][:2] == (1, 8)


def test_h7_one_spelling_of_ids(spark):
    df = spark.createDataFrame([("H9001/{H0430G}",), ("{H9014}",), ("",)], "c4 string")
    assert ids(df.select(readers.root_strongs("c4").alias("k"))) == ["H0430G", None, None]


def test_h8_runs_by_gaps():
    assert load.shipped(catalog.QUERIES["w7_gap_runs"]) and "rows between" in catalog.QUERIES["w7_gap_runs"].__doc__


def test_h9_not_in_with_nulls(spark):
    old = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    gone = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(ids(state.delete_where_exists(old, gone, ["k"])), key=str) == [2, None]


def test_h10_filters_in_on(spark):
    rows = load.shipped(catalog.QUERIES["j2_filter_in_on"])(spark, "/root/testdata/sf0.001")
    assert rows.where("linked_in_2 = 0").count() > 0


def test_h11_round_half_even():
    got = matching.heuristic_links([{"id": k, "strongs": None} for k in range(3)], [(10, "a"), (11, "b")], {})
    assert [x[1] for x in got] == [10, 10, 11]


def test_h12_null_columns_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "k long, score double")
    readers.write_csv(df, str(tmp_path / "x"))
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "x"), "k long, score double").collect()), key=str) == [(1, None), (2, 0.5)]


def test_h14_approval_takes_empty_links(spark):
    links = spark.createDataFrame([(1, 5, 6, "manual_empty", 3)], "id long, word_a_id long, word_b_id long, method string, confidence long")
    assert state.approve(links, spark.createDataFrame([(6,)], "id long")).first()["method"] == "manual"


def test_h15_coverage_counts_joined_rows(spark):
    rows = load.shipped(catalog.QUERIES["c22_alignment_coverage"])(spark, "/root/testdata/sf0.001").collect()
    assert all(r["joined"] >= r["words"] and r["aligned"] >= r["words_aligned"] for r in rows) and any(r["joined"] > r["words"] for r in rows)


def test_h16_used_places_of_both_sides_block_windows():
    v = matching.VersePair(["aa", "bb"], ["cc", "aa"])
    v.links = [matching.Link(0, [1], 1.0, "anchor")]
    assert matching.windows(v, [(0, 1)]) == []


def test_h19_binary_order(spark):
    assert ids(spark.createDataFrame([("a",), ("B",), ("é",)], "k string").orderBy("k")) == ["B", "a", "é"]


@pytest.mark.parametrize("group", inventory.GROUPS)
def test_every_operator_has_a_status(group):
    found = {k: v for k, v in inventory.status().items() if k.rstrip("0123456789") == group}
    assert len(found) == inventory.GROUPS[group] and "open" not in found.values()


def test_merged_readings_know_every_word(spark):
    known = spark.createDataFrame([(f"w{k}",) for k in range(2000)], "word string")
    pairs = spark.createDataFrame([(1, "w1 w19x9 w3", "w1 w1999 w3"), (2, "w1 w1998", "w1 q"), (3, "w1", "w1"), (4, None, "")], "id long, text string, other string")
    assert dict(map(tuple, text.merged_readings(pairs, known).collect())) == {1: "w1 w1999 w3", 2: "w1 w1998", 3: "w1", 4: ""}
