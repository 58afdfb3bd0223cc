import pytest
from pyspark.sql import functions as F

from wordloom.operators import graph, state
from wordloom.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


LINK = "id long, source_id long, tw_id long, notes string"


def test_upsert_is_idempotent(spark):
    old = frame(spark, [(1, "a"), (2, None)], "k long, v string")
    delta = frame(spark, [(2, "b"), (3, "c")], "k long, v string")
    once = state.upsert(old, delta, ["k"])
    assert ordered(once) == [(1, "a"), (2, "b"), (3, "c")]
    assert ordered(state.upsert(once, delta, ["k"])) == ordered(once)
    assert ordered(state.insert_absent(old, delta, ["k"])) == [(1, "a"), (2, None), (3, "c")]


def test_save_links(spark):
    links = frame(spark, [(1, 7, 70, None), (2, 7, 90, None), (3, 8, 70, None)], LINK)
    words = frame(spark, [(70, 1), (71, 1), (90, 2)], "id long, translation_id long")
    empty = frame(spark, [(7, 1)], "source_id long, translation_id long")
    kept, marks = state.save_links(links, empty, 7, 1, [71], words)
    assert ordered(kept.select("source_id", "tw_id")) == [(7, 71), (7, 90), (8, 70)]
    assert marks.count() == 0
    kept, marks = state.save_links(links, empty.limit(0), 7, 1, [], words)
    assert ordered(kept.select("source_id", "tw_id")) == [(7, 90), (8, 70)] and ordered(marks) == [(7, 1)]
    with pytest.raises(ValueError):
        state.save_links(links, empty, 0, 1, [], words)


def test_approve_takes_empty_links(spark):
    links = frame(spark, [(1, 10, 20, "manual_empty", 5), (2, 30, 40, "window", 5)], "id long, word_a_id long, word_b_id long, method string, confidence long")
    got = state.approve(links, frame(spark, [(20,)], "id long"))
    assert ordered(got) == [(1, 10, 20, "manual", None, 1.0), (2, 30, 40, "window", 5, None)]


def test_dedupe_keeps_rows_without_a_key(spark):
    got = state.dedupe_keep_min(frame(spark, [(3, 1, 1), (2, 1, 1), (5, None, 1), (6, None, 1)], "id long, a long, b long"), ["a", "b"])
    assert sorted(r["id"] for r in got.collect()) == [2, 5, 6]


def test_shift_words_runs_once(spark):
    words = frame(spark, [(1, 1, 1, "A"), (2, 2, 1, "B"), (3, 2, 2, "C"), (4, 2, 3, "D")], "id long, verse long, word_position long, strongs string")
    moves = frame(spark, [(1, 2, ["B", "C"])], "verse long, n long, expected array<string>")
    once = state.shift_words(words, moves)
    assert ordered(once) == [(1, 1, 1, "A"), (2, 1, 2, "B"), (3, 1, 3, "C"), (4, 2, 1, "D")]
    assert ordered(state.shift_words(once, moves)) == ordered(once)


def test_csv_round_trip(spark, tmp_path):
    df = frame(spark, [(1, "a,b", None), (2, "c", "x")], "id long, text string, note string")
    readers.write_csv(df, str(tmp_path / "x"))
    assert ordered(readers.csv(spark, str(tmp_path / "x"), "id long, text string, note string")) == ordered(df)


def test_components(spark):
    got = graph.connected_components(frame(spark, [(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(k, 1) for k in range(1, 41)} | {(100, 100), (101, 100)}


def test_hebrew_words(spark, tmp_path):
    lines = [
        "# comment", "", "Eng (Heb) Ref & Type\tHebrew", "Gen.1.1#01=L\tבְּ/רֵאשִׁ֖ית\tbe.re.shit\tin beginning\tH9003/{H7225G}\tHR/Ncfsa",
        "Gen.1.1#02=K\tx\ty\tz\t{H1}\tm", "Gen.1.1#02=Q(K)\tבָּרָ֣א\\H9016\t\tcreated\t{H9001}\t", "Foo.1.1#01=L\ta\tb\tc\t{H1}\td",
    ]
    (tmp_path / "w.txt").write_text("\n".join(lines), encoding="utf-8")
    got = readers.hebrew_words(spark, str(tmp_path / "w.txt"), {"Gen": 1}).orderBy("word_position").collect()
    assert [(r["word_position"], r["strongs"], r["has_qere"], r["transliteration"], r["morph_code"]) for r in got] == [(1, "H7225G", False, "be.re.shit", "HR/Ncfsa"), (2, None, True, None, None)]
    assert "/" not in got[0]["word_text"] and got[1]["word_text"] == "בָּרָ֣א"


def test_greek_words(spark, tmp_path):
    (tmp_path / "MT.UEL").write_text("1:1 biblov 976 {N-NSF} genesewv 1078\n {N-GSF}\n1:2 abraam 11 5 {N-PRI}\n")
    (tmp_path / "ZZ.UEL").write_text("1:1 a 1 {X}\n")
    got = readers.greek_words(spark, str(tmp_path), {"MT": 40})
    assert ordered(got) == [(40, 1, 1, 1, "biblov", "G0976", "N-NSF"), (40, 1, 1, 2, "genesewv", "G1078", "N-GSF"), (40, 1, 2, 1, "abraam", "G0011", "N-PRI")]


def test_xml_and_html(spark, tmp_path):
    (tmp_path / "b.xml").write_text('<XMLBIBLE><BIBLEBOOK bnumber="1"><CHAPTER cnumber="1"><VERS vnumber="1">In den <STYLE>beginne</STYLE>  schiep</VERS><VERS vnumber="2"> </VERS></CHAPTER></BIBLEBOOK><BIBLEBOOK bnumber="67"/></XMLBIBLE>')
    assert ordered(readers.xml_verses(spark, str(tmp_path / "b.xml"))) == [(1, 1, 1, "In den beginne schiep")]
    html = '<p><span data-verse-id="GEN.1.1" class="v">In den <a>x</a><span class="add">grote</span> beginne</span><span data-verse-id="GEN.1.1" class="x"><a href="JOH.1.1">b</a></span></p>'
    pages = frame(spark, [(html,), (None,)], "html string")
    assert ordered(readers.html_verses(pages)) == [("GEN.1.1", 0, "In den", False), ("GEN.1.1", 1, "grote", True), ("GEN.1.1", 2, "beginne", False)]
    two = frame(spark, [('<span data-verse-id="GEN.1.1" class="verse-span">In den beginne</span><span data-verse-id="GEN.1.1" class="x"><a href="/JOH.1.1">b</a><a href="/HEB.11.3">c</a></span>',)], "html string")
    assert ordered(readers.html_references(two, {"JOH": 43, "HEB": 58})) == [("GEN.1.1", "a", 3, 1, 43, 1, 1), ("GEN.1.1", "a", 3, 2, 58, 11, 3)]
    (tmp_path / "d.xml").write_text('<d><entry n="H0001"><w>ab</w>father; from <w src="2" lemma="l" xlit="x"/> too</entry></d>')
    assert ordered(readers.dictionary(spark, str(tmp_path / "d.xml"), "H")) == [("H1", "ab", "father; from H2 (l, x) too")]


def test_verse_words(spark):
    got = readers.verse_words(frame(spark, [(1, " Één, (twee) -- drie.")], "id long, text string")).orderBy("word_position")
    assert [tuple(r) for r in got.select("word_position", "word_text", "char_start", "char_end", "word_normalised").collect()] == [(1, "Één", 1, 5, "een"), (2, "twee", 6, 12, "twee"), (3, "drie", 16, 21, "drie")]


def test_null_order_and_ties(spark):
    df = frame(spark, [(1, None), (1, 0.5), (2, None)], "k long, score double")
    got = state.first_by(df, ["k"], [F.col("score").desc_nulls_last()])
    assert ordered(got) == [(1, 0.5), (2, None)]


def test_replace_import_keeps_every_row(spark, tmp_path):
    """Imported ids may be those of rules that stay, and several imported rows may share one."""
    from wordloom.plans import catalog

    parts = [(100, "b", "t", "x", 1), (1000100, "b", "t", "y", 1), (50, "b", "t", "z", 1), (50, "b", "t", "z", 1), (9, "b", "t", "w", 1)]
    frame(spark, parts, "p_partkey long, p_brand string, p_type string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = [(100, "b", "x"), (1000100, "b", "y"), (50, "b", "z"), (50, "b", "z"), (1000100, "b", "x"), (1000050, "b", "z"), (1000050, "b", "z"), (2000100, "b", "y")]
    assert ordered(catalog.QUERIES["m27_replace_import"](spark, str(tmp_path))) == sorted(want, key=str)


def test_hints_are_one_row_for_each_agreed_id(spark):
    """What travels to the verses does not grow with the forms that an id has."""
    from wordloom.functions import matching
    from wordloom.operators import alignment

    rows = [("H1", "b", 2), ("H1", "a", 2), ("H2", "c", 2), ("H2", None, 9), ("H4", "e", 2), ("H4", "e", 2), ("H4", "f", 1), *(("H3", f"x{k}", 1) for k in range(500))]
    known = alignment.agreed(frame(spark, rows, "strongs string, form string, n int"))
    assert ordered(known) == [("H1", "a", 0.5), ("H4", "e", 0.8)]
    words = [(1, 10 * k, k, strongs, None) for k, strongs in enumerate(("H1", "H2", None, "H4", "H3"), 1)]
    target = [(1, 7 + k, k, form) for k, form in enumerate("cae", 1)]
    got = alignment.heuristic(frame(spark, words, "verse long, id long, word_position long, strongs string, name string"), frame(spark, target, "verse long, id long, word_position long, form string"), known)
    counts = {"H1": {"b": 2, "a": 2}, "H2": {"c": 2}, "H4": {"e": 4, "f": 1}, "H3": {f"x{k}": 1 for k in range(500)}}
    want = matching.heuristic_links([{"id": w[1], "strongs": w[3], "name": None} for w in words], [(t[1], t[3]) for t in target], counts)
    assert ordered(got) == sorted(((1, *x) for x in want), key=str)


def test_hints_of_slices_add_up(spark, monkeypatch):
    from wordloom.operators import alignment

    sf = "/root/testdata/sf0.001"
    whole = ordered(alignment._hints(spark, sf))
    monkeypatch.setattr(alignment, "SLICE", 2500)
    assert whole and ordered(alignment._hints(spark, sf)) == whole
