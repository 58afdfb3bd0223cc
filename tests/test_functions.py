import itertools
import random

import numpy as np
import pytest

from wordloom.functions import forms, matching
from wordloom.functions.spelling import Rule, Speller, problem

FORMS = {
    "Maer": "maar", "ick": "ik", "bidde": "bid", "den": "de", "name": "naam", "onses": "onze", "Heeren": "heren", "Iesu": "jezus",
    "Christi": "christus", "ghy": "gij", "selve": "zelfde", "spreeckt": "spreekt", "ende": "en", "geene": "geen", "gevoeght": "gevoegd",
    "eenen": "een", "selven": "zelfden", "sin": "zin", "Heere": "here", "één": "een",
}


@pytest.mark.parametrize(("old", "new"), FORMS.items())
def test_normal_form(old, new):
    assert forms.normal_form(old) == new


def test_raw_form_and_tokens():
    assert forms.raw_form("Oógen!") == "oogen"
    assert forms.tokens("be-ginne, het 'woord'.") == ["beginne", ",", "het", "'", "woord", "'", "."]


def speller(*pairs):
    return Speller([Rule(a, b) for a, b in pairs])


@pytest.mark.parametrize(
    ("pairs", "text", "want"),
    [
        ([("beteekent", "betekent")], "Dit beteekent: onbeteekent blijft.", "Dit betekent: onbeteekent blijft."),
        ([("beteekent", "betekent"), ("gelijk", "zoals")], "Beteekent gelijk. Gelijk GELIJK", "Betekent zoals. Zoals ZOALS"),
        ([("gelijk", "net als"), ("gelijk als", "zoals")], "gelijk als wij", "zoals wij"),
        ([("gelijk", "net als"), ("gelijk als", "zoals")], "gelijk, als wij", "net als, als wij"),
        ([("*sch", "*s")], "de mensch en het vleesch", "de mens en het vlees"),
        ([("*sch", "*s")], "sch", "sch"),
        ([("sch*", "s*"), ("*ee*", "*e*")], "schip beteekent", "sip betekent"),
        ([("sch*", "s*"), ("*ee*", "*e*")], "eet zee", "eet zee"),
    ],
)
def test_spelling(pairs, text, want):
    assert speller(*pairs).apply(text) == want


def test_rule_problems():
    assert problem(Rule("a", "a")) and problem(Rule("", "x")) and problem(Rule("a*b", "c*d")) and problem(Rule("*a", "b"))
    assert problem(Rule("*sch", "*s")) is None


def test_word_diff():
    assert forms.word_diff("", "nieuwe tekst hier") == [("insert", "nieuwe tekst hier")]
    got = forms.word_diff("zijn met elkaar verbonden.", "zijn nauw met elkaar verbonden.")
    assert got == [("equal", "zijn"), ("insert", "nauw"), ("equal", "met elkaar verbonden.")]
    assert forms.word_diff("a b", "c") == [("delete", "a b"), ("insert", "c")]
    assert forms.differing_ranges("a b c", "a x c d") == [(2, 3), (6, 7)]


def test_offsets():
    assert forms.place_words("De, de man.", ["De", "de", "x", "man"]) == [(0, 2), (4, 6), None, (7, 10)]
    assert forms.with_punctuation("De, de man.", ["De", "de", "man"]) == ["De,", "de", "man."]
    assert forms.parts("een twee", [(0, 3), (2, 5), (4, 8)]) == [("word", "een"), ("text", " "), ("word", "twee")]
    assert forms.with_notes("abc", [(1, "[n]"), (3, "!")]) == "a[n]bc!"
    assert forms.after_occurrence("a b a b", "b", 2) == 7 and forms.after_occurrence("a", "b", 1) is None
    assert forms.sentences("Een. Twee? drie") == [(0, 4), (5, 10), (11, 15)]
    assert forms.char_map("vj", "ui") [-1] == 2


@pytest.mark.parametrize(("text", "value"), [("iii", 3), ("iv", 4), ("xlii", 42), ("MDCXXXVII", 1637), ("19", 19), ("q", None), ("", None)])
def test_roman(text, value):
    assert forms.roman(text) == value


def test_likeness_counts_bytes():
    assert forms.likeness("a", "a") == 1.0 and forms.likeness("", "a") == 0.0
    assert forms.edit_distance("é".encode(), b"e") == 2


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    assert matching.assignment(np.zeros((0, 0))) == [] and matching.assignment([[]]) == []
    assert matching.assignment([[4, 2, 8], [2, 4, 7], [3, 8, 1]]) == [(0, 1), (1, 0), (2, 2)]
    assert len(matching.assignment([[1, 9], [9, 1], [9, 9]])) == 2
    for _ in range(200):
        rows, columns = (int(x) for x in rng.integers(1, 6, 2))
        cost = rng.integers(0, 9, (rows, columns)).astype(float)
        wide = cost if rows <= columns else cost.T
        best = min(sum(wide[i, p] for i, p in enumerate(pick)) for pick in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(cost[i, j] for i, j in matching.assignment(cost)) == best


OLD = "Maer ick bidde u, broeders, door den name onses Heeren Iesu Christi, dat ghy alle het selve spreeckt, ende dat onder u geene scheuringen en zijn, maer dat ghy te samen gevoeght zijt in eenen selven sin, ende in een selve gevoelen."
NEW = "Maar ik roep u ertoe op, broeders, door de Naam van onze Heere Jezus Christus, dat u allen eensgezind bent in uw spreken, en dat er onder u geen scheuringen zijn, maar dat u hecht aaneengesmeed bent, één van denken en één van gevoelen."


def test_historical_verse():
    got = matching.align_pair(forms.tokens(OLD), forms.tokens(NEW))
    assert got.unmatched_target == [2, 4, 5, 19, 21, 22, 24, 29, 38, 39, 41]
    assert got.particles == [28] and got.dropped_prefixes == []


@pytest.mark.parametrize(
    ("a", "b", "links"),
    [
        ("want xxzz", "omdat yyww", [(0, [0])]),
        ("dootsloegh", "sloeg dood", [(0, [0, 1])]),
        ("de beginne x de beginne", "het begin y het begin", [(0, [0, 1]), (1, [0, 1]), (3, [3, 4]), (4, [3, 4])]),
    ],
)
def test_bridges(a, b, links):
    assert [(x.src, x.tgt) for x in matching.align_pair(a.split(), b.split()).links] == links


def test_prefix_particle_and_forced():
    assert matching.align_pair("xx1 op dat xx2".split(), "xx1 dat xx2".split()).dropped_prefixes == [1]
    assert matching.align_pair("dit en is niet waar".split(), "dit is niet waar".split()).particles == [1]
    got = matching.align_pair("aaa bbb".split(), "bbb aaa".split(), [(0, 0)])
    assert (0, [0], 1.0, "manual") in [(x.src, x.tgt, x.score, x.kind) for x in got.links]
    assert all(x.src != 0 and 0 not in x.tgt for x in got.links if x.kind != "manual")


def test_pairwise():
    assert matching.sequence_links(["godt", "is", "goedt"], ["godt", "was", "goeder"]) == [(0, 0, 90), (2, 2, 70)]
    assert matching.positional_links([1, 2, 9], [2, 3]) == [(0, 0, 40), (1, 1, 40)]


def test_heuristic_prefers_unused_words():
    source = [{"id": k, "strongs": "G2532"} for k in (1, 2)] + [{"id": 3, "strongs": "G9"}]
    hints = {"G2532": {"en": 4}, "G9": {matching.EMPTY: 5}}
    got = matching.heuristic_links(source, [(10, "en"), (11, "en"), (12, "x")], hints)
    assert got == [(1, 10, 1.0, "manual_hint"), (2, 11, 1.0, "manual_hint")]


def test_component_rows():
    assert matching.component_rows([[1, 2], [10, 20, 30]], [(1, 10), (2, 20)]) == {1: 0, 2: 1, 10: 0, 20: 1, 30: 1}


def _plain_verse_numbers(seen, expected, confusable):
    """The whole table, cell by cell."""
    n, m = len(seen), len(expected)
    best = [[-float(i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    fit = lambda i, j: 2.0 if seen[i] == expected[j] else 2 * confusable(seen[i], expected[j]) - 1
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + fit(i - 1, j - 1), best[i - 1][j] - 1, best[i][j - 1] - 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + fit(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and best[i][j] == best[i - 1][j] - 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def test_verse_numbers_equal_the_whole_table():
    rng = random.Random(3)
    same = lambda a, b: (0.0, 0.5, 0.75, 1.0)[(a * 7 + b) % 4]
    for case in range(400):
        top = rng.choice((3, 30, 200))
        expected = [rng.randrange(top) for _ in range(rng.randrange(45))] if case % 2 else sorted(rng.sample(range(200), rng.randrange(45)))
        seen = [x + (rng.random() < 0.2) for x in expected if rng.random() < 0.8] if case % 3 else [rng.randrange(top) for _ in range(rng.randrange(45))]
        assert matching.verse_numbers(seen, expected, same) == _plain_verse_numbers(seen, expected, same)
        low = lambda a, b: same(a, b) / 2
        assert matching.verse_numbers(seen, expected, low, highest=0.5) == _plain_verse_numbers(seen, expected, low)


def test_verse_numbers_of_a_long_chapter_take_a_band():
    expected = list(range(1000))
    seen = [x + (x % 90 == 0) * 5000 for x in expected if x % 130]
    asked = []
    got = matching.verse_numbers(seen, expected, lambda a, b: asked.append(1) or 0.0)
    assert [j for i, j in got if i is None] == [x for x in expected if x % 130 == 0] and len(got) == 1000
    assert len(asked) < 100_000  # of a million pairs
