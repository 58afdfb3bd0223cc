"""Word forms and text functions that SQL has no expression for, as plain functions and as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

# Spelling rules in their order of application (^ word start, $ word end).
SPELLING = (
    (r"^gh", "g"),
    (r"heyt$", "heid"),
    (r"eyt$", "eid"),
    (r"gh(?!eid)", "g"),
    (r"^s(?=[aeiouy])", "z"),
    (r"dts$", "ds"),
    (r"lick", "lijk"),
    (r"ck", "k"),
    (r"uy", "ui"),
    (r"ey", "ei"),
    (r"ae", "aa"),
    (r"sch(?=s?$)", "s"),
    (r"dt$", "d"),
    (r"([lnr])t$", r"\1d"),
    (r"^([bcdfghjklmnpqrstvwz]*)([aeiou])\2(?=[bcdfghjklmnpqrstvwz][aeiou])", r"\1\2"),
    (r"y", "ij"),
)
# Forms that no rule reaches.
LEXICON = {
    "ende": "en", "vleeschs": "vlees", "vleses": "vlees", "vleses,": "vlees", "levens": "leven", "oogen": "oog", "ogen": "oog",
    "des": "van", "der": "van", "den": "de", "sijnen": "zijn", "noch": "nog", "geliefde": "geliefden", "alsoo": "zo", "alzo": "zo",
    "soo": "zo", "oock": "ook", "malkanderen": "elkander", "genaemt": "genaamd", "wesen": "wezen", "daerom": "daarom",
    "daarom": "daarom", "sone": "zoon", "zone": "zoon", "godts": "god", "gods": "god", "rechtveerdigheyt": "rechtvaardigheid",
    "yegelick": "iegelijk", "cain": "kain", "boosen": "boze", "dootsloegh": "doodsloeg", "oorsake": "oorzaak", "doot": "dood",
    "gelooven": "geloven", "name": "naam", "iesu": "jezus", "christi": "christus", "waarom": "waarom", "jesu": "jezus", "wille": "wil",
    "gemeynte": "gemeente", "corinthen": "korinthe", "christo": "christus", "plaetse": "plaats", "onses": "onze", "bidde": "bid",
    "selve": "zelfde", "selven": "zelfden", "eenen": "een", "geene": "geen", "gevoeght": "gevoegd", "predikinge": "prediking",
    "behaeght": "behaagd", "aaneengesmeed": "aaneengesmeed",
}
# Words that the rules would change wrongly.
EXEMPT = frozenset("want niet met dat wat het tot uit is en samen samengevoegd bent".split())
_RULES = tuple((re.compile(p), r) for p, r in SPELLING)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def unaccented(text: str, form: str = "NFD") -> str:
    return "".join(c for c in unicodedata.normalize(form, text) if unicodedata.category(c) != "Mn")


def raw_form(token: str) -> str:
    """Lower case without marks and without anything that is not a word character."""
    return re.sub(r"[^\w]", "", unaccented(token.lower(), "NFKD"))


def normal_form(token: str, lexicon: dict[str, str] = LEXICON) -> str:
    """The modern spelling of a historical word: the lexicon, else the rules and the lexicon again."""
    word = raw_form(token)
    if word in lexicon or word in EXEMPT or not word:
        return lexicon.get(word, word)
    for pattern, to in _RULES:
        word = pattern.sub(to, word)
    return lexicon.get(word, word)


def tokens(text: str) -> list[str]:
    """Words and single punctuation marks; a word that a hyphen breaks is one."""
    found = _TOKEN.findall(text)
    out: list[str] = []
    at = 0
    while at < len(found):
        if found[at + 1 : at + 2] == ["-"] and at + 2 < len(found) and found[at].isalpha() and found[at + 2].isalpha():
            out.append(found[at] + found[at + 2])
            at += 3
        else:
            out.append(found[at])
            at += 1
    return out


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    """0.7 of the edit similarity and 0.3 of the shared start, over the longer word; lengths in bytes."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = a.encode(), b.encode()
    longest = max(len(x), len(y))
    start = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return 0.7 * (1.0 - edit_distance(x, y) / longest) + 0.3 * start / longest


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def latin_form(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower().translate(str.maketrans("vj", "ui"))


def char_map(old: str, new: str) -> list[int]:
    """For every offset of old (and its end) the offset in new that sequence matching gives it.

    Where both have as many words, matching goes word by word."""
    a, b = list(re.finditer(r"\S+|\s+", old)), list(re.finditer(r"\S+|\s+", new))
    pairs = zip(a, b, strict=True) if len(a) == len(b) else ()
    spans = [(x.span(), y.span()) for x, y in pairs] or [((0, len(old)), (0, len(new)))]
    out = [0] * len(old) + [len(new)]
    for (p, q), (r, s) in spans:
        for op, c, d, e, f in SequenceMatcher(None, old[p:q], new[r:s], autojunk=False).get_opcodes():
            for k in range(c, d):
                out[p + k] = r + e + (k - c if op == "equal" else min(k - c, f - e))
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(from, to) of the sentences: cut where white space follows a full stop, ! or ?."""
    out, at = [], 0
    for gap in re.finditer(r"(?<=[.!?])\s+", text):
        out.append((at, gap.start()))
        at = gap.end()
    return out + [(at, len(text))] if at < len(text) else out


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """Runs (equal, delete or insert; text) along a longest common subsequence of the words;
    where both ways are as long, deletions come first."""
    a, b = old.split(), new.split()
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in reversed(list(enumerate(a))):
        for j, y in reversed(list(enumerate(b))):
            best[i][j] = 1 + best[i + 1][j + 1] if x == y else max(best[i + 1][j], best[i][j + 1])
    runs: list[tuple[str, list[str]]] = []

    def add(op: str, word: str) -> None:
        if not runs or runs[-1][0] != op:
            runs.append((op, []))
        runs[-1][1].append(word)

    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            add("equal", a[i])
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            add("delete", a[i])
            i += 1
        else:
            add("insert", b[j])
            j += 1
    return [(op, " ".join(words)) for op, words in runs]


def differing_ranges(old: str, new: str) -> list[tuple[int, int]]:
    """(from, to) in new of the words that the longest common subsequence leaves out."""
    kept = [op == "equal" for op, text in word_diff(old, new) for _ in text.split() if op != "delete"]
    return [m.span() for m, keep in zip(re.finditer(r"\S+", new), kept, strict=True) if not keep]


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int | None:
    """The value of a roman or arabic numeral, or None."""
    if text.isdigit():
        return int(text)
    values = [ROMAN.get(c) for c in text.lower()]
    if not values or None in values:
        return None
    return sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))


def place_words(text: str, words: list[str]) -> list[tuple[int, int] | None]:
    """(start, end) of each word, searched forward in the text; None where it is not found."""
    out, at = [], 0
    for w in words:
        found = text.find(w, at) if w else -1
        out.append((found, found + len(w)) if found >= 0 else None)
        at = found + len(w) if found >= 0 else at
    return out


def with_punctuation(text: str, words: list[str]) -> list[str]:
    """Each word with the punctuation that follows it in the text."""
    out = []
    for w, span in zip(words, place_words(text, words), strict=True):
        tail = re.match(r"[^\w\s]*", text[span[1] :]).group() if span else ""
        out.append(w + tail)
    return out


def parts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """The text as parts (word or text); spans that overlap an earlier one are skipped."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        if a > at:
            out.append(("text", text[at:a]))
        out.append(("word", text[a:b]))
        at = b
    if at < len(text):
        out.append(("text", text[at:]))
    return out


def with_notes(text: str, notes: list[tuple[int, str]]) -> str:
    """The text with each note put in at its offset, in order."""
    out, at = [], 0
    for offset, note in sorted(notes, key=lambda x: x[0]):
        offset = min(max(offset, at), len(text))
        out += [text[at:offset], note]
        at = offset
    return "".join([*out, text[at:]])


def after_occurrence(text: str, phrase: str, occurrence: int) -> int | None:
    """The offset after the n-th occurrence (from 1) of a phrase, or None."""
    at = -1
    for _ in range(occurrence):
        at = text.find(phrase, at + 1)
        if at < 0:
            return None
    return at + len(phrase)


def _series(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def udf_raw_form():
    return _series(raw_form, "string")


def udf_normal_form():
    return _series(normal_form, "string")


def udf_unaccented():
    return _series(unaccented, "string")


def udf_tokens():
    return _series(tokens, "array<string>")


def udf_sentences():
    return _series(lambda x: [{"start": a, "end": b} for a, b in sentences(x)], "array<struct<start:int,end:int>>")


def udf_word_diff():
    @F.pandas_udf("array<struct<op:string,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "text": t} for o, t in word_diff(x or "", y or "")] for x, y in zip(a, b, strict=True)])

    return run
