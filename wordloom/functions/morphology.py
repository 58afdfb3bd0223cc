"""Morphology codes in words (Dutch labels): Greek, Hebrew and Latin."""

from __future__ import annotations

# Labels of the Greek codes, by field.
GREEK_WORD = {
    "N": "Zelfst. naamwoord", "V": "Werkwoord", "A": "Bijv. naamwoord", "T": "Lidwoord", "P": "Pers. voornaamwoord",
    "R": "Betr. voornaamwoord", "C": "Wederkerig voornaamwoord", "D": "Aanw. voornaamwoord", "K": "Correlatief voornaamwoord", "I": "Vragend voornaamwoord",
    "X": "Onb. voornaamwoord", "Q": "Correlatief/vragend voornaamwoord", "F": "Reflexief voornaamwoord", "S": "Bez. voornaamwoord", "ADV": "Bijwoord",
    "CONJ": "Voegwoord", "COND": "Voorw. partikel", "PRT": "Partikel", "PREP": "Voorzetsel", "INJ": "Uitroep", "ARAM": "Aramese transliteratie", "HEB": "Hebreeuwse transliteratie",
}
TENSE = {"P": "Presens", "I": "Imperfectum", "F": "Futurum", "A": "Aoristus", "X": "Perfectum", "Y": "Plusquamperfectum", "2A": "2e aoristus", "2F": "2e futurum", "2X": "2e perfectum"}
VOICE = {"A": "Actief", "M": "Medium", "P": "Passief", "D": "Medium-deponens", "O": "Passief-deponens", "N": "Medium/passief", "E": "Medium/passief-deponens", "Q": "Actief/medium"}
MOOD = {"I": "Indicatief", "S": "Conjunctief", "O": "Optatief", "M": "Imperatief", "N": "Infinitief", "P": "Participium"}
CASE = {"N": "Nominatief", "G": "Genitief", "D": "Datief", "A": "Accusatief", "V": "Vocatief"}
NUMBER = {"S": "Enkelvoud", "P": "Meervoud"}
GENDER = {"M": "Mannelijk", "F": "Vrouwelijk", "N": "Onzijdig"}
DEGREE = {"C": "Comparatief", "S": "Superlatief"}
# Labels of the Hebrew codes, by field.
STEM = {
    "H": {"q": "Qal", "n": "Nifal", "p": "Piël", "P": "Puël", "h": "Hifil", "H": "Hofal", "t": "Hitpaël", "o": "Polal", "u": "Poël", "c": "Tifil", "D": "Nitpaël"},
    "A": {"q": "Peal", "l": "Peal", "L": "Peil", "m": "Paël", "f": "Hafel", "a": "Afel", "A": "Hafel", "e": "Shafel"},
}
FORM = {
    "p": "Perfectum", "q": "Consecutief perfectum", "i": "Imperfectum", "n": "Imperfectum (indicatief)", "j": "Jussief", "c": "Cohortatief",
    "w": "Consecutief imperfectum", "v": "Imperatief", "r": "Participium actief", "s": "Participium passief", "a": "Infinitief absoluut",
}
PARTICLE = {
    "d": "Bep. lidwoord", "a": "Bep. lidwoord", "i": "Vragend partikel", "n": "Ontkennend partikel", "o": "Lijdend-voorwerpindicator", "r": "Betrekkelijk partikel",
    "j": "Uitroep", "m": "Aanw. partikel", "c": "Voorw. partikel", "h": "Paragogische hé", "u": "Paragogische nun",
}
SUFFIX = {"d": "Richting-suffix", "h": "Paragogische hé", "n": "Paragogische nun"}
PRONOUN = {"p": "Persoonlijk", "r": "Betrekkelijk", "d": "Aanwijzend", "i": "Onbepaald", "x": "Reflexief"}
NOUN = {"p": "Eigennaam", "g": "Zelfstandig naamwoord (gentilicium)"}
ADJECTIVE = {"c": "Telwoord", "o": "Rangtelwoord"}
PERSONS = {"1": "1e persoon", "2": "2e persoon", "3": "3e persoon"}
GENDERS = {"m": "mannelijk", "f": "vrouwelijk", "b": "beide geslachten", "c": "beide geslachten"}
NUMBERS = {"s": "enkelvoud", "p": "meervoud", "d": "dualis"}
STATES = {"a": "absoluut", "c": "construct", "d": "bepaald"}
# Labels of Latin features, in the order in which they are given.
LATIN = {
    "Case": {"Nom": "Nominatief", "Gen": "Genitief", "Dat": "Datief", "Acc": "Accusatief", "Abl": "Ablatief", "Voc": "Vocatief", "Loc": "Locatief"},
    "Number": {"Sing": "Enkelvoud", "Plur": "Meervoud"},
    "Gender": {"Masc": "Mannelijk", "Fem": "Vrouwelijk", "Neut": "Onzijdig"},
    "Tense": {"Pres": "Tegenwoordige tijd", "Past": "Verleden tijd", "Fut": "Toekomende tijd", "Pqp": "Voltooid verleden tijd"},
    "Mood": {"Ind": "Aantonende wijs", "Sub": "Aanvoegende wijs", "Imp": "Gebiedende wijs"},
}


def _said(*labels: str | None) -> str:
    return ", ".join(x for x in labels if x)


def _read(code: str, *fields: dict[str, str]) -> list[str]:
    """One label per letter, in order; letters without a label have none."""
    return [field.get(c, "") for c, field in zip(code, fields, strict=False)]


def _person(c: str) -> str:
    return f"{c}e persoon" if c in "123" else f"{c} persoon"


def greek(code: str) -> str:
    if not code:
        return ""
    word, *rest = code.split("-")
    label = GREEK_WORD.get(word, word)
    if not rest:
        return label
    if word == "V":
        at = 2 if rest[0].startswith("2") else 1
        tense, voice, mood = rest[0][:at], rest[0][at : at + 1], rest[0][at + 1 : at + 2]
        out = [label, TENSE.get(tense, tense), VOICE.get(voice, voice), MOOD.get(mood, mood)]
        if len(rest) > 1 and rest[1]:
            end = rest[1]
            out += [_person(end[0]), *_read(end[1:2], NUMBER)] if end[0].isdigit() else [CASE.get(end[0], end[0]), *_read(end[1:], NUMBER, GENDER)]
        return _said(*out)
    out = [label]
    if len(rest[0]) >= 2:
        at = int(word in "PFS" and rest[0][0].isdigit())
        out += [_person(rest[0][0])] * at + _read(rest[0][at:], CASE, NUMBER, GENDER)
        out += [DEGREE.get(x, x) for x in rest[1:2]]
    return _said(*out)


def _verb(code: str, language: str) -> str:
    if not code:
        return "Werkwoord"
    stem = STEM["A" if language == "A" else "H"].get(code[0], code[0])
    if len(code) < 2:
        return _said("Werkwoord", stem)
    form, end = code[1], code[2:]
    if form in "ac" and end and not end[0].isdigit():
        return _said("Werkwoord", stem, "Infinitief absoluut" if form == "a" else "Infinitief construct")
    if form in "rs":
        return _said("Werkwoord", stem, FORM[form], *_read(end, GENDERS, NUMBERS, STATES))
    fields = (PERSONS, GENDERS, NUMBERS) if len(end) >= 3 else (GENDERS, NUMBERS) if len(end) == 2 else ()
    return _said("Werkwoord", stem, FORM.get(form, form), *_read(end, *fields))


def _hebrew_part(code: str) -> str:
    if len(code) < 2:
        return code
    kind, rest = code[1], code[2:]
    if kind == "V":
        return _verb(rest, code[0])
    if kind in "NA":
        plain, special = ("Zelfstandig naamwoord", NOUN) if kind == "N" else ("Bijvoeglijk naamwoord", ADJECTIVE)
        return _said(special.get(rest[:1], plain), *_read(rest[1:], GENDERS, NUMBERS, STATES))
    if kind == "P":
        name = f"{PRONOUN[rest[0]]} voornaamwoord" if rest[:1] in PRONOUN and rest else "Voornaamwoord"
        return _said(name, *_read(rest[1:3], GENDERS, NUMBERS))
    simple = {
        "T": PARTICLE.get(rest[:1], "Partikel"),
        "R": "Voorzetsel (bepaald)" if rest.startswith("d") else "Voorzetsel",
        "C": "Voegwoord",
        "c": "Consecutief voegwoord",
        "D": "Bijwoord",
        "S": SUFFIX.get(rest[:1], "Suffix"),
    }
    return simple.get(kind, code)


def hebrew(code: str) -> str:
    """Parts are split by /; all are of the language of the first letter."""
    if not code:
        return ""
    first, *more = code.split("/")
    return " + ".join(x for x in (_hebrew_part(first), *(_hebrew_part(code[0] + p) for p in more)) if x)


def latin(features: str | None) -> str:
    given = dict(p.split("=", 1) for p in (features or "").split("|") if "=" in p)
    return _said(*[labels.get(given[name], given[name]) for name, labels in LATIN.items() if name in given])
