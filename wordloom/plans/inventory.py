"""The status of every operator of the survey: done (with queries or functions), partial, or out of scope (with the reason)."""

from __future__ import annotations

import re

from .catalog import QUERIES

#: Ids by group: prefix and the last number.
GROUPS = {"S": 20, "M": 37, "P": 20, "J": 22, "A": 21, "W": 9, "O": 8, "U": 6, "F": 54, "C": 32, "R": 29, "T": 10}
OUT = {
    "S10": "same parser as S9, other site; no network to fetch pages",
    "S16": "parser of one printed work",
    "S17": "parsers of single printed works",
    "S18": "remote acquisition; no network",
    "C32": "needs an external model service; its selections are J17 and A13, its checks C19",
    "T4": "needs page images of one work",
    "T5": "needs page images of one work",
    "T9": "numbering repair of one work; the alignment it rests on is C24",
    "T10": "verse splitting of one work",
}
PARTIAL = {
    "S8": "verses and words through sources.readers.xml_verses; the anchor state machine of one edition is not",
    "C20": "windows only; the aligner is an external model",
    "F15": "the Greek reader keeps the transliterated word",
    "F31": "reference lists are read by functions.references; the old apparatus is not",
    "F32": "reference lists are read by functions.references; sticky books of one edition are not",
    "F14": "unaccented keys only, no list of Hebrew variants",
    "F41": "paragraph split (T7) and script ranges (P8)",
}
FUNCTIONS = {
    "S5": "sources.readers.hebrew_words", "S6": "sources.readers.greek_words", "S7": "sources.readers.xml_verses", "S9": "sources.readers.html_verses",
    "S11": "sources.readers.html_references", "S12": "sources.readers.dictionary", "S13": "sources.readers.jsonl", "S14": "sources.readers.csv", "S15": "operators.alignment.snapshot_diff over two CSV reads",
    "M23": "operators.state.upsert_if, query m23_lock_status", "M34": "operators.state.update_from with A5", "F2": "query f2_padded_strongs", "F13": "functions.forms.unaccented",
    "F24": "functions.forms.place_words", "F53": "to_json and from_json, query m28_flags_by_key", "R24": "query m27_replace_import", "C11": "functions.matching.align_pair", "C9": "functions.matching.positional_links",
    "U3": "query m11_dedupe_keep_min",
}


def status() -> dict[str, str]:
    """id -> status, for every id of every group."""
    by: dict[str, list[str]] = {}
    for name in QUERIES:
        for part in re.match(r"(?:[a-z]\d+_)+", name).group().split("_")[:-1]:
            by.setdefault(part.upper(), []).append(name)
    out = {}
    for group, last in GROUPS.items():
        for k in range(1, last + 1):
            i = f"{group}{k}"
            if i in OUT:
                out[i] = f"out of scope: {OUT[i]}"
            elif i in PARTIAL:
                out[i] = f"partial: {PARTIAL[i]}"
            elif i in by or i in FUNCTIONS:
                out[i] = "done: " + ", ".join([*([FUNCTIONS[i]] if i in FUNCTIONS else []), *by.get(i, [])])
            else:
                out[i] = "open"
    return out
