"""Modernising rules: whole words and phrases first, then wildcard patterns in their order.

A rule's source is a word, a phrase of words, or a pattern with * at its start, its end
or both.  The longest phrase wins, and a rule with capitals (matched as written) before one
without (matched in any case, with the case of the text kept).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    exceptions: frozenset[str] = field(default_factory=frozenset)


def problem(rule: Rule) -> str | None:
    """Why a rule cannot be used, or None."""
    if not rule.source.strip() or not rule.target.strip():
        return "empty"
    if rule.source == rule.target:
        return "no change"
    stars = rule.source.count("*")
    if stars != rule.target.count("*"):
        return "stars differ"
    inner = rule.source[1:-1]
    if "*" in inner or (stars and " " in rule.source) or rule.source.strip("*") == "":
        return "misplaced star"
    return None


def in_case_of(model: str, word: str) -> str:
    if len(model) > 1 and model.isupper():
        return word.upper()
    if model[:1].isupper():
        return word[:1].upper() + word[1:]
    return word


class Speller:
    def __init__(self, rules: Iterable[Rule]) -> None:
        self.cased: dict[tuple[str, ...], Rule] = {}
        self.plain: dict[tuple[str, ...], Rule] = {}
        self.patterns: list[tuple[re.Pattern, Rule]] = []
        self.longest = 1
        for rule in rules:
            if problem(rule):
                continue
            if "*" in rule.source:
                # a star stands for at least one letter
                body = "(.+)".join(map(re.escape, rule.source.split("*")))
                self.patterns.append((re.compile(body, re.IGNORECASE), rule))
                continue
            words = tuple(rule.source.split())
            self.longest = max(self.longest, len(words))
            where = self.cased if rule.source != rule.source.lower() else self.plain
            where.setdefault(words, rule)

    def _pattern(self, word: str) -> str:
        for pattern, rule in self.patterns:
            if word.lower() in rule.exceptions:
                continue
            hit = pattern.fullmatch(word)
            if hit:
                pieces = rule.target.split("*")
                kept = list(hit.groups())
                changed = pieces[0] + "".join(k + p for k, p in zip(kept, pieces[1:], strict=True))
                word = in_case_of(word, changed) if word[:1] != changed[:1] else changed
        return word

    def apply(self, text: str) -> str:
        found = list(_WORD.finditer(text))
        out, at, k = [], 0, 0
        while k < len(found):
            for n in range(min(self.longest, len(found) - k), 0, -1):
                own = found[k : k + n]
                # the words of a phrase are parted by white space alone
                if any(text[a.end() : b.start()].strip() for a, b in zip(own, own[1:], strict=False)):
                    continue
                words = tuple(m.group() for m in own)
                rule = self.cased.get(words) or self.plain.get(tuple(w.lower() for w in words))
                if rule and words[0].lower() not in rule.exceptions:
                    to = rule.target if words in self.cased else in_case_of(words[0], rule.target)
                    break
            else:
                n, to = 1, self._pattern(found[k].group())
            out += [text[at : found[k].start()], to]
            at = found[k + n - 1].end()
            k += n
        return "".join([*out, text[at:]])


def udf_spelling(rules: Sequence[Rule]):
    """Applies the rules to a text column. The rules are a library of a bounded size and travel with the function."""
    speller = Speller(rules)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(speller.apply, na_action="ignore")

    return run
