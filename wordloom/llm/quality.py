"""Quality rules as weak supervision.

Each rule votes +1 (good), -1 (bad) or abstains (0).  Rules overlap: a defect is seen
by several of them, and each errs on some documents.  Expectation-maximisation over
the votes of all documents estimates, without labels, the accuracy of every rule on
good and on bad documents (abstaining says nothing); a document's verdict is its
posterior probability of being good, so one rule against the others does not reject
it.  Votes have at most 3 ** len(RULES) patterns, so the model is fitted exactly on
pattern counts: what reaches the driver is bounded by the number of rules, not by the
corpus.

A null or empty text has no words and fails the base test; an empty table gives no
rows.  A very long text is measured whole, on its own.  Repeat rows, equal ids, null
ids and extra columns need no care: each row is judged on its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .base import staged, store, table

RULES = ("symbols", "letters", "marked_words", "word_length", "capitals", "exclamations", "repeated_words", "repeated_lines", "variety", "sentences")
#: Pseudo-counts, in documents: (right, wrong) votes of a rule on good and on bad
#: documents, and (good, bad) documents. They keep estimates finite and say which
#: class is the bad one; a handful of documents outweighs them.
ON_GOOD, ON_BAD, CLASSES = (4.0, 1.0), (2.0, 1.0), (2.0, 1.0)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ", ".join(f"{c} long" for c in COUNTS) + ", pattern int"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs twice or more, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """What the rules look at, for each row."""
    n = len(off) - 1
    s, e, rows = K.words(buf, off)
    tag = K.mix(np.arange(1, n + 1).astype(np.uint64))
    count = lambda byte: _per_row(buf == byte, off)
    out = {"n_words": np.bincount(rows, minlength=n), "n_symbols": _per_row(_SYMBOL[buf], off)}
    out["word_chars"] = _per_row(K._WORD[buf] & ~_CONT[buf], off)
    h = K.word_hashes(buf, s, e)
    # three-word windows, each a range of words
    win = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    many, _ = _repeats(K.Rolling(h).ranges(win, win + 3) ^ tag[rows[win]])
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, win[many], 1)
    np.add.at(cover, win[many] + 3, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    # lines: from a document's start or a newline to the next
    breaks = np.flatnonzero(buf == 10)
    row_of_break = np.searchsorted(off, breaks, "right") - 1
    begin = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((off[1:], breaks)), kind="stable")
    line_row = np.sort(np.concatenate((np.arange(n), row_of_break)), kind="stable")
    filled = np.concatenate(([0], np.cumsum(K._WORD[buf], dtype=np.int64)))
    filled = filled[end] > filled[begin]
    _, later = _repeats((K.Rolling(K.byte_values(buf)).ranges(begin, end) ^ tag[line_row])[filled])
    out["n_dup_lines"] = np.bincount(line_row[filled][later], minlength=n)
    out["lines"] = np.bincount(line_row[filled], minlength=n)
    _, seen = _repeats(h ^ tag[rows])
    out["distinct"] = out["n_words"] - np.bincount(rows[seen], minlength=n)
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    letter = upper | lower | (buf >= 0xC0)  # beyond ASCII a lead byte stands for a letter
    # words that hold a symbol, or no letter
    many_symbols, many_letters = (np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (_SYMBOL[buf], letter))
    marked = (many_symbols[e] > many_symbols[s]) | (many_letters[e] == many_letters[s])
    out["marked"] = np.bincount(rows[marked], minlength=n)
    out["letters"] = _per_row(letter & K._WORD[buf], off)
    out |= {"upper": _per_row(upper, off), "bangs": count(33), "stops": count(46) + count(63)}
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, RULES) of -1, 0 and 1."""
    words = np.maximum(m["n_words"], 1)

    def rule(share: np.ndarray, good: float, bad: float, heard=True) -> np.ndarray:
        return np.where(heard, np.where(share >= bad, -1, np.where(share <= good, 1, 0)), 0)

    long = m["n_words"] >= 20
    per_stop = words / np.maximum(m["stops"], 0.5)
    chars = np.maximum(m["word_chars"], 1)
    odd_length = np.abs(m["word_chars"] / words - 5.5)
    return np.stack(
        [
            rule(m["n_symbols"] / words, 0.05, 0.2),
            rule(-m["letters"] / chars, -0.88, -0.8),
            rule(m["marked"] / words, 0.05, 0.2),
            rule(odd_length, 1.2, 1.6, long),
            rule(m["upper"] / np.maximum(m["letters"], 1), 0.1, 0.3, m["letters"] > 0),
            rule(m["bangs"] / words, 0.02, 0.1),
            rule(m["n_repeat_words"] / words, 0.05, 0.1, long),
            rule(m["n_dup_lines"] / np.maximum(m["lines"], 1), 0.1, 0.2, m["lines"] >= 3),
            rule(-m["distinct"] / words, -0.65, -0.55, long),
            rule(per_stop, 25, 40, long),
        ],
        axis=1,
    ).astype(np.int64)


def _features(text_at: int):
    powers = 3 ** np.arange(len(RULES))

    def of(batch: pa.RecordBatch) -> list[np.ndarray]:
        buf, off = K.buffer_of(batch.column(text_at))
        parts = []
        for i, j in K.chunks(off):
            m = measure(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append([*(m[c] for c in COUNTS), (votes(m) + 1) @ powers])
        return [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * (len(COUNTS) + 1)

    return of


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior P(good) of each vote pattern, and what was estimated: the share of good
    documents, and the accuracy of each rule (of its votes, not counting abstentions) on
    good and on bad documents.

    Two classes, votes independent given the class.  A rule that votes alike on both has
    no say; one that a class contradicts most of the time speaks against it.  EM starts
    from the share of bad votes of each pattern and runs until no posterior moves by
    1e-9 (or for `rounds` rounds)."""
    v = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3  # 0 bad, 1 abstain, 2 good
    good, bad, weight = (v == 2).astype(float), (v == 0).astype(float), counts.astype(float)
    post = 1 - bad.sum(1) / np.maximum((good + bad).sum(1), 1)
    for _ in range(rounds):
        yes, no = post * weight, (1 - post) * weight
        on_good = (yes @ good + ON_GOOD[0]) / (yes @ (good + bad) + sum(ON_GOOD))
        on_bad = (no @ bad + ON_BAD[0]) / (no @ (good + bad) + sum(ON_BAD))
        share = (yes.sum() + CLASSES[0]) / (weight.sum() + sum(CLASSES))
        odds = np.log(share / (1 - share)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    return post, {"share": share, "on_good": on_good, "on_bad": on_bad}


def _patterns(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns and their counts; at most 3 ** len(RULES) rows reach the driver.
    Documents that fail the base test are judged already and are no part of the fit."""
    ok = F.expr(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    rows = sorted(tuple(r) for r in features.where(ok).groupBy("pattern").count().collect())
    return tuple(np.array(rows, dtype=np.int64).reshape(-1, 2).T)


def accuracies(docs: DataFrame) -> DataFrame:
    """rule, good_votes, bad_votes, abstained, accuracy_on_good, accuracy_on_bad, as estimated from the votes on docs."""
    patterns, counts = _patterns(features(docs))
    v = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3
    _, model = fit(patterns, counts)
    number = lambda kind: ((v == kind) * counts[:, None]).sum(0).tolist()
    rows = list(zip(RULES, number(2), number(0), number(1), model["on_good"].tolist(), model["on_bad"].tolist(), strict=True))
    return docs.sparkSession.createDataFrame(rows, "rule string, good_votes long, bad_votes long, abstained long, accuracy_on_good double, accuracy_on_bad double")


def features(docs: DataFrame) -> DataFrame:
    of = _features(1)

    @K.tidy
    def run(batches):
        names = ["doc_id", *COUNTS, "pattern"]
        for batch in batches:
            *cols, pattern = of(batch)
            arrays = [batch.column(0), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(pattern.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {FEATURES}")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, the posterior and kept for every row of docs."""
    found = store(features(docs), "quality", scanned=True)
    patterns, counts = _patterns(found)
    rows = list(zip(patterns.tolist(), fit(patterns, counts)[0].tolist(), strict=True))
    model = docs.sparkSession.createDataFrame(rows, "pattern int, quality double")  # at most 3 ** len(RULES) rows
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    out = found.join(F.broadcast(model), "pattern", "left").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("quality") >= 0.5, F.lit(False))
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.col("quality")).alias("quality"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


@staged
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail the base test or are more likely bad than
    good go; the others stay with all their columns.  Each text is measured once: rows
    are stored with what their rules voted, the model is fitted on all votes, and the
    verdict is a filter on the stored rows.  No text is shuffled.  Special rows: see
    the module's text."""
    of = _features(docs.columns.index("text"))

    @K.tidy
    def run(batches):
        for batch in batches:
            found = [pa.array(x.astype(np.int64)) for x in of(batch)]
            row = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            yield pa.RecordBatch.from_arrays([row, *found[:-1], found[-1].cast(pa.int32())], ["row", *COUNTS, "pattern"])

    measured = docs.mapInArrow(run, f"row {docs.schema.simpleString()}, {FEATURES}")
    measured = store(measured, "quality-stage", scanned=True)
    patterns, counts = _patterns(measured)
    good = [int(p) for p, q in zip(patterns, fit(patterns, counts)[0], strict=True) if q >= 0.5]
    model = spark.createDataFrame([(p,) for p in good], "pattern int")  # at most 3 ** len(RULES) rows
    ok = f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words"
    return measured.where(ok).join(F.broadcast(model), "pattern", "left_semi").select("row.*")
