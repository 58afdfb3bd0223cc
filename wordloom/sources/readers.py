"""Readers of source files into typed frames, and the CSV and JSON sinks.

Line formats are read as text and parsed by SQL expressions; documents that are one
tree (XML, HTML) are parsed per file or row in Arrow batches.  Book codes are a small
map that the caller passes, and travel as a literal.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forms

#: Text types that are read: the main text, its read form, restored and added words. K, what a read form replaces, is not.
TYPES = ("L", "Q", "R", "X")
_REF = r"^(\d?[A-Z][A-Za-z0-9]*)\.(\d+)\.(\d+)#(\d+)=([A-Za-z]+)"
_TOKEN = r"(\S+)\s+(\d+)(?:\s+\d+)?\s+\{([^}]+)\}"


def _book(code: Column, books: Mapping[str, int]) -> Column:
    pairs = [F.lit(x) for k, v in books.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), code) if pairs else F.lit(None).cast("int")


def root_strongs(tags: str) -> Column:
    """The id in braces, four digits and its suffix; numbers from 9000 are grammar, not words."""
    digits = F.regexp_extract(tags, r"\{\s*H(\d+)", 1)
    number = F.when(digits != "", digits.cast("int"))
    suffix = F.regexp_extract(tags, r"\{\s*H\d+([^}]*)\}", 1)
    return F.when(number < 9000, F.concat(F.format_string("H%04d", number), F.trim(suffix)))


def hebrew_words(spark: SparkSession, path: str, books: Mapping[str, int]) -> DataFrame:
    """Tab separated words: reference, word, transliteration, gloss, dictionary tags, grammar. Blank lines,
    comments, repeated headers, short rows, unknown books and replaced words are left out."""
    cols = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(cols) >= 6)).select(*[F.trim(F.get(cols, F.lit(i))).alias(f"c{i}") for i in range(6)])
    part = lambda k: F.regexp_extract("c0", _REF, k)
    kind = F.upper(part(5))
    word = F.regexp_replace(F.regexp_replace("c1", r"\\[A-Z0-9]+$", ""), r"[\\/]", "")
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    out = rows.where(F.col("c0").rlike(_REF) & kind.isin(*TYPES)).select(
        _book(part(1), books).alias("book_id"),
        part(2).cast("int").alias("chapter"),
        part(3).cast("int").alias("verse"),
        part(4).cast("int").alias("word_position"),
        F.trim(word).alias("word_text"),
        none("c2").alias("transliteration"),
        root_strongs("c4").alias("strongs"),
        none("c5").alias("morph_code"),
        F.lit(False).alias("is_ketiv"),
        (kind == "Q").alias("has_qere"),
    )
    return out.where("book_id is not null")


def greek_words(spark: SparkSession, path: str, books: Mapping[str, int]) -> DataFrame:
    """Files of one book each, named by its code: lines `chapter:verse word number {parse} ...` that may
    wrap. A file is one row, cut into verses where a line starts with a reference."""
    files = spark.read.text(path, wholetext=True).select("value", F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)).alias("code"))
    one = F.regexp_replace("value", r"\r", "")
    verses = files.select(_book(F.col("code"), books).alias("book_id"), F.explode(F.split(F.concat(F.lit("\n"), one), r"\n(?=\d+:\d+\s)")).alias("v"))
    verses = verses.where("book_id is not null").where(F.col("v").rlike(r"^\d+:\d+\s"))
    token = F.expr(r"regexp_extract_all(v, '(\\S+\\s+\\d+(?:\\s+\\d+)?\\s+\\{[^}]+\\})', 1)")
    part = lambda k: F.regexp_extract("t", _TOKEN, k)
    rows = verses.select(
        "book_id", F.regexp_extract("v", r"^(\d+):", 1).cast("int").alias("chapter"), F.regexp_extract("v", r"^\d+:(\d+)", 1).cast("int").alias("verse"), F.posexplode(token).alias("p", "t")
    )
    number = part(2).cast("int")
    return rows.select(
        "book_id", "chapter", "verse", (F.col("p") + 1).alias("word_position"), part(1).alias("beta_code"), F.when(number > 0, F.format_string("G%04d", number)).alias("strongs"), F.trim(part(3)).alias("parse_code")
    )


def _parsed(files: DataFrame, column: str, f, schema: str) -> DataFrame:
    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for x in batch[column] if x is not None for r in f(x)], columns=names)

    return files.select(column).mapInPandas(run, schema)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def xml_verses(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, chapter, verse, text) of BIBLEBOOK / CHAPTER / VERS trees; tags inside a verse are
    dropped, white space is one blank; books outside 1 to 66 and empty verses are left out."""

    def f(text: str) -> Iterator[tuple]:
        for book in ET.fromstring(text.encode()).iter("BIBLEBOOK"):
            for chapter in book.findall("CHAPTER"):
                for verse in chapter.findall("VERS"):
                    words = " ".join(" ".join(x.strip() for x in verse.itertext() if x.strip()).split())
                    try:
                        key = int(book.get("bnumber", "0")), int(chapter.get("cnumber", "0")), int(verse.get("vnumber", "0"))
                    except ValueError:
                        continue
                    if words and 1 <= key[0] <= 66:
                        yield *key, words

    return _parsed(_whole(spark, path), "value", f, "book_id int, chapter int, verse int, text string")


def dictionary(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(strongs_id, lemma, definition) of `entry` elements; ids have no leading zeros, and a linked
    word inside a definition reads `H1 (lemma, sound)`."""

    def inline(e: ET.Element) -> str:
        if e.tag.split("}")[-1] == "w" and e.get("src"):
            src = e.get("src")
            detail = ", ".join(x for x in (e.get("lemma"), e.get("xlit")) if x)
            return f"H{int(src) if src.isdigit() else src}" + (f" ({detail})" if detail else "")
        return (e.text or "") + "".join(inline(c) + (c.tail or "") for c in e)

    def f(text: str) -> Iterator[tuple]:
        for e in ET.fromstring(text.encode()).iter():
            if e.tag.split("}")[-1] == "entry" and e.get("n"):
                n = e.get("n").lstrip(prefix)
                word = next((c for c in e if c.tag.split("}")[-1] == "w"), None)
                rest = " ".join(" ".join(("" if c is word else inline(c)) + (c.tail or "") for c in e).split())
                yield f"{prefix}{int(n) if n.isdigit() else n}", None if word is None else word.text, rest

    return _parsed(_whole(spark, path), "value", f, "strongs_id string, lemma string, definition string")


class _Verses(HTMLParser):
    """Text of spans that carry a verse id; links and note spans inside do not count."""

    def __init__(self, attribute: str, skip: tuple[str, ...]) -> None:
        super().__init__()
        self.attribute, self.skip = attribute, skip
        self.stack: list[tuple[str, str | None, bool, bool]] = []
        self.found: list[tuple[str, str, bool]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        outer = self.stack[-1] if self.stack else ("", None, False, False)
        self.stack.append((tag, given.get(self.attribute) or outer[1], outer[2] or tag == "a" or any(c in self.skip for c in classes), outer[3] or "add" in classes))

    def handle_endtag(self, tag: str) -> None:
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1] and not self.stack[-1][2] and data.strip():
            self.found.append((self.stack[-1][1], " ".join(data.split()), self.stack[-1][3]))


def html_verses(pages: DataFrame, column: str = "html", attribute: str = "data-verse-id", skip: tuple[str, ...] = ("x", "f", "note")) -> DataFrame:
    """(verse_id, n, text, is_filler): pieces of verse text in a page's order; `add` marks words the translator added."""

    def f(html: str) -> Iterator[tuple]:
        reader = _Verses(attribute, skip)
        reader.feed(html)
        for n, (verse, text, added) in enumerate(reader.found):
            yield verse, n, text, added

    return _parsed(pages, column, f, "verse_id string, n int, text string, is_filler boolean")


def letter(n: int) -> str:
    """a to z, then aa, ab and so on."""
    return chr(97 + n) if n < 26 else chr(96 + n // 26) + chr(97 + n % 26)


def html_references(pages: DataFrame, books: Mapping[str, int], column: str = "html") -> DataFrame:
    """(verse_id, letter, word_position, ordinal, book_id, chapter, verse): targets of reference markers,
    lettered within a verse; word_position counts the words before the marker."""
    link = re.compile(r"([1-3]?[A-Z]{2,3})[./](\d+)[./](\d+)")
    piece = re.compile(r'<span[^>]*data-verse-id="([^"]+)"[^>]*class="([^"]*)"[^>]*>(.*?)</span>', re.S)

    def f(html: str) -> Iterator[tuple]:
        words: dict[str, int] = {}
        letters: dict[str, int] = {}
        for verse, classes, body in piece.findall(html):
            if "x" in classes.split():
                hits = [(books[b], int(c), int(v)) for b, c, v in link.findall(body) if b in books]
                for k, hit in enumerate(hits, 1):
                    yield verse, letter(letters.get(verse, 0)), words.get(verse, 0), k, *hit
                letters[verse] = letters.get(verse, 0) + bool(hits)
            else:
                words[verse] = words.get(verse, 0) + len(re.sub(r"<[^>]*>", " ", body).split())

    return _parsed(pages, column, f, "verse_id string, letter string, word_position int, ordinal int, book_id int, chapter int, verse int")


def verse_words(verses: DataFrame, text: str = "text") -> DataFrame:
    """Word tokens of verse texts: split at white space, punctuation at the edges stripped, empty ones dropped;
    word_position from 1, offsets of the raw token, and the form without marks in lower case."""
    keys = [c for c in verses.columns if c != text]
    raw = verses.select(*keys, F.posexplode(F.split(text, r"(?<=\s)(?=\S)")).alias("p", "chunk"))
    before = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    raw = raw.withColumn("start", F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)).cast("int")).withColumn("token", F.regexp_extract("chunk", r"\S+", 0))
    edge = r"^[^\p{L}\p{N}\p{M}_֐-׿]+|[^\p{L}\p{N}\p{M}_֐-׿]+$"
    raw = raw.withColumn("word_text", F.regexp_replace("token", edge, "")).where("word_text <> ''")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    lead = F.length(F.regexp_extract("chunk", r"^\s*", 0))
    out = raw.select(*keys, place.alias("word_position"), "word_text", (F.col("start") + lead).alias("char_start"), (F.col("start") + lead + F.length("token")).alias("char_end"))
    return out.withColumn("word_normalised", forms.udf_unaccented()(F.lower("word_text")))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header-named CSV; the empty string is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
