"""Token ids of whole texts, and fixed-length id matrices packed best-fit-decreasing.

The vocabulary file splits text at white space before anything else, so a text's
ids are those of its white-space separated chunks, one after another; strings of
special tokens are found within chunks, as the tokenizer finds them in a text.  Chunks
repeat far more often than texts do: each worker keeps the ids of the chunks it
has met and hands only new ones to the tokenizer.  A chunk is known by a 64-bit hash;
its length and first eight bytes are compared besides.  A new chunk of plain characters
(PLAIN) is lower-cased and cut into words as the tokenizer's own normalizer and
pre-tokenizer do, and only words that are new go through its model; every other chunk,
and any tokenizer of other rules, takes the tokenizer's whole way.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .base import new_path, parts, table

CAPACITY = 4096
END = 2
TOKEN_CHUNK = 1 << 21
CACHE = 1 << 20
#: Words whose ids a worker keeps as objects, some 300 bytes each: workers wait with them while other stages run.
WORDS = 1 << 15
#: Tokens that are packed together by best fit; bounds a task's memory, whatever its input.
BLOCK_TOKENS = 1 << 22
#: Characters that no normalizer step but lower-casing changes, and that no special token and no contraction of the
#: vocabulary is made of: printable ASCII without ' and <, and the letters of Latin-1.
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_CUT = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The rules for which PLAIN and _CUT hold.
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _heads(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The length and the first eight bytes of each chunk, mixed."""
    first = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(8, np.uint8)), 8)[s].view("<u8").reshape(-1)
    size = np.minimum(e - s, 8)
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    return K.mix((first & mask[size]) + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: The bytes 0x80 to 0xA0 and 0xAD as byte-level vocabularies write them (after 33 others that no plain character has); the rest stand for themselves.
_BYTES = {b: 0x100 + 34 + k for k, b in enumerate([*range(0x80, 0xA1), 0xAD])}


class ChunkIds:
    """Ids of white-space separated chunks, by their hash; `heads` tells apart what a hash may not."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = self._has_rules()
        self.clear()

    def _has_rules(self) -> bool:
        """Whether chunks of plain characters may be cut here: the tokenizer's steps are _RULES, and no added token is plain."""
        own = tuple(json.loads(step.__getstate__()) if step else None for step in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        added = self.tokenizer.get_added_tokens_decoder().values()
        return own == _RULES and not any(PLAIN.fullmatch(x.content) for x in added) and not self.tokenizer.truncation and not self.tokenizer.padding

    def clear(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.keys, self.heads, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, heads: np.ndarray, texts: list[str]) -> None:
        """keys: ascending and new."""
        ids, begin, n = self._ids(texts)
        at, flat = len(self.flat) + begin, np.array(ids, np.uint32)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.heads = np.insert(self.keys, where, keys), np.insert(self.heads, where, heads)
        self.at, self.n = np.insert(self.at, where, at), np.insert(self.n, where, n)
        self.flat = np.concatenate((self.flat, flat))

    def _ids(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The ids of all chunks, where those of each begin, and their number."""
        if len(self.words) > WORDS:  # chunks that are known keep their ids
            self.words = {}
        words, flat, other = self.words, [], []
        begin, end = [0] * len(texts), [0] * len(texts)
        for i, text in enumerate(texts):
            if not self.plain or not PLAIN.fullmatch(text):
                other.append(i)
                continue
            begin[i] = len(flat)
            for word in _CUT.findall(text.lower()):
                ids = words.get(word)
                if ids is None:
                    ids = words[word] = self._word(word)
                flat += ids
            end[i] = len(flat)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
            begin[i] = len(flat)
            flat += e.ids
            end[i] = len(flat)
        start = np.array(begin, np.int64)
        return flat, start, np.array(end, np.int64) - start

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of one word of plain characters: the model reads bytes as characters, a printable one as itself."""
        return tuple([x.id for x in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))])

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode` without chunks."""
        raw = buf.tobytes()
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
        return np.array([x for y in ids for x in [*y, END]], np.uint32), np.array([len(y) + 1 for y in ids], np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, END after each row, and the number per row."""
        s, e, rows = K.words(buf, off)
        heads = _heads(buf, s, e)
        keys, first, inverse = np.unique(K.word_hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            raw = buf.tobytes()
            self._learn(keys[new], heads[first[new]], [raw[s[i] : e[i]].decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        if (self.heads[at] != heads).any():  # two chunks with one hash
            return self._whole(buf, off)
        n, begin = self.n[at], self.at[at]
        per_row = np.bincount(rows, weights=n, minlength=len(off) - 1).astype(np.int64) + 1
        out = np.full(int(per_row.sum()), END, np.uint32)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        if total:
            step = np.arange(total)
            source = np.repeat(begin - (ends - n), n) + step
            out[step + np.repeat(rows, n)] = self.flat[source]
        return out, per_row


_ENCODERS: dict[str, ChunkIds] = {}


def encoded(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each row, END last; a null text has END alone."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkIds(path)
    buf, off = K.buffer_of(column)
    for i, j in K.chunks(off, TOKEN_CHUNK):
        ids, n = _ENCODERS[path].encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        ends = np.cumsum(n)
        for a, b in zip(ends - n, ends, strict=True):
            yield ids[a:b]


@cache
def id_type(path: str) -> np.dtype:
    """The narrowest unsigned little-endian type that holds every id of the vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkIds(path)
    return np.dtype("<u2" if max(_ENCODERS[path].tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")


def position_ids(resets: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The position of each id of a sequence, counted from the last reset at or before it."""
    at = np.arange(capacity)
    return at - np.asarray(resets)[np.searchsorted(resets, at, "right") - 1]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class BestFit:
    """Open bins by remaining room; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def _tightest(self, length: int) -> int:
        """The smallest room >= length of an open bin, or -1."""
        at = length + self.leaves
        if self.tree[at]:
            return length
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of this length."""
        room = self._tightest(length)
        if room < 0:
            room, number = self.capacity, self.count
            self.count += 1
        else:
            number = self.bins[room].pop()
            self._change(room, -1)
        if room > length:
            self.bins[room - length].append(number)
            self._change(room - length, 1)
        return number, self.capacity - room


def _pack(capacity: int, path: str):
    names = ["block", "row", "input_ids", "id_bytes", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_starts", "doc_tokens", "ids_crc32"]

    def finish(pieces: list, block: int) -> pa.RecordBatch:
        """pieces: (doc id, start, ids, tokens of the document)."""
        fit = BestFit(capacity)
        rows: list[list] = []
        for k in sorted(range(len(pieces)), key=lambda k: -len(pieces[k][2])):
            number, offset = fit.put(len(pieces[k][2]))
            if number == len(rows):
                rows.append([])
            rows[number].append((offset, k))
        width = id_type(path)
        matrix = np.zeros((len(rows), capacity), width)
        cu, own = [], []
        for r, placed in enumerate(rows):
            cu.append([x for x, _ in placed])
            own.append([pieces[k] for _, k in placed])
            for offset, k in placed:
                matrix[r, offset : offset + len(pieces[k][2])] = pieces[k][2]
            cu[-1].append(placed[-1][0] + len(pieces[placed[-1][1]][2]))
        longs = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(rows), pa.int64()),
                pa.array(range(len(rows)), pa.int64()),
                pa.array([x.tobytes() for x in matrix], pa.binary()),
                pa.array([width.itemsize] * len(rows), pa.int32()),
                pa.array([x[-1] for x in cu], pa.int32()),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([[x for x in c if x < capacity] for c in cu], pa.list_(pa.int32())),
                longs([[p[0] for p in x] for x in own]),
                longs([[p[1] for p in x] for x in own]),
                longs([[p[3] for p in x] for x in own]),
                longs([[crc(p[2]) for p in x] for x in own]),
            ],
            names,
        )

    @K.tidy
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24  # blocks of a task are numbered on
        held, tokens, block = [], 0, 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for doc, ids in zip(ids_of, encoded(batch.column(1), path), strict=True):
                for at in range(0, len(ids), capacity):
                    held.append((doc, at, ids[at : at + capacity].copy(), len(ids)))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield finish(held, first + block)
                    held, tokens, block = [], 0, block + 1
        if held:
            yield finish(held, first + block)

    schema = "block long, row long, input_ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>, ids_crc32 array<long>"
    return run, schema


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, vocab: str | None = None) -> None:
    """Writes the packed id matrix of docs (doc_id, text) as a table.

    A row is a sequence: input_ids (capacity ids of id_bytes bytes each, two or four as
    the vocabulary needs, zero after the last segment), cu_seqlens (segment k covers
    cu_seqlens[k] up to cu_seqlens[k + 1]; the last entry is the number of ids in use),
    position_resets (where the position counter returns to 0: at each segment, and at the
    padding; `position_ids` expands them), and for each segment its document, its start
    in it, the document's length and the checksum of its ids.

    Documents longer than a sequence, however long, are cut at multiples of capacity,
    losing nothing; a null or empty text is its end id alone; ids, repeat rows, pieces of
    equal length and extra columns need no care; an empty table gives an empty one. Each task packs what it reads in blocks of about BLOCK_TOKENS,
    so nothing is shuffled, and a task that is run again writes the same rows."""
    run, schema = _pack(capacity, vocab or vocabulary())
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema).write.parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment of a packed table, with sequences numbered gaplessly over all blocks."""
    # Blocks are numbered within groups of them, and groups among each other: a row per group meets in one task.
    groups = max(16, parts(packed.sparkSession))
    per_block = packed.groupBy("block").count().withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    within = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    among = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # `groups` rows at most
    base = per_block.groupBy("group").agg(F.sum("count").alias("rows")).select("group", F.coalesce(F.sum("rows").over(among), F.lit(0)).alias("base"))
    shift = per_block.join(F.broadcast(base), "group").select("block", (F.col("base") + F.coalesce(F.sum("count").over(within), F.lit(0))).alias("shift"))
    rows = packed.select("block", "row", "cu_seqlens", F.arrays_zip("doc_ids", "doc_starts", "doc_tokens", "ids_crc32").alias("s"))
    rows = rows.join(shift, "block").select((F.col("row") + F.col("shift")).alias("sequence_id"), "cu_seqlens", F.posexplode("s").alias("k", "s"))
    start, end = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    return rows.select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.doc_starts").alias("start"),
        (end - start).cast("long").alias("length"),
        F.col("s.ids_crc32").alias("ids_crc32"),
        F.col("s.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        start.cast("long").alias("offset"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "packed")
    write_packed(table(spark, sf_dir, "documents"), path)
    return segments(spark.read.parquet(path))

