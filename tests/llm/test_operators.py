import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from wordloom.llm import base, chaining, decontam, induced, kernel, licenses, lines, linking, minhash, packing, quality, registry, sharding, suffix, tokens

from .conftest import prose

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


class Union:
    def __init__(self, items):
        self.p = {i: i for i in items}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def linked(sets, percent):
    """Components by exact similarity, through an inverted index."""
    u, index = Union(sets), defaultdict(list)
    for i, s in sorted(sets.items()):
        both = Counter(j for x in s for j in index[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for x in s:
            index[x].append(i)
    return {i: u.find(i) for i in sets}


def test_kernel_words_and_hashes():
    texts = ["a b", "", " a\x0bb\x0c", "é a"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    s, e, rows = kernel.words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert rows.tolist() == [0, 0, 2, 2, 3, 3]
    h = kernel.word_hashes(np.frombuffer(b"".join(raw), np.uint8), s, e)
    assert h[0] == h[2] == h[5] and h[1] == h[3] and h[0] != h[1] != h[4]


def test_character_shingles_and_sets_of_them():
    for text in ("", "a", "ab cd", "één ël", "  aé b  ", "abcdefgh", "the quick brown fox\njumps", "αβγδεζηθικλ mn"):
        raw = np.frombuffer(text.encode(), np.uint8)
        begin, end = kernel.trimmed(raw, np.array([0, len(raw)]))
        x, n = kernel.char_shingles(raw, begin, end, 8)
        own = text.strip()
        wanted = [own[i : i + 8] for i in range(max(len(own) - 7, min(len(own), 1)))]
        plain = [kernel.Rolling(kernel.byte_values(np.frombuffer(w.encode(), np.uint8))).ranges(np.array([0]), np.array([len(w.encode())]))[0] for w in wanted]
        assert n.tolist() == [len(wanted)] and x.tolist() == plain
    for size in (0, 1, 2, 300):
        x = np.random.default_rng(size).integers(0, 100, size).astype(np.uint64)
        assert kernel.distinct(x).tolist() == sorted(set(x.tolist()))


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in base.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}


# 1 --- chaining


def test_chains_match_quadratic_programme():
    rng = random.Random(5)
    for _ in range(400):
        points = sorted({(rng.randrange(60), rng.randrange(60)): rng.randrange(1, 9) for _ in range(rng.randrange(1, 20))}.items())
        x, y, n = ([f(p) for p in points] for f in (lambda p: p[0][0], lambda p: p[0][1], lambda p: p[1]))
        best = []
        for i in range(len(x)):
            links = [best[j] - chaining.GAP * (x[i] - x[j] - n[j] + y[i] - y[j] - n[j]) for j in range(i) if x[j] + n[j] <= x[i] and y[j] + n[j] <= y[i]]
            best.append(n[i] + chaining.SEED - 1 + max([0.0, *links]))
        got = chaining.chains(x, y, n)
        assert abs(got[0][0] - max(best)) < 1e-9
        assert sorted(i for _, path in got for i in path) == list(range(len(x)))


def test_passages(spark, odd, none):
    shared = prose(50, 70)
    torn = shared.split()
    torn[20] = "x"
    rows = [(1, prose(51, 90) + " " + shared + " " + prose(52, 40)), (2, prose(53, 30) + " " + shared), (3, " ".join(torn) + " " + prose(54, 60)), (4, prose(55, 200))]
    got = {(r["doc_id"], r["source_doc_id"]): r for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k[0] for k in got} == {2, 3}
    r = got[2, 1]
    assert (r["start"], r["end"], r["source_start"], r["matched"]) == (30, 100, 90, 70)
    assert next(v for k, v in got.items() if k[0] == 3)["matched"] == 69
    assert {(r["doc_id"], r["source_doc_id"]) for r in chaining.passages(odd).collect()} >= {(2, 1)}
    assert chaining.passages(none).count() == 0


def test_passages_with_scattered_edits(spark):
    rng, rows, n = random.Random(11), [], 40
    for k in range(n):
        w = prose(1000 + k, 60).split()
        edited = [f"ander{k}.{i}" if i in gone else v for gone in [set(rng.sample(range(60), 7))] for i, v in enumerate(w)]
        rows += [(k, " ".join(w)), (n + k, prose(2000 + k, 30) + " " + " ".join(edited) + " " + prose(3000 + k, 30))]
    got = {(r["doc_id"], r["source_doc_id"]) for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((n + k, k) in got for k in range(n)) >= 0.95 * n


def test_passage_whose_parts_stand_elsewhere(spark):
    w = prose(60, 60).split()
    parts = [" ".join(w[k : k + 20]) for k in (0, 16, 32, 44)]
    others = lambda at: [(at + k, f"{prose(100 * at + k, 30)} {part} {prose(100 * at + 50 + k, 30)}") for k, part in enumerate(parts)]
    rows = [*others(1), (10, f"{prose(61, 50)} {' '.join(w)} {prose(62, 50)}"), *others(20), (30, f"{prose(63, 70)} {' '.join(w)} {prose(64, 20)}")]
    got = [r for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 30]
    assert [(r["source_doc_id"], r["start"], r["end"], r["matched"]) for r in got] == [(10, 70, 130, 60)]


def test_passages_with_a_long_gap(spark):
    one, two, alone = prose(70, 60), prose(71, 60), prose(72, 120)
    rows = [(1, f"{one} {prose(73, 100)} {two}"), (2, f"{one} {prose(74, 100)} {two}"), (3, alone), (4, f"{alone[: alone.index(alone.split()[60])]}{prose(75, 100)} {' '.join(alone.split()[60:])}")]
    got = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = lambda v: round(v / 20) * 20  # noqa: E731 a word of the gap may match by chance
    assert sorted((r["doc_id"], r["source_doc_id"], near(r["start"]), near(r["end"])) for r in got) == [(2, 1, 0, 60), (2, 1, 160, 220), (4, 3, 0, 60), (4, 3, 160, 220)]
    assert all(r["matched"] >= 60 for r in got)


def test_split_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        a = [str(k).encode() for k in range(160)]
        b = [w if rng.random() > rate else b"x" for w, rate in zip(a, [rng.choice((0, 0.1, 0.5, 1)) for _ in range(8) for _ in range(20)], strict=True)]
        path = [(k, k, 5) for k in range(0, 155) if a[k : k + 5] == b[k : k + 5]]
        if not path:
            continue
        same = np.concatenate(([0], np.cumsum([v == w for v, w in zip(a, b, strict=True)])))
        got = chaining.split(chaining.aligned(a, b, 0, 0, path))
        assert all(same[j] - same[i] == m >= 40 and 100 * m >= 80 * (j - i) and (i, j) == (p, q) for i, j, p, q, m in got)
        lo, hi = path[0][0], path[-1][0] + 5
        best = max((int(same[j] - same[i]) for i in range(lo, hi) for j in range(i + 40, hi + 1) if 100 * (same[j] - same[i]) >= 80 * (j - i)), default=0)
        assert (got[0][4] if got else 0) >= (best if best >= 40 else 0)


def test_passage_whose_seeds_all_stand_elsewhere(spark):
    w = prose(80, 100).split()
    each = lambda at: [(at + k, " ".join(w[k : k + 5])) for k in range(96)]
    edited = [f"x{i}" if i % 14 == 7 else v for i, v in enumerate(w)]
    rows = [*each(0), (1000, " ".join(w)), *each(2000), (3000, " ".join(w)), *each(4000), (5000, " ".join(edited))]
    got = {(r["doc_id"], r["start"], r["end"]): r["matched"] for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3000, 0, 100): 100, (5000, 0, 100): 93}


def test_passage_of_common_seeds(spark):
    """Each part of the passage stands in more documents than a seed is matched with; long runs decide."""
    w = prose(81, 60).split()
    noise = [(at + 40 * g + k, f"{prose(9000 + at + 40 * g + k, 12)} {' '.join(w[15 * g : 15 * g + 15])}") for at in (0, 2000) for g in range(4) for k in range(30)]
    edited = [f"x{i}" if i in (14, 29, 44) else v for i, v in enumerate(w)]
    rows = [*noise, (1000, f"{prose(82, 30)} {' '.join(w)} {prose(83, 30)}"), (5000, f"{prose(84, 20)} {' '.join(edited)} {prose(85, 20)}"), (5001, " ".join(w))]
    got = {r["doc_id"]: r for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {5000, 5001} and got[5001]["matched"] == 60


def test_edited_passage_of_common_seeds(spark):
    """No 40 equal words, and whatever two seeds of the passage say stands in many documents before and between."""
    w = prose(86, 60).split()
    noise = [(at + 100 * g + k, f"{prose(20000 + at + 100 * g + k, 12)} {' '.join(w[max(12 * g, 0) : 12 * g + 24])} {prose(30000 + at + 100 * g + k, 12)}") for at in (100, 2100) for g in range(-1, 5) for k in range(30)]
    edited = [f"x{i}" if i in (11, 23, 35, 47) else v for i, v in enumerate(w)]
    rows = [*noise, (1000, f"{prose(87, 30)} {' '.join(w)} {prose(88, 30)}"), (5000, f"{prose(89, 20)} {' '.join(edited)} {prose(90, 20)}")]
    got = [r for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()]
    assert [(r["doc_id"], r["source_doc_id"], r["start"], r["end"], r["matched"]) for r in got] == [(5000, 1000, 20, 80, 56)]


def test_common_seeds_are_settled_where_they_are_read():
    r = np.zeros(5000, chaining._SEED)
    r["hash"], r["d"], r["later"], r["run"] = 7, np.arange(5000), 3, np.where(np.arange(5000) % 2, 5, 0)
    stay, matches = chaining._settled_here(r)
    assert len(stay) <= 2 * chaining.MATES + 1 and set(matches["d"]) | set(stay["d"]) == set(range(5000)) and (matches["s"] < matches["d"]).all()


def test_passages_against_all_pairs(spark):
    """Every passage that chaining finds in any pair of documents is found for its document, with some source."""
    docs = [(i, words(t)) for i, t in documents(spark)]
    index, cover = defaultdict(list), defaultdict(set)
    for r in registry.QUERIES["op1_collinear_chains"](spark, SF).collect():
        cover[r["doc_id"]] |= set(range(r["start"], r["end"]))
    text, total, found = dict(docs), 0, 0
    for d, w in docs:
        by = defaultdict(list)
        for p in range(len(w) - 4):
            for s, q in index[tuple(w[p : p + 5])]:
                by[s].append((p, q))
        for s, hits in by.items():
            m = np.zeros(len(hits), chaining._MATCH)
            m["pos"], m["spos"] = np.array(hits).T
            m = chaining.anchored(m)
            x, y, n = (m[c].tolist() for c in "xyn")
            for _, path in chaining.chains(x, y, n):
                for piece in chaining._pieces(x, y, n, path):
                    a, b = ([v.encode() for v in z] for z in (w, text[s]))
                    at = chaining.aligned(a, b, 0, 0, [(x[i], y[i], n[i] + 4) for i in piece])
                    for i, j, *_ in chaining.split(at):
                        total += 1
                        found += len(cover[d] & set(range(i, j))) >= 0.8 * (j - i)
        for p in range(len(w) - 4):
            index[tuple(w[p : p + 5])].append((d, p))
    assert total > 20 and found >= 0.98 * total


def test_passages_cover_repeats(spark):
    docs = documents(spark)
    cover = defaultdict(list)
    for r in registry.QUERIES["op1_collinear_chains"](spark, SF).collect():
        cover[r["doc_id"]].append((r["start"], r["end"]))
    first = {}
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) != i:
                assert all(any(a <= q < b for a, b in cover[i]) for q in range(p, p + 50))


# 2, 8 --- packing


def check_packed(rows, ids, capacity):
    per, order = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        per[r["doc_id"]].append((r["start"], r["length"]))
        order[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, pieces in per.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert sorted(order) == list(range(len(order)))
    for pieces in order.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return 1 - sum(r["length"] for r in rows) / (len(order) * capacity)


@pytest.fixture(scope="module")
def token_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    docs = documents(spark)
    return {i: e.ids + [2] for (i, _), e in zip(docs, t.encode_batch([x for _, x in docs], add_special_tokens=False), strict=True)}


@pytest.mark.parametrize("name", ["op2_min_slack_packing", "op8_best_fit_matrices"])
def test_packing(spark, token_ids, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(token_ids)
    assert check_packed(rows, token_ids, tokens.CAPACITY) < 0.05


def test_fill_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 40)
        sums = {0}
        for n, c in counts.items():
            sums = {s + q * n for s in sums for q in range(c + 1)}
        got = packing.fill(room, counts)
        assert all(q <= counts[n] for n, q in got.items())
        assert sum(n * q for n, q in got.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_piece_once():
    rng = random.Random(7)
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 65), 30)}
    seen, used = Counter(), Counter()
    for n, first, per, times, sequence, _ in packing.plan(histogram, 64).tolist():
        assert seen[n] == first
        seen[n] += per * times
        for t in range(times):
            used[sequence + t] += n * per
    assert seen == histogram and max(used.values()) <= 64


def test_best_fit_is_tightest():
    rng = random.Random(8)
    fit, open_ = tokens.BestFit(100), {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        rooms = [r for r in open_.values() if r >= n]
        number, offset = fit.put(n)
        assert 100 - offset == (min(rooms) if rooms else 100)
        open_[number] = 100 - offset - n


def test_packed_matrix_round_trip(spark, odd, none, tmp_path):
    tokens.write_packed(odd, str(tmp_path / "p"), capacity=512)
    table = spark.read.parquet(str(tmp_path / "p"))
    back = defaultdict(dict)
    for r in table.collect():
        ids = np.frombuffer(r["input_ids"], f"<u{r['id_bytes']}")
        assert len(ids) == 512 and not ids[r["n_tokens"] :].any()
        assert r["position_resets"] == [x for x in r["cu_seqlens"] if x < 512]
        positions = tokens.position_ids(r["position_resets"], 512)
        assert all((positions[a:b] == np.arange(b - a)).all() for a, b in zip(r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True))
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["doc_starts"], strict=True)):
            back[doc][start] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    whole = {d: sum((p for _, p in sorted(x.items())), []) for d, x in back.items()}
    assert whole[4] == whole[5] == whole[6] == [2] and whole[1] == whole[2] and len(whole[8]) > 512 and None in whole
    tokens.write_packed(none, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 0


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == 11
    assert packing.pack(none).count() == 0


def test_chunk_ids_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    from tokenizers import Tokenizer

    plain, cached = Tokenizer.from_file(tokens.vocabulary()), tokens.ChunkIds(tokens.vocabulary())
    for text in (prose(60, 50), "Één <|endoftext|> it's 12 ", "a <|endoftext|> b", "x<|startoftext|>y <|endoftext|><|endoftext|> <|endoftext |>", "a\u00a0b \u2003 e\u0301 \u0301x", prose(61, 50), ""):
        raw = text.encode()
        want = plain.encode(text, add_special_tokens=False).ids + [2]
        for of in (cached.encode, cached._whole):
            got, n = of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert got.tolist() == want and n.tolist() == [len(want)]


def test_few_words_are_kept_as_objects(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    own = tokens.ChunkIds(tokens.vocabulary())
    for k in range(8):
        text = prose(700 + k, 40).encode()
        ids, _ = own.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == [*own.tokenizer.encode(text.decode(), add_special_tokens=False).ids, tokens.END]
    assert len(own.words) < 50 + 3 * 40 < len(own.keys)


def test_plain_chunks_get_the_ids_of_the_tokenizer_without_its_steps(monkeypatch):
    import random

    cached = tokens.ChunkIds(tokens.vocabulary())
    rng, plain = random.Random(8), [chr(x) for x in range(0x21, 0x7F)] + [chr(x) for x in range(0xC0, 0x100)]
    texts = ["".join(rng.choices(plain, k=rng.randint(1, 9))) for _ in range(3000)] + plain + ["Straße,", "ÀÉß.", "it's", "e\u0301", "x<|endoftext|>y", "½²ªµ", "\u0130ſ"]
    want = [e.ids for e in cached.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    calls = []
    whole = cached.tokenizer.encode_batch_fast
    cached.tokenizer = type("T", (), {"encode_batch_fast": lambda self, x, **k: calls.extend(x) or whole(x, **k)})()
    ids, begin, n = cached._ids(texts)
    assert [ids[a : a + k] for a, k in zip(begin.tolist(), n.tolist(), strict=True)] == want
    assert calls == [x for x in texts if not tokens.PLAIN.fullmatch(x)] and len(calls) < len(texts) / 2


def test_tokenizers_of_other_rules_take_their_whole_way():
    from tokenizers import normalizers

    other = tokens.ChunkIds(tokens.vocabulary())
    assert other.plain
    other.tokenizer.normalizer = normalizers.NFC()
    assert not other._has_rules()


def test_wide_vocabularies_get_wide_ids(monkeypatch):
    assert tokens.id_type(tokens.vocabulary()) == np.dtype("<u2")

    class Wide:
        tokenizer = type("T", (), {"get_vocab": lambda self, with_added_tokens: {"a": 70_000}})()

    monkeypatch.setitem(tokens._ENCODERS, "wide", Wide())
    assert tokens.id_type("wide") == np.dtype("<u4")


# 3 --- quality


def figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


def test_quality_figures(spark, odd, none):
    texts = dict(documents(spark))
    rows = registry.QUERIES["op3_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == figures(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    got = quality.judged(odd).collect()
    assert len(got) == 11 and {r["doc_id"] for r in got if r["kept"]} == {1, 2, 3, None, 7, 8}
    assert quality.judged(none).count() == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES["op3_quality_rules"](spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    right = sum(r["kept"] == (labels[r["doc_id"]] == 1) for r in rows)
    assert right >= 0.97 * len(rows)


def test_verdict_is_not_all_must_pass(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r for r in quality.features(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["n_words"] >= 50 and 2 * r["n_repeat_words"] <= r["n_words"]]
    verdict = {r["doc_id"]: r["kept"] for r in registry.QUERIES["op3_quality_rules"](spark, sf).collect()}
    against = [sum(r["pattern"] // 3**k % 3 == 0 for k in range(len(quality.RULES))) for r in rows]
    assert sum(n > 0 and verdict[r["doc_id"]] for r, n in zip(rows, against, strict=True)) >= 0.005 * len(rows)
    assert all(verdict[r["doc_id"]] for r, n in zip(rows, against, strict=True) if n == 0)
    model = {r["rule"]: r for r in quality.accuracies(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert model["symbols"]["accuracy_on_bad"] > 0.9 and model["repeated_lines"]["accuracy_on_bad"] < 0.3 and min(r["accuracy_on_good"] for r in model.values()) > 0.9


def simulated(rng, good, bad, share, n):
    truth = rng.random(n) < share
    right = np.where(truth[:, None], rng.random((n, len(good))) < good, rng.random((n, len(good))) < bad)
    votes = np.where(right == truth[:, None], 2, 0)
    votes[rng.random(votes.shape) < 0.1] = 1
    return truth, votes


def test_accuracies_of_simulated_votes_are_recovered():
    rng = np.random.default_rng(14)
    good, bad = rng.uniform(0.85, 0.99, len(quality.RULES)), rng.uniform(0.3, 0.95, len(quality.RULES))
    truth, votes = simulated(rng, good, bad, 0.85, 20_000)
    patterns, inverse, counts = np.unique(votes @ 3 ** np.arange(len(quality.RULES)), return_inverse=True, return_counts=True)
    post, model = quality.fit(patterns, counts)
    assert abs(model["on_good"] - good).max() < 0.02 and abs(model["on_bad"] - bad).max() < 0.05 and abs(model["share"] - 0.85) < 0.02
    assert ((post[inverse] >= 0.5) == truth).mean() > 0.97


def test_fit_against_row_by_row_em():
    rng = np.random.default_rng(15)
    _, votes = simulated(rng, np.full(len(quality.RULES), 0.9), np.full(len(quality.RULES), 0.6), 0.8, 300)
    patterns, inverse, counts = np.unique(votes @ 3 ** np.arange(len(quality.RULES)), return_inverse=True, return_counts=True)
    post = [1 - sum(v == 0 for v in row) / max(sum(v != 1 for v in row), 1) for row in votes]
    for _ in range(500):
        sens, spec = [], []
        for r in range(len(quality.RULES)):
            on = [(p, row[r]) for p, row in zip(post, votes, strict=True) if row[r] != 1]
            spec.append((sum(p for p, v in on if v == 2) + quality.ON_GOOD[0]) / (sum(p for p, _ in on) + sum(quality.ON_GOOD)))
            sens.append((sum(1 - p for p, v in on if v == 0) + quality.ON_BAD[0]) / (sum(1 - p for p, _ in on) + sum(quality.ON_BAD)))
        share = (sum(post) + quality.CLASSES[0]) / (len(post) + sum(quality.CLASSES))
        new = []
        for row in votes:
            a, b = share, 1 - share
            for r, v in enumerate(row):
                if v != 1:
                    a, b = a * (spec[r] if v == 2 else 1 - spec[r]), b * (sens[r] if v == 0 else 1 - sens[r])
            new.append(a / (a + b))
        done = max(abs(x - y) for x, y in zip(new, post, strict=True)) < 1e-9
        post = new
        if done:
            break
    got, model = quality.fit(patterns, counts)
    assert np.abs(got[inverse] - np.array(post)).max() < 1e-6 and np.abs(model["on_bad"] - sens).max() < 1e-6


# 4 --- near-duplicate documents


def test_minhash_against_exact_components(spark, odd, none):
    docs = documents(spark)
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, min(len(w), 1)))} for i, w in ((i, words(t)) for i, t in docs)}
    want = linked({i: s for i, s in sets.items() if s}, 80)
    for r in registry.QUERIES["op4_minhash_near_dedup"](spark, SF).collect():
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.components(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 9, True)], key=str)
    assert minhash.components(none).count() == 0


def test_links_at_the_threshold(spark):
    rng = random.Random(9)
    rows, sets = [], {}
    for g in range(40):
        w = prose(100 + g, 90).split()
        for copy in range(4):
            own = list(w)
            for _ in range(copy * rng.randrange(1, 3)):
                own[rng.randrange(len(own))] = f"q{rng.random()}"
            rows.append((g * 10 + copy, " ".join(own)))
            sets[g * 10 + copy] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
    want = linked(sets, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_stage(spark):
    a, b = prose(300, 60), prose(301, 60)
    c = f"x {a}"
    run = lambda rows: sorted(map(tuple, minhash.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), "").collect()), key=str)
    assert run([(1, a, 1), (2, a, 2), (2, b, 3)]) == [(1, a, 1), (2, b, 3)]
    assert run([(7, a, 1), (7, a, 1), (8, c, 2)]) == [(7, a, 1)]
    assert run([(None, a, 1), (None, a, 1), (3, None, 2), (3, None, 2)]) == sorted([(3, None, 2), (3, None, 2), (None, a, 1)], key=str)
    assert run([(None, a, 1), (4, c, 2)]) == [(4, c, 2)]


def test_near_dedup_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for i, w in ((i, words(t)) for i, t in documents(spark))}
    want = linked({i: s for i, s in sets.items() if s}, 80)
    assert {r["doc_id"] for r in minhash.near_dedup(spark, docs, SF).collect()} == {i for i in sets if want.get(i, i) == i}


@pytest.fixture
def broadcasting(spark):
    """A session with Spark's own limit of broadcasts, whatever ran before."""
    name, own = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "10m")
    yield spark
    spark.conf.set(name, own)


def test_ids_that_compress_well_are_not_broadcast(broadcasting):
    spark = broadcasting
    few = base.store(spark.range(0, 1_000_000, 1, 4).withColumnRenamed("id", "doc"), "ids", scanned=True)
    many = base.store(spark.range(0, 3_000_000, 1, 4).withColumnRenamed("id", "doc"), "more-ids", scanned=True)
    joined = many.join(few, "doc")
    assert joined.count() == 1_000_000 and "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_stage_called_alone_bounds_broadcasts(broadcasting):
    """As the pipeline's stages are called, one by one, in a session with Spark's own limit."""
    docs = broadcasting.createDataFrame([(1, prose(401, 60)), (2, prose(401, 60)), (3, prose(402, 60))], "doc_id long, text string")
    out = minhash.near_dedup(broadcasting, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert broadcasting._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() <= 256 << 10


def test_texts_to_verify_are_not_broadcast(broadcasting):
    """Near copies of a text are a small file, but as large as they are for the driver."""
    spark = broadcasting
    texts = base.store(spark.createDataFrame([(k, f"{prose(400, 300)} {k}") for k in range(400)], "doc long, text string"), "copies")
    pairs = base.store(spark.range(1, 400).selectExpr("id - 1 as a", "id as b"), "pairs")
    out = linking.verified(pairs, texts, linking.word_shingles(5), 80)
    assert out.count() == 399 and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


# 5 --- substrings


def test_suffix_array():
    rng = np.random.default_rng(10)
    for _ in range(150):
        strings = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 30)).astype(np.uint8) for _ in range(rng.integers(1, 5))]
        symbols = np.concatenate([np.append(s.astype(np.int16) + 1, 0) for s in strings])
        got = induced.suffix_array(symbols, limit=int(rng.integers(1, 50)))
        ends = np.flatnonzero(symbols == 0)
        suffix_of = lambda i: tuple(symbols[i : ends[np.searchsorted(ends, i)]])  # noqa: B023, E731
        assert sorted(got.tolist()) == np.flatnonzero(symbols).tolist()
        order = [suffix_of(i) for i in got]
        assert order == sorted(order)


def cut_exactly(docs):
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark, odd, none):
    want = cut_exactly(documents(spark))
    for r in registry.QUERIES["op5_induced_suffixes"](spark, SF).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    got = {(r["doc_id"], len(r["spans"]), len(r["kept"])) for r in suffix.cut(odd).collect()}
    assert {(2, 1, 0), (4, 0, 0), (5, 0, 0), (6, 0, 4), (9, 0, 4)} <= got
    assert suffix.cut(none).count() == 0


@pytest.mark.parametrize("unit", ["a", "ab", "abcdefghij", "aé"])
def test_substring_dedup_of_periodic_texts(spark, unit):
    docs = [(1, unit * 70), (2, unit * 90 + "x"), (3, "y" + unit * 40), (4, "z" * 99)]
    want = cut_exactly(docs)
    got = suffix.cut(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got} == want


# 6 --- decontamination


def test_decontamination(spark, odd, none):
    item = prose(70, 40)
    torn = item.split()
    torn[39] = "x"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "..."), (None, prose(71, 30)), (4, "two words")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, prose(72, 50) + " " + item.upper() + "! " + prose(73, 9)), (2, " ".join(torn)), (3, " ".join(item.split()[:20])), (4, prose(71, 30)), (5, "Two words."), (6, None), (1, prose(72, 50) + " " + item.upper() + "! " + prose(73, 9))],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 3)) for r in decontam.leaks(docs, benchmark).collect()}
    assert got == {(1, 1): (50, 1.0), (2, 1): (0, round(35 / 37, 3)), (4, None): (0, 1.0), (5, 4): (0, 1.0)}
    assert decontam.leaks(odd, benchmark).count() == 0 and decontam.leaks(none, benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0


def test_windows_that_tie_and_shingles_that_repeat(spark):
    item = prose(74, 20)
    benchmark = spark.createDataFrame([(1, item), (2, "na " * 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{item} {prose(75, 9)} {item}"), (2, "na " * 40), (3, "na " * 9), (4, "na " * 11)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 3)) for r in decontam.leaks(docs, benchmark).collect()}
    assert got == {(1, 1): (0, 20, 1.0), (2, 2): (0, 12, 1.0), (4, 2): (0, 11, 0.875)}


def test_fingerprint_blocks_cover_all_bits(spark):
    df = spark.range(200).selectExpr("array(xxhash64(id), xxhash64(id, 1)) as p").select("p", decontam.blocks("p").alias("b"))
    longs = decontam.BITS // 64
    cut = [(decontam.RADIUS + 1) * (k + 1) // longs - (decontam.RADIUS + 1) * k // longs for k in range(longs)]
    place = [64 * k + 64 * i // n for k, n in enumerate(cut) for i in range(n)]
    assert len(place) == decontam.RADIUS + 1
    for r in df.collect():
        assert sum(x["value"] << place[x["block"]] for x in r["b"]) == sum((v % 2**64) << 64 * k for k, v in enumerate(r["p"]))


# 7 --- sharding


def test_jump_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(11).integers(0, 2**63, 20000).astype(np.uint64)
    before = sharding.jump(keys, 1)
    assert not before.any()
    for n in range(2, 30):
        after = sharding.jump(keys, n)
        moved = after != before
        assert (after[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        before = after


def test_sharding(spark, odd, none, tmp_path):
    rows = registry.QUERIES["op7_jump_sharding"](spark, SF).collect()
    texts = dict(documents(spark))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] in (r["shard"], 40)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(odd, 3).count() == 11 and sharding.assign(none, 3).count() == 0
    sharding.write_shards(odd, str(tmp_path / "s"), 3, "doc_id")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 11


# 9 --- lines


def test_fuzzy_lines(spark, odd, none):
    sets = {}
    for i, text in documents(spark):
        for n, line in enumerate(text.split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
            if line:
                sets[i, n] = frozenset(line[k : k + lines.CHARS] for k in range(max(len(line) - lines.CHARS, 0) + 1))
    want = linked(sets, lines.PERCENT)
    got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"]) for r in registry.QUERIES["op9_fuzzy_lines"](spark, SF).collect()}
    assert set(got) == set(sets)
    assert sum(got[k] != want[k] for k in sets) <= 0.002 * len(sets)
    kept = {(r["doc_id"], r["text"], r["component"]) for r in lines.dedup(odd).collect()}
    assert {k[0] for k in kept} == {1, 4, 5, 6, None, 7, 8, 9} and (4, None, 9) in kept
    assert lines.dedup(none).count() == 0 and lines.dedup(odd).columns == odd.columns


def test_first_line_stays(spark):
    line = prose(80, 12)
    rows = [(2, f"{line}\nother things are said here\n{line}"), (1, f"nothing much to see in this one\n{line.upper()}  ")]
    got = dict(map(tuple, lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {1: rows[1][1], 2: "other things are said here"}


def test_short_lines_go_too(spark):
    rows = [(1, "Menu\n\na b\nnext page >"), (2, "menu \nNext page >\nonly here\n\nx"), (3, " Menu")]
    got = dict(map(tuple, lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {1: rows[0][1], 2: "only here\n\nx"}


# 10 --- licences


def test_licenses(spark, odd, none):
    known = licenses.known(spark)
    wrapped = "\n".join(licenses.MIT.replace("sublicense", "sub-licence").split(". "))
    docs = spark.createDataFrame(
        [(1, "Copyright (c) 2020 Me\n\n" + licenses.MIT.upper()), (2, "prose\nReleased under the MIT Licence!\n"), (3, None), (4, licenses.MIT + " and more"), (5, wrapped)], "doc_id long, text string"
    )
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(docs, known).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: ("MIT", "")}
    assert licenses.scan(odd, known).count() == 11 and licenses.scan(none, known).count() == 0
    assert licenses.scan(docs, known.limit(0)).where("license is not null or notices <> ''").count() == 0


def test_full_licence_texts(spark):
    known, rows = licenses.known(spark), []
    for n, (name, text) in enumerate(licenses.KNOWN):
        if len(text) > 1000:
            rows += [(2 * n, f"Copyright 2021 Someone\n\n{text.upper()}", name), (2 * n + 1, "\n".join(f"  # {x}" for x in text.split("\n")), name)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string"), known).collect()}
    assert len(rows) > 30 and got == {d: name for d, _, name in rows}
    inside = spark.createDataFrame([(1, "Some words.\n\n" + licenses.KNOWN[0][1][:200] + "\n\nReleased under\nthe MIT License.\n\nMore.")], "doc_id long, text string")
    assert [r["notices"] for r in licenses.scan(inside, known).collect()] == ["MIT"]


# pipeline


def test_stages_keep_the_columns(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
                docs = base.store(out, name, scanned=True)
            else:
                assert out.count() >= 0


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    kept = {r["doc_id"] for r in rows}
    good = {r["doc_id"] for r in registry.QUERIES["op3_quality_rules"](spark, SF).where("kept").collect()}
    leaked = {r["doc_id"] for r in registry.QUERIES["op6_simhash_decontamination"](spark, SF).collect()}
    assert kept <= good and not kept & leaked


def test_clashing_columns(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "clash"), 3, "doc_id")
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert {"shard", "shard_"} <= set(back.columns) and {r["shard"] for r in back.collect()} == {"own"}
    for out in (lines.dedup(odd), minhash.near_dedup(spark, odd, SF), decontam.decontaminate(spark, odd, SF), quality.quality_filter(spark, odd, SF)):
        assert out.columns == odd.columns and {r["_gone"] for r in out.collect()} <= {"g"}


def test_very_long_texts(spark):
    w = prose(400, 150_000)
    docs = spark.createDataFrame([(1, w), (2, w.replace("zee1 ", "zee2 ")), (3, "\n".join(w.split())), (4, prose(401, 50))], "doc_id long, text string")
    assert len(w) > 1_000_000
    assert {r["doc_id"] for r in chaining.passages(docs).collect()} == {2, 3}
    assert sum(r["length"] for r in packing.pack(docs).collect()) == sum(r["length"] for r in tokens.segments(_packed(spark, docs)).collect())
    assert quality.judged(docs).count() == 4 and {r["component_id"] for r in minhash.components(docs).collect()} == {1, 4}
    assert {r["doc_id"] for r in suffix.cut(docs).collect() if r["spans"]} == {2}
    assert decontam.leaks(docs, spark.createDataFrame([(1, w[:2000]), (2, prose(402, 30))], "item_id long, text string")).count() == 3
    assert sharding.assign(docs, 3).count() == 4 and lines.dedup(docs).count() == 3 and licenses.scan(docs, licenses.known(spark)).count() == 4


def _packed(spark, docs):
    path = base.new_path(spark, "long")
    tokens.write_packed(docs, path)
    return spark.read.parquet(path)


def test_signatures_agree_as_sets_do():
    a, b = set(range(1000)), set(range(100, 1100))
    x = kernel.mix(np.array([*sorted(a), *sorted(b)], np.uint64))
    low = kernel.minhash(x, np.array([1000, 1000]), kernel.permutations(512, 1))
    assert abs((low[0] == low[1]).mean() - 900 / 1100) < 0.06
    assert linking.HALF * linking.M * 2 == 84
