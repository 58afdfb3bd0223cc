import pytest

WORDS = "zon maan ster wolk regen wind storm vuur water aarde steen boom blad tak wortel bloem gras veld berg dal rivier zee strand zand golf schip haven stad dorp huis".split()


def prose(seed: int, n: int) -> str:
    """n words that no other seed shares five of in a row."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345 + k) % 2**31
        out.append(f"{WORDS[x % len(WORDS)]}{(x >> 8) % 97}")
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every awkward kind, with extra columns whose names clash with those that operators use."""
    a = prose(1, 120)
    near = a.split()
    near[60] = "anders"
    rows = [
        (1, a, "x", "s", 1, 9),
        (2, a, "x", "s", 1, 9),
        (3, " ".join(near), "x", "s", 1, 9),
        (4, None, "x", "s", None, 9),
        (5, "", None, "s", 0, None),
        (6, " \n\t ", "x", None, 4, 9),
        (None, prose(2, 80), "x", "s", 1, 9),
        (7, prose(3, 80), "x", "s", 1, 9),
        (7, prose(3, 80), "x", "s", 1, 9),
        (8, prose(4, 6000), "x", "s", 1, 9),
        (9, "kort", "x", "s", 1, 9),
    ]
    rows = [(*r, "g", "own", 1, 2, 3, "k", "r") for r in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long, component long, _gone string, shard string, _d int, _k int, pattern int, text_key string, row string"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
