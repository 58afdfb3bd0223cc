"""Every query with an oracle gives the oracle's rows on the smallest tables; the rest run."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from wordloom.plans import catalog, load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or str(x) in ("<NA>", "nan", "NaT"):
            return "NULL"
        if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)):
            return repr(round(float(x), 6))
        return str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).columns == ["strongs", "phrase", "n", "total", "rn", "short_def"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = load.shipped(catalog.QUERIES[name])(spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = oracle.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
