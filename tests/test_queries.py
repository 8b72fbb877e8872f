"""Every query of the engine against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tesserae.plans import proxies

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", proxies.QUERIES)
def test_query(spark, sf, db, name):
    df = proxies.QUERIES[name](spark, sf)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in proxies.SQL:
        assert rows
        return
    found = db.execute(proxies.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert rows == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "vec_id", "score", "margin", "verdict"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
