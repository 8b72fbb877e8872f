"""Every training-data query that SQL can express against its SQL."""

import duckdb
import pytest

from tesserae.llm import queries as Q


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = Q.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    rows = lambda every, at: sorted(repr([r[at(c)] for c in sorted(names)]) for r in every)
    assert rows(df.collect(), lambda c: c) == rows(found.fetchall(), names.index)
