"""Every query of the grounded-dialogue operators against its SQL, in DuckDB."""

import duckdb
import pytest

from hearthlore.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, order):
    value = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(oracle.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = plain([tuple(r) for r in df.collect()], [df.columns.index(c) for c in cols])
    assert got == plain(want.fetchall(), [want.columns.index(c) for c in cols])


def test_every_query_has_sql():
    assert queries.queries().keys() == oracle.oracle_sql().keys()
