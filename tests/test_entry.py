"""Driver contract and the SQL oracle on the smallest table set."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, _rows  # noqa: E402

from churnlens.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
#: The model fits need more rows than the smallest tables have.
LARGER, FITS = "/root/testdata/sf0.01", {
    "logit_next_period", "logit_significant", "test_summary", "segment_age_regression"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "rfm_segment" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    def connect(sf):
        con = duckdb.connect()
        for t in TABLES:
            p = f"{sf}/{t}.parquet"
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        return con
    return connect


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sf = LARGER if name in FITS else SF
    df = E.queries()[name](spark, sf)
    cur = duck(sf).execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_query_without_oracle_gives_a_result(spark, name):
    rows = E.queries()[name](spark, SF).collect()
    assert rows
    for column in rows[0].__fields__:
        assert name not in catalog.queries() or any(r[column] is not None for r in rows), column
