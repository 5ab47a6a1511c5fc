"""Driver contract and a DuckDB cross-check on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_mod

from .conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert {"product_code", "summary", "key_points"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert len(entry_mod.queries()) >= 90


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_matches_oracle_small(spark, duck, name):
    con = duck
    sdf = entry_mod.queries()[name](spark, SF001)
    res = con.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == sorted(sdf.columns)
    order = sorted(ocols)
    srows = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    orows = sorted((tuple(_norm(dict(zip(ocols, r))[c]) for c in order) for r in res.fetchall()),
                   key=repr)
    assert srows == orows
