"""Every registered query against its SQL, and that all queries return rows with stable schemas."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spectraloom.plans import registry

SF = "/root/testdata/sf0.001"


def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    same = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(same(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db().sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    mine, theirs = plain(got.select(*columns).collect()), plain(want)
    assert len(mine) == len(theirs) and len(mine) > 0
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=2e-6) if all(isinstance(v, (int, float)) for v in a) else a == b, (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_return_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
