"""Every query of the engine against its SQL in DuckDB, on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    order = lambda r: [(x is not None, f"{x:.5g}" if isinstance(x, float) else str(x)) for x in r]
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_return_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.limit(5).collect() is not None
