"""Every registered query against its DuckDB oracle at sf0.001 (the driver runs sf0.01)."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SMOKE

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([_norm(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SMOKE)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, srows) == _bag(dcols, res.fetchall())


def test_every_key_runs(spark):
    missing = [k for k in entry.queries() if k not in entry.oracle_sql()]
    for k in missing:
        assert entry.queries()[k](spark, SMOKE).count() > 0, k


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) > 3
