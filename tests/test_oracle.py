"""Differential test: every registered query against its DuckDB restatement (sf0.001)."""

import math
import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from stereoscope.plans import catalog
from stereoscope.sources.tables import TABLES

# the library's own queries; the subpackage's are tested beside it
QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        # exact: same bits in both engines (repr also tells -0.0 from 0.0)
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if isinstance(v, (bool, int)):
        return (3, int(v))
    return (4, str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLE[name])
    dc, dr = _rows([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert set(df.columns) >= {"att_term", "score", "model_bias"}
