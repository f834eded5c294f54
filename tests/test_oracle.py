"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from marketflow.plans.queries import ORACLE
from marketflow.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SQL = ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    from tools.check_types import SPARK_TO_DUCK
    rel = con.sql(SQL[name])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema:
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == dtypes[f.name], (f.name, f.dataType, dtypes[f.name])
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "sharpe_ratio" in df.columns
