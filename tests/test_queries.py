"""Every registered query of the core runs; those with a SQL twin equal it."""

import glob
import os

import duckdb
import pytest

from pairlight.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert rows
    if name in catalog.ORACLES:
        got = sql.execute(catalog.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in got.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
