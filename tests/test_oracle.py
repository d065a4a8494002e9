"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from callgrain.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-5, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    names = sorted(found.columns)
    mine = [tuple(r[c] for c in names) for r in found.collect()]
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == names
    theirs = rel.select(", ".join(f'"{c}"' for c in names)).fetchall()
    key = lambda r: tuple((v is None, round(v, 3) if isinstance(v, float) else v) for v in r)
    mine, theirs = sorted(mine, key=lambda r: repr(key(r))), sorted(theirs, key=lambda r: repr(key(r)))
    assert len(mine) == len(theirs)
    assert all(same(x, y) for p, q in zip(mine, theirs, strict=True) for x, y in zip(p, q, strict=True))
