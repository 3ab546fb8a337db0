"""Every catalog query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from tetrad.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted([tuple(map(plain, r)) for r in got.collect()]) == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()])
    else:
        got.collect()
