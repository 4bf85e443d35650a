"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from brindle import plans


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return c


def cell(x) -> str:
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "None" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_twin(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(cell, r)) for r in df.select(*cols).collect())
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in got.fetchall())
