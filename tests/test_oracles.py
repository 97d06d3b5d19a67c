"""Each ledger query against its DuckDB twin over the smallest given tables."""

import math
from pathlib import Path

import duckdb
import pytest

from utxolens import plans

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 9))
    return str(value)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    twin = duck.sql(plans.ORACLE_SQL[name])
    names = list(twin.columns)
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in twin.fetchall())
    assert ours == theirs
