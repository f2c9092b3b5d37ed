"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from paperloom.plans import files, records  # noqa: F401  (these add to the catalogue)
from paperloom.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
