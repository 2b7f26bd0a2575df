"""Every query with SQL gives that SQL's rows; every other one runs."""

import glob
import os

import duckdb
import pytest

from folioflow.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(rows)
        return
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(rows.columns) == sorted(expected.columns)
    for c in rows.columns:  # a nullable integer comes back as a float from one side
        if str(rows[c].dtype).startswith("float") and str(expected[c].dtype).startswith("Int"):
            expected[c] = expected[c].astype("float64")
    assert plain(rows) == plain(expected)


def test_entry_has_rows(spark, sf_dir):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.queries()["nid_decode"](spark, sf_dir).count() > 0
