"""Every query that has SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from runnel.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 9) + 0.0 if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    mine = catalog.queries()[name](spark, DATA).toPandas()
    theirs = db.execute(SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["entry_segments"](spark, DATA)
    assert set(df.columns) == {"recording_id", "seg_idx", "start_idx", "end_idx", "label"}
    assert df.count() > 0
