"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    plain = frame.map(lambda x: round(float(x), 6) if isinstance(x, float | np.floating) else str(x) if isinstance(x, list | np.ndarray) else x)
    return sorted(map(str, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)
