"""Every trajectory query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from wayline import queries as q

SF = "/root/testdata/sf0.001"
SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = sorted(got.columns)

    def plain(frame):
        frame = frame[key].copy()
        for c in key:
            frame[c] = frame[c].astype(str) if str(frame[c].dtype) in ("object", "str", "string") else frame[c].astype("float64").fillna(-1).round(5)
        return frame.sort_values(key).reset_index(drop=True)

    assert plain(got).equals(plain(want))
