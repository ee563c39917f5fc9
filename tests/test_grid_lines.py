"""Queries over clipped segments against their SQL where points lie on grid lines and paths turn back there."""

from __future__ import annotations

import pytest

from wayline import queries as q

START = 1704800000000
# (user_id, event_id, value): object 3 touches the line x = 4 and goes back, 4 crosses others from x = 6 down, 15 and 25 start on lines, 7 is a lone point on one
ROWS = [(3, 10, 50.0), (3, 107, 100.0), (3, 204, 50.0), (3, 87, 60.0), (4, 11, 120.0), (4, 12, 200.0), (4, 13, 50.0), (4, 14, 50.0), (15, 50, 100.0), (15, 51, 20.0), (15, 52, 100.0), (25, 53, 200.0), (25, 54, 100.0), (25, 55, 0.0), (7, 56, 200.0)]
NAMES = ["interval_completeness", "number_completeness", "segment_clip_2d", "segment_clip_3d", "segment_pivots", "segments_flat"]


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    folder, con = tmp_path_factory.mktemp("lines"), duckdb.connect()
    rows = ", ".join(f"({e}, make_timestamp({1000 * (START + 60_000 * i)}), {u}, 'view', {v}::DOUBLE, '')" for i, (u, e, v) in enumerate(ROWS))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, lines, name):
    folder, con = lines
    want = con.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
