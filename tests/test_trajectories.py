"""Segments, range and similarity queries on small data, indexed and not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import assemble, range as ranges, segment, similar, tools
from wayline.plans.table import SegmentTable
from wayline.schema import Box, Grid
from wayline.sources import points as sources


def walk(n_objects=6, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for o in range(n_objects):
        xy = rng.random(2) * 10 - 12 + np.cumsum(rng.normal(size=(n, 2)), 0)
        rows += [(f"o{o}", 1000 * (i + 1), float(x), float(y)) for i, (x, y) in enumerate(xy)]
    rows += [("lone", 5, -7.0, -7.0), ("still", 1, 0.0, 0.0), ("still", 1, 0.0, 0.0), ("still", 2, 0.0, 0.0)]
    return rows


@pytest.fixture(scope="module")
def pts(spark):
    return spark.createDataFrame(walk(), "object_id string, t bigint, x double, y double").cache()


@pytest.fixture(scope="module")
def table(pts, tmp_path_factory):
    return SegmentTable.write(pts, str(tmp_path_factory.mktemp("t")), bits=3, dims=2, per_directory=10)


def test_assemble(pts):
    t = {r["object_id"]: r for r in assemble.trajectories(pts).collect()}
    assert t["o1"]["n_points"] == 40 and [p["t"] for p in t["o1"]["pts"]] == sorted(p["t"] for p in t["o1"]["pts"])
    assert assemble.edges(pts).where("object_id = 'lone'").count() == 0
    assert assemble.edges(pts).count() == sum(r["n_points"] - 1 for r in t.values())


@pytest.mark.parametrize("dims", [2, 3])
def test_clipped_segments_put_together_are_the_trajectory(pts, dims):
    grid = assemble.grid_of(pts, 3, dims)
    cut = segment.clipped(pts, grid)
    real = cut.select("object_id", F.explode("pts").alias("p")).where("p.is_real").select("object_id", "p.t", "p.x", "p.y")
    assert sorted(map(tuple, real.collect())) == sorted(walk())
    assert segment.complete(cut.select("object_id", "first_pos", "last_pos", "n_total")).count() == 8
    by = {}
    for r in cut.orderBy("object_id", "seg_no").collect():
        by.setdefault(r["object_id"], []).append(r)
    for rows in by.values():
        assert [r["seg_no"] for r in rows] == list(range(1, len(rows) + 1)) and [r["is_last"] for r in rows] == [False] * (len(rows) - 1) + [True]
        for a, b in zip(rows, rows[1:], strict=False):
            end, begin = a["pts"][-1], b["pts"][0]
            assert (end["t"], end["x"], end["y"]) == (begin["t"], begin["x"], begin["y"])
        names = ["gx", "gy", "gt"][:dims]
        for r in rows:  # every point lies in the segment's closed cell
            for (c, _, _), axis, name in zip(grid.axes(), range(dims), names, strict=True):
                lo, hi = grid.edge(axis, r[name]), grid.edge(axis, r[name] + 1)
                slack = 1.0 if c == "t" else 1e-9
                assert all(lo - slack <= p[c] <= hi + slack for p in r["pts"])


def test_edges_on_corners_and_lines(spark):
    grid = Grid(2, 2, 0.0, 0.0, 0, 4.0, 4.0, 10)
    rows = [("corner", 0, 0.5, 0.5), ("corner", 3, 3.5, 3.5), ("line", 0, 0.5, 1.0), ("line", 1, 3.5, 1.0), ("top", 0, 4.0, 4.0), ("top", 1, 3.9, 4.0)]
    df = spark.createDataFrame(rows, "object_id string, t bigint, x double, y double")
    cut = segment.clipped(df, grid).orderBy("object_id", "seg_no").collect()
    cells = {}
    for r in cut:
        cells.setdefault(r["object_id"], []).append((r["gx"], r["gy"]))
    assert cells == {"corner": [(0, 0), (1, 1), (2, 2), (3, 3)], "line": [(0, 1), (1, 1), (2, 1), (3, 1)], "top": [(3, 3)]}
    passing = [r for r in cut if r["object_id"] == "corner" and r["first_pos"] is None]
    assert len(passing) == 2 and all(r["core_min_x"] is None for r in passing)


def test_pivots(spark):
    rows = [("a", i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 3, 10])]
    df = spark.createDataFrame(rows, "object_id string, t bigint, x double, y double")
    grid = Grid(1, 2, 0.0, 0.0, 0, 100.0, 1.0, 10)
    p = segment.with_pivots(segment.clipped(df, grid)).first()["pivots"]
    assert [q["pos"] for q in p] == [4, 5, 1]  # nearest to 5 is 3; farthest from it 10; farthest from that 0


def test_fixed_size_and_by_cell(pts):
    k = segment.fixed_size(pts, 10).where("object_id = 'o0'").orderBy("seg_no").collect()
    assert [len(r["pts"]) for r in k] == [11, 11, 11, 10] and k[-1]["is_last"]
    assert k[0]["pts"][-1]["pos"] == k[1]["pts"][0]["pos"]
    assert segment.fixed_size(pts, 10).where("object_id = 'lone'").first()["seg_no"] == 1
    cells = segment.by_cell(pts, assemble.grid_of(pts, 3, 2)).where("object_id = 'o0'").orderBy("seg_no").collect()
    assert all(a["pts"][-1]["pos"] == b["pts"][0]["pos"] for a, b in zip(cells, cells[1:], strict=False))


BOXES = [Box(-11.0, -11.0, 5000, -5.0, -4.0, 30000), Box(-99.0, -99.0, 0, 99.0, 99.0, 10**9), Box(50.0, 50.0, 0, 60.0, 60.0, 10**9), Box(-8.0, -8.0, 0, -6.5, -6.0, 10**6)]


def length(df):
    d = F.sqrt((F.col("x_out") - F.col("x_in")) ** 2 + (F.col("y_out") - F.col("y_in")) ** 2)
    return {r[0]: round(r[1], 6) for r in df.groupBy("object_id").agg(F.sum(d)).collect() if r[1] > 1e-9}


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("dims", [2, 3])
def test_indexed_ranges_equal_plain_ones(pts, box, dims, tmp_path):
    t = SegmentTable.write(pts, str(tmp_path / "t"), bits=2, dims=dims, per_directory=20)
    plain = length(ranges.clipped(pts, box))
    assert length(t.range(box)) == pytest.approx(plain, abs=1e-3)
    want = {tuple(r) for r in ranges.points_in(pts, box).collect()}
    assert {(r["object_id"], r["t"], r["x"], r["y"]) for r in t.points(box).collect()} == want


def test_batch_equals_single(pts, spark):
    rows = [(i, b.x0, b.y0, b.t0, b.x1, b.y1, b.t1) for i, b in enumerate(BOXES)]
    boxes = spark.createDataFrame(rows, "qid int, x0 double, y0 double, t0 bigint, x1 double, y1 double, t1 bigint")
    got = ranges.batch(pts, boxes, assemble.grid_of(pts, 3, 2))
    for i, b in enumerate(BOXES):
        one = sorted(tuple(r) for r in ranges.clipped(pts, b).collect())
        assert sorted(tuple(r)[1:] for r in got.where(F.col("qid") == i).collect()) == one


def test_pieces_and_runs(pts):
    everything = BOXES[1]
    assert {r["n_points"] for r in ranges.pieces(ranges.clipped(pts, everything)).collect()} == {40, 3}
    runs = {r["object_id"]: r["n_points"] for r in ranges.point_runs(pts, everything).collect()}
    assert runs["lone"] == 1 and runs["o0"] == 40
    assert ranges.whole_edges(pts, everything).count() == assemble.edges(pts).count()
    assert ranges.clipped(pts, BOXES[2]).count() == 0


def test_filter_reaches_the_scan(table):
    plan = table.range(BOXES[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dir" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters" in plan and "mbr_max_x" in plan.split("PushedFilters")[1].split("]")[0]
    meta = table.candidates(np.array([(-8.0, -8.0)]), 1.0, "pivots")._jdf.queryExecution().executedPlan().toString()
    assert "pts" not in meta.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("prune", ["mbr", "pivots", "points"])
def test_similar(pts, table, prune):
    whole = assemble.trajectories(pts)
    query = similar.query_points(whole, "o2")
    scores = {r["object_id"]: r["score"] for r in similar.nearest_brute(whole, query, 99).collect()}
    for eps in (0.0, 3.0, sorted(scores.values())[3]):
        want = {o for o, s in scores.items() if s <= eps}
        assert {r["object_id"] for r in table.similar(query, eps, prune).collect()} == want
        assert {r["object_id"] for r in similar.within(whole, query, eps).collect()} == want
    assert scores["o2"] == 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest(pts, table, k):
    whole = assemble.trajectories(pts)
    query = similar.query_points(whole, "o3")
    brute = [tuple(r) for r in similar.nearest_brute(whole, query, k).collect()]
    assert [tuple(r) for r in table.nearest(query, k).collect()] == brute and len(brute) == min(k, 8)


def test_similar_batch(pts):
    whole = assemble.trajectories(pts)
    asked = whole.where("object_id in ('o1', 'o4')").select(F.col("object_id").alias("qid"), "pts")
    got = {(r["qid"], r["object_id"]) for r in similar.within_batch(whole, asked, 6.0, 2.0).collect()}
    want = {(q, r["object_id"]) for q in ("o1", "o4") for r in similar.within(whole, similar.query_points(whole, q), 6.0, prune=False).collect()}
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,1.5,2.5,2024-01-01 00:00:01\nb,bad,2,2024-01-01 00:00:01\nc,1,2,not a time\n")
    got = sources.read_points(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in got] == [("a", 1704067201000, 1.5, 2.5)]
    assert sources.read_points(spark, str(tmp_path / "p.csv"), on_bad_time="null").count() == 2
    with pytest.raises(Exception, match="parsed"):
        sources.read_points(spark, str(tmp_path / "p.csv"), on_bad_time="error").collect()
    (tmp_path / "q.txt").write_text("1,2,3;4,5,6;\n\n")
    q = sources.read_trajectories(spark, str(tmp_path / "q.txt")).first()
    assert [tuple(p) for p in q["pts"]] == [(3, 1.0, 2.0), (6, 4.0, 5.0)] and q["max_y"] == 5.0
    (tmp_path / "b.txt").write_text("0;1;2;3;4;5\n")
    assert tuple(sources.read_boxes(spark, str(tmp_path / "b.txt")).first())[1:] == (0.0, 1.0, 2, 3.0, 4.0, 5)


def test_tools(spark, pts):
    grid = assemble.grid_of(pts, 3, 2)
    boxes = tools.random_boxes(spark, grid, 9, 0.5, 0.5, 100, seed=4)
    assert boxes.count() == 9 and boxes.where(f"x0 < {grid.x0} or x1 > {grid.x1}").count() == 0
    lines = tools.sample_trajectories(assemble.trajectories(pts), 3)
    back = lines.select("object_id", sources.parse_trajectory(F.col("line")).alias("pts")).collect()
    whole = {r["object_id"]: r["pts"] for r in assemble.trajectories(pts).collect()}
    assert len(back) == 3 and all(r["pts"] == whole[r["object_id"]] for r in back)
    line = [(1.0, 2.0, 3.0), (4.0, 5.5, 6.0)]
    assert tools.line_from_wkb(tools.line_to_wkb(line)) == line


def test_stream(spark, tmp_path):
    from wayline.streaming.ingest import append_points

    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 1, 1.0, 2.0), ("b", 2, 3.0, 4.0)], "object_id string, t bigint, x double, y double")
    df.withColumn("ts", F.timestamp_millis("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("object_id string, t bigint, x double, y double, ts timestamp").parquet(str(tmp_path / "in"))
    append_points(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "object_id string, t bigint, x double, y double")
    assert assemble.trajectories(none).count() == 0
    assert ranges.pieces(ranges.clipped(none, BOXES[0])).count() == 0
    assert segment.clipped(none, assemble.grid_of(none, 3, 2)).count() == 0


@pytest.mark.parametrize("box", BOXES)
def test_point_table(pts, box, tmp_path):
    from wayline.plans.table import PointTable

    t = PointTable.write(pts, str(tmp_path / "p"), bits=4, dims=2)
    want = sorted(tuple(r) for r in ranges.points_in(pts, box).collect())
    assert sorted(tuple(r) for r in t.range(box).select("object_id", "t", "x", "y").collect()) == want


def test_batch_on_the_table(pts, spark, table):
    rows = [(i, b.x0, b.y0, b.t0, b.x1, b.y1, b.t1) for i, b in enumerate(BOXES)]
    boxes = spark.createDataFrame(rows, "qid int, x0 double, y0 double, t0 bigint, x1 double, y1 double, t1 bigint")
    got = table.range_batch(boxes)
    for i, b in enumerate(BOXES):
        assert length(got.where(F.col("qid") == i)) == pytest.approx(length(ranges.clipped(pts, b)), abs=1e-3)


def test_flat_table(pts, tmp_path):
    from wayline.plans.table import write_flat

    flat = write_flat(pts, str(tmp_path / "f"), bits=3, dims=2)
    assert flat.select("object_id").distinct().count() == 8 and "PushedFilters: [IsNotNull(mbr_max_x)" in flat.where("mbr_max_x > 3")._jdf.queryExecution().executedPlan().toString()


def test_neighbours():
    from wayline.functions import hilbert

    assert len(hilbert.neighbours(0, 3, 2)) == 3
    middle = int(hilbert.numbers(np.array([(3, 4)]), 3)[0])
    assert sorted(map(tuple, hilbert.cells(np.array(hilbert.neighbours(middle, 3, 2)), 3, 2).tolist())) == sorted((x, y) for x in (2, 3, 4) for y in (3, 4, 5) if (x, y) != (3, 4))


def test_similar_window(pts, table):
    whole = assemble.trajectories(pts)
    query = similar.query_points(whole, "o2")
    assert table.similar(query, 0.0, window=(0, 10**9)).count() == 1 and table.similar(query, 0.0, window=(2000, 10**9)).count() == 0


def test_nearest_in_a_window_and_from_afar(pts, table):
    whole = assemble.trajectories(pts)
    query = similar.query_points(whole, "o3")
    for asked, window in ((query, (0, 35_000)), (query + 500.0, None)):
        rows = whole.where(f"min_t >= {window[0]} and max_t <= {window[1]}") if window else whole
        brute = [tuple(r) for r in similar.nearest_brute(rows, asked, 3).collect()]
        assert [tuple(r) for r in table.nearest(asked, 3, window).collect()] == brute


@pytest.mark.parametrize("eps", [0.0, 3.0, 40.0])
def test_similar_batch_on_the_table(pts, table, eps):
    whole = assemble.trajectories(pts)
    asked = whole.where("object_id in ('o1', 'o4', 'lone')").select(F.col("object_id").alias("qid"), "pts")
    got = {(r["qid"], r["object_id"], round(r["score"], 9)) for r in table.similar_batch(asked, eps).collect()}
    want = {(q, r["object_id"], round(r["score"], 9)) for q in ("o1", "o4", "lone") for r in similar.within(whole, similar.query_points(whole, q), eps, prune=False).collect()}
    assert got == want


def test_cells_near_edges_hold_those_near_points(table):
    query = np.array([(-11.0, -11.0), (-4.0, -3.0), (-4.0, -3.0)])
    points, edges = set(table.near_cells(query, 0.5)), set(table.near_cells(query, 0.5, edges=True))
    assert points <= edges and len(edges) > len(points)


def test_cover_keeps_what_points_keep(pts, table):
    query = np.cumsum(np.random.default_rng(3).normal(size=(300, 2)), 0) - 7.0
    whole = assemble.trajectories(pts)
    want = {r["object_id"]: r["score"] for r in similar.nearest_brute(whole, query, 4).collect()}
    assert {r["object_id"]: r["score"] for r in table.nearest(query, 4).collect()} == want
    assert {r["object_id"]: r["score"] for r in similar.nearest(whole, query, 4).collect()} == want


def test_metrics(table):
    from wayline.plans.metrics import measure

    some, all_ = measure(table.points(BOXES[3])), measure(table.points(BOXES[1]))
    assert some.rows == table.points(BOXES[3]).count() and some.scans == 1
    assert 0 < some.files < all_.files and some.rows_scanned < all_.rows_scanned and all_.rows == 6 * 40 + 4


def test_links(pts):
    parts = segment.by_cell(pts, assemble.grid_of(pts, 3, 2))
    assert segment.unlinked(parts).count() == 0
    gone = parts.where("not (object_id = 'o1' and seg_no = 2)")
    assert [tuple(r) for r in segment.unlinked(gone).collect()] == [("o1", 3)]
    whole = {r["object_id"] for r in segment.complete_by_number(gone).collect()}
    assert whole == {r["object_id"] for r in parts.select("object_id").distinct().collect()} - {"o1"}


def test_well_known_binary(spark):
    df = spark.createDataFrame([("a", [(5, 1.5, -0.0), (7, 1e-310, 3.25)]), ("b", []), ("c", None)], "object_id string, pts array<struct<t:bigint,x:double,y:double>>")
    got = {r["object_id"]: r["wkb"] for r in tools.with_wkb(df).collect()}
    assert bytes(got["a"]) == tools.line_to_wkb([(1.5, -0.0, 5.0), (1e-310, 3.25, 7.0)]) and tools.line_from_wkb(bytes(got["b"])) == [] and got["c"] is None


def test_settings(spark, tmp_path):
    from wayline.settings import Settings

    (tmp_path / "s.conf").write_text('# a run\nindex {\n  bits = 4\n  path: "hdfs:///a b"\n}\nbox { \n x0 = 1\n y0 = 2.5\n t0 = 3\n x1 = 4\n y1 = 5\n t1 = 6\n}\nclip = true // yes\n')
    s = Settings.load(spark, str(tmp_path / "s.conf"))
    assert s.integer("index.bits") == 4 and s.text("index.path") == "hdfs:///a b" and s.flag("clip") and s.number("eps", 0.5) == 0.5
    assert s.box("box") == Box(1.0, 2.5, 3, 4.0, 5.0, 6)
    for bad in ("a {", "}", "alone"):
        with pytest.raises(ValueError):
            Settings.parse(bad)
    with pytest.raises(KeyError):
        s.text("none")


@pytest.mark.parametrize("box", BOXES)
def test_unclipped_layout(pts, box, tmp_path):
    from wayline.plans.table import range_unclipped, write_unclipped

    t = write_unclipped(pts, str(tmp_path / "u"), bits=2)
    assert length(range_unclipped(t, box)) == pytest.approx(length(ranges.clipped(pts, box)), abs=1e-3)
