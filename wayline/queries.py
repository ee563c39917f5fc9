"""Entries for the driver: each operator over trajectories derived from ``events``, and equivalent SQL.

Positions: object user_id at epoch milliseconds t, x = user_id % 10 + value / 100,
y = (user_id div 10) % 10 + (event_id % 97) / 97."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .operators import assemble, range as ranges, segment, similar, tools
from .plans.table import PointTable, SegmentTable, range_unclipped, write_flat, write_unclipped
from .sources.points import parse_trajectory
from .schema import Box, Grid

BOX = Box(2.25, 0.25, 1704700000000, 6.75, 7.5, 1705600000000)
RECT = (3.0, 4.0, 3.5, 4.5)
BOXES = [(0, 2.25, 0.25, 1704700000000, 6.75, 7.5, 1705600000000), (1, 0.5, 0.25, 1704067200000, 1.5, 1.75, 1704900000000), (2, 5.1, 1.2, 1705000000000, 8.4, 3.3, 1706200000000), (3, 50.0, 50.0, 1704067200000, 60.0, 60.0, 1706700000000)]
# The grid's bounds are fixed here, so that SQL can name them; positions beyond go to the outer cells.
GRID2 = Grid(4, 2, 0.0, 0.0, 1704067200000, 16.0, 16.0, 1706745600000)
GRID3 = Grid(3, 3, 0.0, 0.0, 1704067200000, 16.0, 16.0, 1706745600000)
QUERY_USER, K, EPS = 8, 5, 1.5
FIXED_K = 10
WINDOW = (1704067200000, 1706400000000)  # a time range that holds some objects whole
LEFT_OF = 9.0
N_BOXES, BOX_SIDE, BOX_MILLIS, N_EXPORTED, SEED = 20, 0.5, 350_000_000, 5, 1
PER_DIRECTORY = 200  # points, few enough that these tables have many directories to prune


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("object_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        ((F.col("user_id") % 10).cast("double") + F.col("value") / 100.0).alias("x"),
        (F.expr("(user_id div 10) % 10").cast("double") + (F.col("event_id") % 97).cast("double") / 97.0).alias("y"),
    )


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/wayline-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, dims: int = 2) -> SegmentTable:
    return SegmentTable.write(points(spark, sf_dir), _scratch(spark), bits=4 if dims == 2 else 3, dims=dims, per_directory=PER_DIRECTORY)


def r6(c: str | F.Column) -> F.Column:
    return F.round(c, 6)


def traj_points(s, d):
    return points(s, d).select("object_id", "t", r6("x").alias("x"), r6("y").alias("y"))


def traj_assemble(s, d):
    t = assemble.trajectories(points(s, d))
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    return t.select("object_id", "n_points", *[r6(f"{n}_{c}").alias(f"{n}_{c}") for c in "xy" for n in ("min", "max")], "min_t", "max_t", r6(first["x"]).alias("first_x"), r6(last["y"]).alias("last_y"))


def traj_bounds(s, d):
    return assemble.bounds(points(s, d)).select(*[F.round(f"{n}_{c}", 8).alias(f"{n}_{c}") for c in "xy" for n in ("min", "max")], "min_t", "max_t")


def edge_list(s, d):
    return assemble.edges(points(s, d)).select("object_id", F.col("seq").cast("bigint").alias("seq"), "t0", "t1", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def cell_assign_2d(s, d):
    return assemble.with_cells(points(s, d), GRID2).select("object_id", "t", "gx", "gy")


def cell_assign_3d(s, d):
    return assemble.with_cells(points(s, d), GRID3).select("object_id", "t", "gx", "gy", "gt")


def cell_occupancy(s, d):
    return assemble.occupancy(points(s, d), GRID2)


def cells_per_trajectory(s, d):
    return assemble.cells_per_trajectory(points(s, d), GRID3).select("n_trajectories", r6("avg_cells").alias("avg_cells"))


def hilbert_index_2d(s, d):
    return assemble.with_cell_number(points(s, d), GRID2).select("object_id", "t", "cell")


def segment_by_cell(s, d):
    return segment.by_cell(points(s, d), GRID2).select("object_id", "seg_no", "is_last", "gx", "gy", F.size("pts").alias("n_points"), F.element_at("pts", 1)["t"].alias("first_t"), F.element_at("pts", -1)["t"].alias("last_t"))


def segment_fixed_k(s, d):
    return segment.fixed_size(points(s, d), FIXED_K).select("object_id", "seg_no", "is_last", F.size("pts").alias("n_points"), F.element_at("pts", 1)["t"].alias("first_t"), F.element_at("pts", -1)["t"].alias("last_t"))


def _clipped(s, d, grid):
    names = ["gx", "gy", "gt"][: grid.dims]
    c = segment.clipped(points(s, d), grid)
    return c.select("object_id", "seg_no", "is_last", *names, F.size("real").alias("n_real"), "first_pos", "last_pos", "mbr_min_t", "mbr_max_t", r6("mbr_min_x").alias("mbr_min_x"), r6("mbr_max_y").alias("mbr_max_y"))


def segment_clip_2d(s, d):
    return _clipped(s, d, GRID2)


def segment_clip_3d(s, d):
    return _clipped(s, d, GRID3)


def segment_pivots(s, d):
    p = segment.with_pivots(segment.clipped(points(s, d), GRID2)).where("pivots is not null")
    return p.select("object_id", "seg_no", F.array_join(F.transform("pivots", lambda q: q["pos"].cast("string")), ",").alias("pivots"))


def interval_completeness(s, d):
    return segment.complete(segment.clipped(points(s, d), GRID2).select("object_id", "first_pos", "last_pos", "n_total"))


def mbr_overlap(s, d):
    return ranges.overlapping(assemble.trajectories(points(s, d)), BOX).select("object_id", "n_points")


def range_points(s, d):
    return ranges.points_in(points(s, d), BOX).select("object_id", "t", r6("x").alias("x"), r6("y").alias("y"))


def range_points_runs(s, d):
    return ranges.point_runs(points(s, d), BOX)


def _ends(df, *more):
    return df.select(*more, *[r6(c).alias(c) for c in ("x_in", "y_in", "x_out", "y_out")], "t_in", "t_out")


def range_clip(s, d):
    return _ends(ranges.clipped(points(s, d), BOX), "object_id", F.col("seq").cast("bigint").alias("seq"))


def range_clip_concat(s, d):
    return ranges.pieces(ranges.clipped(points(s, d), BOX)).select("object_id", "piece", "n_points", "first_t", "last_t", r6("length").alias("length"))


def range_whole_edge(s, d):
    return ranges.whole_edges(points(s, d), BOX).select("object_id", F.col("seq").cast("bigint").alias("seq"), "t0", "t1")


def range_mbr_only(s, d):
    """Fixed-size segments whose bounding box meets the query's, unrefined."""
    segs = segment.fixed_size(points(s, d), FIXED_K)
    boxed = segs.withColumns({f"{n}_{c}": f(F.transform("pts", segment.field(c))) for c in ("x", "y", "t") for n, f in (("min", F.array_min), ("max", F.array_max))})
    return ranges.overlapping(boxed, BOX).select("object_id", "seg_no", F.size("pts").alias("n_points"))


def _range_total(parts: DataFrame) -> DataFrame:
    """Length and number of real edges' worth of what a range query leaves, the same however edges are cut."""
    dx, dy = F.col("x_out") - F.col("x_in"), F.col("y_out") - F.col("y_in")
    return parts.groupBy("object_id").agg(F.round(F.sum(F.sqrt(dx * dx + dy * dy)), 4).alias("length"))


def range_indexed(s, d):
    return _range_total(_table(s, d).range(BOX)).where("length > 0")


def range_indexed_3d(s, d):
    return _range_total(_table(s, d, 3).range(BOX)).where("length > 0")


def range_points_indexed(s, d):
    return _table(s, d).points(BOX).select("object_id", "t", r6("x").alias("x"), r6("y").alias("y"))


def range_batch(s, d):
    boxes = s.createDataFrame(BOXES, "qid int, x0 double, y0 double, t0 bigint, x1 double, y1 double, t1 bigint")
    return _ends(ranges.batch(points(s, d), boxes, GRID2), "qid", "object_id", F.col("seq").cast("bigint").alias("seq"))


def range_batch_indexed(s, d):
    boxes = s.createDataFrame(BOXES, "qid int, x0 double, y0 double, t0 bigint, x1 double, y1 double, t1 bigint")
    parts = _table(s, d).range_batch(boxes)
    dx, dy = F.col("x_out") - F.col("x_in"), F.col("y_out") - F.col("y_in")
    return parts.groupBy("qid", "object_id").agg(F.round(F.sum(F.sqrt(dx * dx + dy * dy)), 4).alias("length")).where("length > 0")


def range_points_curve(s, d):
    return PointTable.write(points(s, d), _scratch(s)).range(BOX).select("object_id", "t", r6("x").alias("x"), r6("y").alias("y"))


def segments_flat(s, d):
    flat = write_flat(points(s, d), _scratch(s), grid=GRID2)
    boxed = [F.col(f"mbr_{n}_{c}").alias(f"{n}_{c}") for c in ("x", "y", "t") for n in ("min", "max")]
    return ranges.overlapping(flat.select("object_id", "first_pos", *boxed), BOX).where("first_pos is not null").groupBy("object_id").agg(F.min("first_pos").alias("first_pos"))


def rect_count(s, d):
    return points(s, d).where(F.col("x").between(RECT[0], RECT[2]) & F.col("y").between(RECT[1], RECT[3])).agg(F.count(F.lit(1)).alias("n"))


def dist_point_rect(s, d):
    return points(s, d).select("object_id", "t", r6(g.point_to_rectangle(F.col("x"), F.col("y"), *RECT)).alias("dist"))


def minmaxdist_point_rect(s, d):
    return points(s, d).select("object_id", "t", r6(g.min_max_distance(F.col("x"), F.col("y"), *RECT)).alias("dist"))


def dist_segment_rect(s, d):
    e = assemble.edges(points(s, d))
    return e.select("object_id", F.col("seq").cast("bigint").alias("seq"), r6(g.segment_to_rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *RECT)).alias("dist"))


def rect_rect_dist(s, d):
    t = assemble.trajectories(points(s, d))
    return t.select("object_id", r6(g.rectangle_to_rectangle(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")], *RECT)).alias("dist"))


def line_intersection(s, d):
    e = assemble.edges(points(s, d))
    p = g.segments_cross((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")), (2.0, 2.0), (7.0, 8.0))
    return e.withColumn("p", p).where("p is not null").select("object_id", F.col("seq").cast("bigint").alias("seq"), r6("p.x").alias("x"), r6("p.y").alias("y"))


def edge_box_test(s, d):
    e = assemble.edges(points(s, d))
    start, end = ([F.col(f"{c}{i}") for c in ("x", "y", "t")] for i in (0, 1))
    two = g.clip(start[:2], end[:2], [BOX.x0, BOX.y0], [BOX.x1, BOX.y1])[0]
    three = g.clip(start, end, [BOX.x0, BOX.y0, BOX.t0], [BOX.x1, BOX.y1, BOX.t1])[0]
    return e.select("object_id", F.col("seq").cast("bigint").alias("seq"), two.alias("meets_2d"), three.alias("meets_3d"))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", r6("score"))


def frechet_threshold(s, d):
    t = assemble.trajectories(points(s, d))
    return _scored(similar.within(t, similar.query_points(t, QUERY_USER), EPS, prune=False))


def frechet_threshold_pruned(s, d):
    t = _table(s, d)
    return _scored(t.similar(similar.query_points(t.trajectories, QUERY_USER), EPS))


def frechet_batch(s, d):
    t = assemble.trajectories(points(s, d))
    asked = t.where(F.col("object_id").isin(1, 2, 8)).select(F.col("object_id").alias("qid"), "pts")
    return _scored(similar.within_batch(t, asked, EPS, 0.5))


def frechet_threshold_edges(s, d):
    """Cells by the query's edges, segments by their boxes."""
    t = _table(s, d)
    return _scored(t.similar(similar.query_points(t.trajectories, QUERY_USER), EPS, "mbr", edges=True))


def frechet_batch_indexed(s, d):
    t = _table(s, d)
    asked = t.trajectories.where(F.col("object_id").isin(1, 2, 8)).select(F.col("object_id").alias("qid"), "pts")
    return _scored(t.similar_batch(asked, EPS))


def knn_window(s, d):
    t = _table(s, d, 3)
    return _scored(t.nearest(similar.query_points(t.trajectories, QUERY_USER), K, WINDOW))


def range_unclipped_layout(s, d):
    return _range_total(range_unclipped(write_unclipped(points(s, d), _scratch(s)), BOX)).where("length > 0")


def number_completeness(s, d):
    """Objects all of whose segments lie left of a line, by segment number."""
    left = segment.clipped(points(s, d), GRID2).where(F.col("mbr_max_x") <= LEFT_OF)
    return segment.complete_by_number(left.select("object_id", "seg_no", "is_last"))


def knn_brute(s, d):
    t = assemble.trajectories(points(s, d))
    return _scored(similar.nearest_brute(t, similar.query_points(t, QUERY_USER), K))


def knn_pruned(s, d):
    t = _table(s, d)
    return _scored(t.nearest(similar.query_points(t.trajectories, QUERY_USER), K))


def query_generator(s, d):
    boxes = tools.random_boxes(s, assemble.grid_of(points(s, d), 4, 2), N_BOXES, BOX_SIDE, BOX_SIDE, BOX_MILLIS, SEED)
    return boxes.select("qid", "t0", "t1", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def export_trajectories(s, d):
    """The exported lines, read back."""
    lines = tools.sample_trajectories(assemble.trajectories(points(s, d)), N_EXPORTED, SEED)
    back = lines.select("object_id", parse_trajectory(F.col("line")).alias("pts"))
    total = {f"sum_{c}": F.round(F.aggregate(F.transform("pts", segment.field(c)), F.lit(0.0), lambda a, v: a + v), 4) for c in "xy"}
    return back.withColumns(total).select("object_id", F.size("pts").cast("bigint").alias("n_points"), F.element_at("pts", -1)["t"].alias("last_t"), *total)


def export_wkb(s, d):
    return tools.with_wkb(assemble.trajectories(points(s, d))).select("object_id", F.octet_length("wkb").cast("bigint").alias("n_bytes"))


_NAMED = [
    traj_points, traj_assemble, traj_bounds, edge_list, cell_assign_2d, cell_assign_3d, cell_occupancy, cells_per_trajectory, hilbert_index_2d,
    segment_by_cell, segment_fixed_k, segment_clip_2d, segment_clip_3d, segment_pivots, interval_completeness, mbr_overlap, range_points,
    range_points_runs, range_clip, range_clip_concat, range_whole_edge, range_mbr_only, range_indexed, range_indexed_3d, range_points_indexed,
    range_batch, range_batch_indexed, range_points_curve, segments_flat, rect_count, dist_point_rect, minmaxdist_point_rect, dist_segment_rect, rect_rect_dist, line_intersection, edge_box_test,
    frechet_threshold, frechet_threshold_pruned, frechet_threshold_edges, frechet_batch, frechet_batch_indexed, knn_brute, knn_pruned, knn_window,
    range_unclipped_layout, number_completeness, query_generator, export_trajectories, export_wkb,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMED}


# ------------------------------------------------------------------ oracles

P = "p AS (SELECT user_id AS object_id, epoch_us(ts) // 1000 AS t, CAST(user_id % 10 AS DOUBLE) + value / 100.0 AS x, CAST((user_id // 10) % 10 AS DOUBLE) + CAST(event_id % 97 AS DOUBLE) / 97.0 AS y FROM events)"
E_ = P + ", e0 AS (SELECT object_id, row_number() OVER w - 1 AS seq, t AS t0, x AS x0, y AS y0, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY object_id ORDER BY t, x, y)), e AS (SELECT * FROM e0 WHERE t1 IS NOT NULL)"
B = BOX


def _ord(v: str, grid: Grid, axis: int) -> str:
    _, lo, hi = grid.axes()[axis]
    return f"CAST(greatest(0, least({grid.parts - 1}, floor(({v} - {lo!r}) / {hi - lo!r} * {grid.parts}))) AS INTEGER)"


def _clip_sql(box: dict[str, str], dims: str = "xyt") -> tuple[str, str, str]:
    enters, leaves, inside = ["0.0"], ["1.0"], []
    for c in dims:
        a, dd = f"{c}0", f"CAST({c}1 - {c}0 AS DOUBLE)"
        p, q = f"CAST({box[c + '0']} - {a} AS DOUBLE)", f"CAST({box[c + '1']} - {a} AS DOUBLE)"
        enters.append(f"CASE WHEN {dd} = 0 THEN 0.0 ELSE least({p} / {dd}, {q} / {dd}) END")
        leaves.append(f"CASE WHEN {dd} = 0 THEN 1.0 ELSE greatest({p} / {dd}, {q} / {dd}) END")
        inside.append(f"({dd} <> 0 OR ({p} <= 0 AND {q} >= 0))")
    return " AND ".join(inside), f"greatest({', '.join(enters)})", f"least({', '.join(leaves)})"


def _at(c: str, u: str, whole: bool = False) -> str:
    v = f"{c}0 + {u} * ({c}1 - {c}0)"
    if whole:
        v = f"CAST(trunc({v}) AS BIGINT)"
    return f"CASE WHEN {u} = 0 THEN {c}0 WHEN {u} = 1 THEN {c}1 ELSE {v} END"


_LITERAL = {k: repr(getattr(BOX, k)) for k in ("x0", "y0", "t0", "x1", "y1", "t1")}
_IN, _U1, _U2 = _clip_sql(_LITERAL)
_ENDS = ", ".join(f"{_at(c, u, c == 't')} AS {c}_{n}" for n, u in (("in", "u1"), ("out", "u2")) for c in "txy")
CLIP = E_ + f", c0 AS (SELECT *, {_IN} AS inside, {_U1} AS u1, {_U2} AS u2 FROM e), c AS (SELECT object_id, seq, u1, u2, {_ENDS} FROM c0 WHERE inside AND u1 <= u2)"
_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("x_in", "y_in", "x_out", "y_out"))


def _xy2d(bits: int) -> str:
    """Curve numbers by the textbook rotation, a step a bit."""
    steps, n = [f"h{bits} AS (SELECT object_id, t, {_ord('x', GRID2, 0)} AS hx, {_ord('y', GRID2, 1)} AS hy, CAST(0 AS BIGINT) AS h FROM p)"], 1 << bits
    for b in range(bits - 1, -1, -1):
        s = 1 << b
        rx, ry = f"((hx >> {b}) & 1)", f"((hy >> {b}) & 1)"
        fx, fy = (f"CASE WHEN {rx} = 1 THEN {n - 1} - {v} ELSE {v} END" for v in ("hx", "hy"))
        steps.append(f"h{b} AS (SELECT object_id, t, CASE WHEN {ry} = 0 THEN {fy} ELSE hx END AS hx, CASE WHEN {ry} = 0 THEN {fx} ELSE hy END AS hy, h + {s * s} * xor(3 * {rx}, {ry}) AS h FROM h{b + 1})")
    return ", ".join(steps)


def _segments_sql(grid: Grid) -> str:
    axes, names = grid.axes(), ["gx", "gy", "gt"][: grid.dims]
    ords = {f"{n}{i}": _ord(f"CAST({n}{i} AS DOUBLE)", grid, k) for k, (n, _, _) in enumerate(axes) for i in (0, 1)}
    cuts = ["[0.0, 1.0]"]
    for n, lo, hi in axes:
        a, b = f"g{n}0", f"g{n}1"
        cuts.append(f"CASE WHEN {a} = {b} THEN [] ELSE list_transform(range(least({a}, {b}) + 1, greatest({a}, {b}) + 1), lambda k: ({lo!r} + k * {(hi - lo) / grid.parts!r} - CAST({n}0 AS DOUBLE)) / (CAST({n}1 AS DOUBLE) - CAST({n}0 AS DOUBLE))) END")
    joined = cuts[0]
    for c in cuts[1:]:
        joined = f"list_concat({joined}, {c})"
    middle = {names[k]: _ord(f"(CAST({n}0 AS DOUBLE) + (u0 + u1) / 2 * (CAST({n}1 AS DOUBLE) - CAST({n}0 AS DOUBLE)))", grid, k) for k, (n, _, _) in enumerate(axes)}
    ends = [f"{_at(c, u, c == 't')} AS {c}{n}" for n, u in (("a", "u0"), ("b", "u1")) for c in "txy"]
    changed = " OR ".join(f"{n} <> lag({n}) OVER w" for n in names)
    return f"""{E_}, one AS (SELECT object_id, 0 AS seq, t AS t0, x AS x0, y AS y0, t AS t1, x AS x1, y AS y1 FROM p WHERE object_id NOT IN (SELECT object_id FROM e)),
ee AS (SELECT * FROM e UNION ALL SELECT * FROM one), tot AS (SELECT object_id, count(*) AS n_total FROM p GROUP BY object_id),
o AS (SELECT *, {', '.join(f'{v} AS g{k}' for k, v in ords.items())} FROM ee),
q AS (SELECT *, list_sort(list_distinct(list_filter({joined}, lambda u: u >= 0 AND u <= 1))) AS cuts FROM o),
s0 AS (SELECT *, unnest(range(1, len(cuts))) AS i FROM q),
s1 AS (SELECT *, i - 1 AS sub, cuts[i] AS u0, cuts[i + 1] AS u1 FROM s0),
s2 AS (SELECT object_id, seq, sub, u0, u1, {', '.join(f'{v} AS {k}' for k, v in middle.items())}, {', '.join(ends)} FROM s1),
s3 AS (SELECT *, CASE WHEN {changed} THEN 1 ELSE 0 END AS new FROM s2 WINDOW w AS (PARTITION BY object_id ORDER BY seq, sub)),
s4 AS (SELECT *, CAST(1 + sum(new) OVER (PARTITION BY object_id ORDER BY seq, sub) AS INTEGER) AS seg_no FROM s3),
s5 AS (SELECT *, max(seg_no) OVER (PARTITION BY object_id) = seg_no AS is_last, lead(seg_no) OVER (PARTITION BY object_id ORDER BY seq, sub) IS DISTINCT FROM seg_no AS ends FROM s4),
r AS (SELECT object_id, seg_no, seq + 1 AS pos, t{'a'} AS t, xa AS x, ya AS y FROM s5 WHERE u0 = 0
      UNION SELECT object_id, seg_no, seq + 2 AS pos, tb, xb, yb FROM s5 JOIN tot USING (object_id) WHERE u1 = 1 AND n_total > 1 AND (NOT ends OR is_last)),
box AS (SELECT object_id, seg_no, is_last, {', '.join(f'any_value({n}) AS {n}' for n in names)}, min(least(ta, tb)) AS mbr_min_t, max(greatest(ta, tb)) AS mbr_max_t, min(least(xa, xb)) AS mbr_min_x, max(greatest(xa, xb)) AS mbr_max_x, min(least(ya, yb)) AS mbr_min_y, max(greatest(ya, yb)) AS mbr_max_y FROM s5 GROUP BY object_id, seg_no, is_last),
rr AS (SELECT object_id, seg_no, CAST(count(*) AS INTEGER) AS n_real, min(pos) AS first_pos, max(pos) AS last_pos FROM r GROUP BY object_id, seg_no)"""


def _clip_segments(grid: Grid) -> str:
    names = ", ".join(["gx", "gy", "gt"][: grid.dims])
    return f"WITH {_segments_sql(grid)} SELECT object_id, seg_no, is_last, {names}, coalesce(n_real, 0) AS n_real, first_pos, last_pos, mbr_min_t, mbr_max_t, round(mbr_min_x, 6) AS mbr_min_x, round(mbr_max_y, 6) AS mbr_max_y FROM box LEFT JOIN rr USING (object_id, seg_no)"


_DIST = "sqrt((a[{i}].x - b[{j}].x) * (a[{i}].x - b[{j}].x) + (a[{i}].y - b[{j}].y) * (a[{i}].y - b[{j}].y))"


def _frechet(queries: str) -> str:
    """qid, object_id, score for every trajectory against the objects named."""
    d1, dij = _DIST.format(i="1", j="j"), _DIST.format(i="i", j="j")
    row0 = f"list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, greatest(coalesce(acc[j - 1], 0.0), {d1})), CAST([] AS DOUBLE[]))"
    step = f"list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, greatest(least(prev[j], coalesce(prev[j - 1], 'inf'::DOUBLE), coalesce(acc[j - 1], 'inf'::DOUBLE)), {dij})), CAST([] AS DOUBLE[]))"
    return f"""{P}, tr AS (SELECT object_id, list({{'t': t, 'x': x, 'y': y}} ORDER BY t, x, y) AS pts FROM p GROUP BY object_id),
pr AS (SELECT q.object_id AS qid, t.object_id, q.pts AS a, t.pts AS b FROM tr q, tr t WHERE q.object_id IN ({queries})),
fr AS (SELECT qid, object_id, list_reduce(range(2, len(a) + 1), lambda prev, i: {step}, {row0})[len(b)] AS score FROM pr)"""


def _sides(x: str, y: str) -> str:
    return f"({x} BETWEEN {B.x0} AND {B.x1} AND {y} BETWEEN {B.y0} AND {B.y1})"


def _cross(c: tuple[float, float], d: tuple[float, float]) -> str:
    (cx, cy), (dx, dy) = c, d
    rx, ry, sx, sy = "(x1 - x0)", "(y1 - y0)", f"({dx} - {cx})", f"({dy} - {cy})"
    k = f"({rx} * {sy} - {ry} * {sx})"
    u = f"((({cx} - x0) * {sy} - ({cy} - y0) * {sx}) / {k})"
    v = f"((({cx} - x0) * {ry} - ({cy} - y0) * {rx}) / {k})"
    return f"CASE WHEN {k} <> 0 THEN ({u} BETWEEN 0 AND 1 AND {v} BETWEEN 0 AND 1) ELSE false END"


def _point_rect(x: str, y: str) -> str:
    dx, dy = f"greatest({RECT[0]} - {x}, 0.0, {x} - {RECT[2]})", f"greatest({RECT[1]} - {y}, 0.0, {y} - {RECT[3]})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _point_segment(x: float, y: float) -> str:
    sq = "((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
    u = f"(CASE WHEN {sq} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (({x} - x0) * (x1 - x0) + ({y} - y0) * (y1 - y0)) / {sq})) END)"
    px, py = f"({x} - (x0 + {u} * (x1 - x0)))", f"({y} - (y0 + {u} * (y1 - y0)))"
    return f"sqrt({px} * {px} + {py} * {py})"


def oracle_sql() -> dict[str, str]:
    meets = " AND ".join(f"greatest({c}0, {c}1) >= {getattr(B, c + '0')!r} AND least({c}0, {c}1) <= {getattr(B, c + '1')!r}" for c in "txy")
    corners = [(B.x0, B.y0), (B.x1, B.y0), (B.x1, B.y1), (B.x0, B.y1)]
    sides = " OR ".join(_cross(corners[i], corners[(i + 1) % 4]) for i in range(4))
    inside = f"x BETWEEN {B.x0} AND {B.x1} AND y BETWEEN {B.y0} AND {B.y1} AND t BETWEEN {B.t0} AND {B.t1}"
    changed = "gx <> lag(gx) OVER w OR gy <> lag(gy) OVER w"
    fixed = f"""{P}, n AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t, x, y) AS pos, count(*) OVER (PARTITION BY object_id) AS n FROM p),
s AS (SELECT object_id, pos, t, x, y, CAST(greatest(1, (pos - 2) // {FIXED_K} + 1) AS INTEGER) AS seg_no FROM n UNION ALL
      SELECT object_id, pos, t, x, y, CAST((pos - 1) // {FIXED_K} + 1 AS INTEGER) FROM n WHERE pos > 1 AND pos < n AND (pos - 1) % {FIXED_K} = 0)"""
    q = {c: f"q_{c}" for c in ("x0", "y0", "t0", "x1", "y1", "t1")}
    b_in, b_u1, b_u2 = _clip_sql(q)
    boxes = ", ".join(f"({', '.join(map(repr, b))})" for b in BOXES)
    corners4 = [_point_segment(x, y) for x in (RECT[0], RECT[2]) for y in (RECT[1], RECT[3])]
    mid_x, mid_y = (RECT[0] + RECT[2]) / 2, (RECT[1] + RECT[3]) / 2
    nx, fx = (f"CASE WHEN x {op} {mid_x} THEN {RECT[0]} ELSE {RECT[2]} END" for op in ("<=", ">="))
    ny, fy = (f"CASE WHEN y {op} {mid_y} THEN {RECT[1]} ELSE {RECT[3]} END" for op in ("<=", ">="))
    in2, u12, u22 = _clip_sql(_LITERAL, "xy")
    total = f"WITH {CLIP} SELECT object_id, round(sum(sqrt((x_out - x_in) * (x_out - x_in) + (y_out - y_in) * (y_out - y_in))), 4) AS length FROM c GROUP BY object_id HAVING length > 0"
    cx, cy, dx, dy = 2.0, 2.0, 7.0, 8.0
    k = f"((x1 - x0) * ({dy} - {cy}) - (y1 - y0) * ({dx} - {cx}))"
    u = f"((({cx} - x0) * ({dy} - {cy}) - ({cy} - y0) * ({dx} - {cx})) / {k})"
    knn = f"WITH {_frechet(str(QUERY_USER))} SELECT object_id, round(score, 6) AS score FROM fr ORDER BY fr.score, object_id LIMIT {K}"
    near = f"WITH {_frechet(str(QUERY_USER))} SELECT object_id, round(score, 6) AS score FROM fr WHERE fr.score <= {EPS}"
    in_range = f"WITH {P} SELECT object_id, t, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE {inside}"
    mbr = " AND ".join(f"mbr_max_{c} >= {getattr(B, c + '0')!r} AND mbr_min_{c} <= {getattr(B, c + '1')!r}" for c in "xyt")
    share = {c: f"(CAST('0x' || substr(md5('{SEED}:{c}:' || qid), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)" for c in "xyt"}
    pd2 = "((r.x - {x}) * (r.x - {x}) + (r.y - {y}) * (r.y - {y}))"
    return {
        "traj_points": f"WITH {P} SELECT object_id, t, round(x, 6) AS x, round(y, 6) AS y FROM p",
        "traj_assemble": f"WITH {P} SELECT object_id, count(*) AS n_points, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, min(t) AS min_t, max(t) AS max_t, round(first(x ORDER BY t, x, y), 6) AS first_x, round(last(y ORDER BY t, x, y), 6) AS last_y FROM p GROUP BY object_id",
        "traj_bounds": f"WITH {P} SELECT round(min(x), 8) AS min_x, round(max(x) + 1e-7, 8) AS max_x, round(min(y), 8) AS min_y, round(max(y) + 1e-7, 8) AS max_y, min(t) AS min_t, max(t) + 1000 AS max_t FROM p",
        "edge_list": f"WITH {E_} SELECT object_id, seq, t0, t1, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM e",
        "cell_assign_2d": f"WITH {P} SELECT object_id, t, {_ord('x', GRID2, 0)} AS gx, {_ord('y', GRID2, 1)} AS gy FROM p",
        "cell_assign_3d": f"WITH {P} SELECT object_id, t, {_ord('x', GRID3, 0)} AS gx, {_ord('y', GRID3, 1)} AS gy, {_ord('CAST(t AS DOUBLE)', GRID3, 2)} AS gt FROM p",
        "cell_occupancy": f"WITH {P} SELECT {_ord('x', GRID2, 0)} AS gx, {_ord('y', GRID2, 1)} AS gy, count(*) AS n_points, count(DISTINCT object_id) AS n_objects FROM p GROUP BY 1, 2",
        "cells_per_trajectory": f"WITH {P}, c AS (SELECT DISTINCT object_id, {_ord('x', GRID3, 0)} AS gx, {_ord('y', GRID3, 1)} AS gy, {_ord('CAST(t AS DOUBLE)', GRID3, 2)} AS gt FROM p), n AS (SELECT object_id, count(*) AS n FROM c GROUP BY object_id) SELECT count(*) AS n_trajectories, round(avg(n), 6) AS avg_cells FROM n",
        "hilbert_index_2d": f"WITH {P}, {_xy2d(GRID2.bits)} SELECT object_id, t, h AS cell FROM h0",
        "segment_by_cell": f"""WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t, x, y) AS pos, {_ord('x', GRID2, 0)} AS gx, {_ord('y', GRID2, 1)} AS gy FROM p),
f AS (SELECT *, CASE WHEN {changed} THEN 1 ELSE 0 END AS new FROM n WINDOW w AS (PARTITION BY object_id ORDER BY pos)),
s AS (SELECT *, CAST(1 + sum(new) OVER (PARTITION BY object_id ORDER BY pos) AS INTEGER) AS seg_no FROM f),
a AS (SELECT object_id, seg_no, pos, t, gx, gy FROM s UNION ALL SELECT object_id, seg_no - 1, pos, t, NULL, NULL FROM s WHERE new = 1)
SELECT object_id, seg_no, seg_no = max(seg_no) OVER (PARTITION BY object_id) AS is_last, max(gx) AS gx, max(gy) AS gy, CAST(count(*) AS INTEGER) AS n_points, min(t) AS first_t, max(t) AS last_t FROM a GROUP BY object_id, seg_no""",
        "segment_fixed_k": f"WITH {fixed} SELECT object_id, seg_no, seg_no = max(seg_no) OVER (PARTITION BY object_id) AS is_last, CAST(count(*) AS INTEGER) AS n_points, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY object_id, seg_no",
        "segment_clip_2d": _clip_segments(GRID2),
        "segment_clip_3d": _clip_segments(GRID3),
        "segment_pivots": f"""WITH {_segments_sql(GRID2)},
ce AS (SELECT object_id, seg_no, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM r GROUP BY object_id, seg_no),
p1 AS (SELECT r.object_id, r.seg_no, first({{'pos': r.pos, 'x': r.x, 'y': r.y}} ORDER BY sqrt({pd2.format(x='cx', y='cy')}), r.pos) AS a FROM r JOIN ce USING (object_id, seg_no) GROUP BY r.object_id, r.seg_no),
p2 AS (SELECT r.object_id, r.seg_no, any_value(a) AS a, first({{'pos': r.pos, 'x': r.x, 'y': r.y}} ORDER BY -sqrt({pd2.format(x='a.x', y='a.y')}), r.pos) AS b FROM r JOIN p1 USING (object_id, seg_no) GROUP BY r.object_id, r.seg_no),
p3 AS (SELECT r.object_id, r.seg_no, any_value(a) AS a, any_value(b) AS b, first(r.pos ORDER BY -sqrt({pd2.format(x='b.x', y='b.y')}), r.pos) AS c, list(r.pos ORDER BY r.pos) FILTER (r.pos = 1 OR r.pos = n_total) AS z FROM r JOIN p2 USING (object_id, seg_no) JOIN tot USING (object_id) GROUP BY r.object_id, r.seg_no),
l AS (SELECT object_id, seg_no, list_concat([a.pos, b.pos, c], coalesce(z, [])) AS v FROM p3)
SELECT object_id, seg_no, array_to_string(list_filter(v, lambda e, i: list_position(v, e) = i), ',') AS pivots FROM l""",
        "interval_completeness": f"WITH {_segments_sql(GRID2)} SELECT object_id, n_total, count(*) AS n_segments FROM rr JOIN tot USING (object_id) GROUP BY object_id, n_total HAVING sum(last_pos - first_pos + 1) = n_total",
        "mbr_overlap": f"WITH {P} SELECT object_id, count(*) AS n_points FROM p GROUP BY object_id HAVING max(x) >= {B.x0} AND min(x) <= {B.x1} AND max(y) >= {B.y0} AND min(y) <= {B.y1} AND max(t) >= {B.t0} AND min(t) <= {B.t1}",
        "range_points": in_range,
        "range_points_indexed": in_range,
        "range_points_curve": in_range,
        "range_batch_indexed": f"WITH {E_}, q(qid, q_x0, q_y0, q_t0, q_x1, q_y1, q_t1) AS (VALUES {boxes}), c0 AS (SELECT *, {b_in} AS inside, {b_u1} AS u1, {b_u2} AS u2 FROM e, q), c AS (SELECT qid, object_id, seq, {_ENDS} FROM c0 WHERE inside AND u1 <= u2) SELECT CAST(qid AS INTEGER) AS qid, object_id, round(sum(sqrt((x_out - x_in) * (x_out - x_in) + (y_out - y_in) * (y_out - y_in))), 4) AS length FROM c GROUP BY qid, object_id HAVING length > 0",
        "range_points_runs": f"""WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t, x, y) AS pos FROM p),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY object_id ORDER BY pos) AS gap FROM n WHERE {inside})
SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY gap) AS INTEGER) AS run, count(*) AS n_points, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY object_id, gap""",
        "range_clip": f"WITH {CLIP} SELECT object_id, seq, {_R}, t_in, t_out FROM c",
        "range_clip_concat": f"""WITH {CLIP}, j AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(u2) OVER w = 1 AND u1 = 0 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY object_id ORDER BY seq)),
k AS (SELECT *, CAST(sum(new) OVER (PARTITION BY object_id ORDER BY seq) AS INTEGER) AS piece FROM j)
SELECT object_id, piece, count(*) + 1 AS n_points, min(t_in) AS first_t, max(t_out) AS last_t, round(sum(sqrt((x_out - x_in) * (x_out - x_in) + (y_out - y_in) * (y_out - y_in))), 6) AS length FROM k GROUP BY object_id, piece""",
        "range_whole_edge": f"WITH {E_} SELECT object_id, seq, t0, t1 FROM e WHERE {meets} AND ({_sides('x0', 'y0')} OR {_sides('x1', 'y1')} OR {sides})",
        "range_mbr_only": f"WITH {fixed} SELECT object_id, seg_no, CAST(count(*) AS INTEGER) AS n_points FROM s GROUP BY object_id, seg_no HAVING max(x) >= {B.x0} AND min(x) <= {B.x1} AND max(y) >= {B.y0} AND min(y) <= {B.y1} AND max(t) >= {B.t0} AND min(t) <= {B.t1}",
        "range_indexed": total,
        "range_indexed_3d": total,
        "range_batch": f"WITH {E_}, q(qid, q_x0, q_y0, q_t0, q_x1, q_y1, q_t1) AS (VALUES {boxes}), c0 AS (SELECT *, {b_in} AS inside, {b_u1} AS u1, {b_u2} AS u2 FROM e, q), c AS (SELECT qid, object_id, seq, {_ENDS} FROM c0 WHERE inside AND u1 <= u2) SELECT CAST(qid AS INTEGER) AS qid, object_id, seq, {_R}, t_in, t_out FROM c",
        "rect_count": f"WITH {P} SELECT count(*) AS n FROM p WHERE x BETWEEN {RECT[0]} AND {RECT[2]} AND y BETWEEN {RECT[1]} AND {RECT[3]}",
        "dist_point_rect": f"WITH {P} SELECT object_id, t, round({_point_rect('x', 'y')}, 6) AS dist FROM p",
        "minmaxdist_point_rect": f"WITH {P}, n AS (SELECT *, {nx} AS nx, {fx} AS fx, {ny} AS ny, {fy} AS fy FROM p) SELECT object_id, t, round(sqrt(least((x - nx) * (x - nx) + (y - fy) * (y - fy), (y - ny) * (y - ny) + (x - fx) * (x - fx))), 6) AS dist FROM n",
        "dist_segment_rect": f"WITH {E_} SELECT object_id, seq, round(least({_point_rect('x0', 'y0')}, {_point_rect('x1', 'y1')}, {', '.join(corners4)}), 6) AS dist FROM e",
        "rect_rect_dist": f"WITH {P}, b AS (SELECT object_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS b_y FROM p GROUP BY object_id), g AS (SELECT object_id, greatest({RECT[0]} - bx, 0.0, ax - {RECT[2]}) AS dx, greatest({RECT[1]} - b_y, 0.0, ay - {RECT[3]}) AS dy FROM b) SELECT object_id, round(sqrt(dx * dx + dy * dy), 6) AS dist FROM g",
        "line_intersection": f"WITH {E_} SELECT object_id, seq, round(x0 + {u} * (x1 - x0), 6) AS x, round(y0 + {u} * (y1 - y0), 6) AS y FROM e WHERE {_cross((cx, cy), (dx, dy))}",
        "edge_box_test": f"WITH {E_} SELECT object_id, seq, ({in2} AND {u12} <= {u22}) AS meets_2d, ({_IN} AND {_U1} <= {_U2}) AS meets_3d FROM e",
        "frechet_threshold": near,
        "frechet_threshold_pruned": near,
        "frechet_batch": f"WITH {_frechet('1, 2, 8')} SELECT qid, object_id, round(score, 6) AS score FROM fr WHERE fr.score <= {EPS}",
        "frechet_threshold_edges": near,
        "frechet_batch_indexed": f"WITH {_frechet('1, 2, 8')} SELECT qid, object_id, round(score, 6) AS score FROM fr WHERE fr.score <= {EPS}",
        "knn_window": f"WITH {_frechet(str(QUERY_USER))}, w AS (SELECT object_id FROM p GROUP BY object_id HAVING min(t) >= {WINDOW[0]} AND max(t) <= {WINDOW[1]}) SELECT object_id, round(score, 6) AS score FROM fr JOIN w USING (object_id) ORDER BY fr.score, object_id LIMIT {K}",
        "range_unclipped_layout": total,
        "number_completeness": f"WITH {_segments_sql(GRID2)} SELECT object_id, count(*) AS n_segments FROM box GROUP BY object_id HAVING max(mbr_max_x) <= {LEFT_OF}",
        "segments_flat": f"WITH {_segments_sql(GRID2)} SELECT object_id, min(first_pos) AS first_pos FROM box JOIN rr USING (object_id, seg_no) WHERE {mbr} GROUP BY object_id",
        "query_generator": f"""WITH {P}, b AS (SELECT min(x) AS gx0, max(x) + 1e-7 AS gx1, min(y) AS gy0, max(y) + 1e-7 AS gy1, min(t) AS gt0, max(t) + 1000 AS gt1 FROM p),
r AS (SELECT CAST(i AS INTEGER) AS qid, gx0 + {share['x']} * (gx1 - least({BOX_SIDE}, gx1 - gx0) - gx0) AS x0, gy0 + {share['y']} * (gy1 - least({BOX_SIDE}, gy1 - gy0) - gy0) AS y0, gt0 + CAST(floor({share['t']} * (gt1 - least({BOX_MILLIS}, gt1 - gt0) - gt0)) AS BIGINT) AS t0, b.* FROM b, (SELECT i, i AS qid FROM range({N_BOXES}) x(i)))
SELECT qid, t0, t0 + least({BOX_MILLIS}, gt1 - gt0) AS t1, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x0 + least({BOX_SIDE}, gx1 - gx0), 6) AS x1, round(y0 + least({BOX_SIDE}, gy1 - gy0), 6) AS y1 FROM r""",
        "export_trajectories": f"WITH {P}, c AS (SELECT DISTINCT object_id FROM p ORDER BY md5('{SEED}:' || object_id), object_id LIMIT {N_EXPORTED}) SELECT object_id, count(*) AS n_points, max(t) AS last_t, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM p JOIN c USING (object_id) GROUP BY object_id",
        "export_wkb": f"WITH {P} SELECT object_id, 9 + 24 * count(*) AS n_bytes FROM p GROUP BY object_id",
        "knn_brute": knn,
        "knn_pruned": knn,
    }
