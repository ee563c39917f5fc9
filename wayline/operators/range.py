"""Range queries: what lies of each trajectory in a box of space and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import between, clip, in_box, intervals_meet, ordinate, segments_meet
from ..schema import Box, Grid
from .assemble import ORDER, edges


def overlapping(trajectories: DataFrame, box: Box) -> DataFrame:
    """Rows whose bounding box (min_x .. max_t) meets the box; comparisons of plain columns, so Parquet can skip by them."""
    q = {"x": (box.x0, box.x1), "y": (box.y0, box.y1), "t": (box.t0, box.t1)}
    for c, (lo, hi) in q.items():
        trajectories = trajectories.where((F.col(f"max_{c}") >= lo) & (F.col(f"min_{c}") <= hi))
    return trajectories


def points_in(points: DataFrame, box: Box) -> DataFrame:
    return points.where(in_box(F.col("x"), F.col("y"), F.col("t"), box))


def point_runs(points: DataFrame, box: Box) -> DataFrame:
    """Runs of an object's consecutive points inside the box: object_id, run (from 1), n_points, first_t, last_t."""
    w = Window.partitionBy("object_id").orderBy(*ORDER)
    rows = points.withColumn("pos", F.row_number().over(w))
    inside = points_in(rows, box)
    # inside the box, positions grow by one more than row numbers wherever points in between are missing
    island = inside.withColumn("gap", F.col("pos") - F.row_number().over(w))
    runs = island.groupBy("object_id", "gap").agg(F.count(F.lit(1)).alias("n_points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    by_time = Window.partitionBy("object_id").orderBy("gap")
    return runs.select("object_id", F.row_number().over(by_time).alias("run"), "n_points", "first_t", "last_t")


def _meets(box: dict[str, Column]) -> Column:
    """Edges whose own box meets the query's: cheap, before the exact test."""
    out = F.lit(True)
    for c in ORDER:
        out = out & intervals_meet(F.least(f"{c}0", f"{c}1"), F.greatest(f"{c}0", f"{c}1"), box[f"{c}0"], box[f"{c}1"])
    return out


def _box_columns(box: Box) -> dict[str, Column]:
    return {k: F.lit(getattr(box, k)) for k in ("x0", "y0", "t0", "x1", "y1", "t1")}


def clip_edges(rows: DataFrame, box: dict[str, Column], rounded: bool = False, keys: tuple[str, ...] = ("object_id",), inner: str | None = None) -> DataFrame:
    """The parts of edges in a box: keys, seq, u1, u2 and the part's ends (t_in, x_in, y_in, t_out, x_out, y_out).

    ``inner`` names a boolean column: true for edges known to lie inside, which pass whole and untested."""
    start, end = ([F.col(f"{c}{i}") for c in ("x", "y", "t")] for i in (0, 1))
    hit, u1, u2 = clip(start, end, [box[f"{c}0"] for c in ("x", "y", "t")], [box[f"{c}1"] for c in ("x", "y", "t")])
    meets = _meets(box)
    if inner:
        meets, hit = F.when(F.col(inner), True).otherwise(meets), F.when(F.col(inner), True).otherwise(hit)
        u1, u2 = F.when(F.col(inner), 0.0).otherwise(u1), F.when(F.col(inner), 1.0).otherwise(u2)
    met = rows.where(meets).withColumns({"hit": hit, "u1": u1, "u2": u2}).where("hit")
    ends = [between(F.col(f"{c}0"), F.col(f"{c}1"), F.col(u), whole=c == "t", rounded=rounded).alias(f"{c}_{name}") for name, u in (("in", "u1"), ("out", "u2")) for c in ORDER]
    return met.select(*keys, "seq", "u1", "u2", *ends)


def clipped(points: DataFrame, box: Box, rounded: bool = False) -> DataFrame:
    """Clipped edges of each object. Edges need their neighbours, so points shuffle by object once; the box test follows at once."""
    return clip_edges(edges(points), _box_columns(box), rounded)


def pieces(parts: DataFrame, keys: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Clipped edges joined to sub-trajectories: where one ends at its edge's end and the next begins at its edge's start they are one piece.

    keys, piece (from 1), n_points, first_t, last_t, length."""
    w = Window.partitionBy(*keys).orderBy("seq")
    joined = (F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("u2").over(w) == 1) & (F.col("u1") == 0)
    rows = parts.withColumn("piece", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w).cast("int"))
    dx, dy = F.col("x_out") - F.col("x_in"), F.col("y_out") - F.col("y_in")
    return rows.groupBy(*keys, "piece").agg((F.count(F.lit(1)) + 1).alias("n_points"), F.min("t_in").alias("first_t"), F.max("t_out").alias("last_t"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"))


def whole_edges(points: DataFrame, box: Box) -> DataFrame:
    """Unclipped edges whose time meets the box's and that have an end in its rectangle or cross a side."""
    rows = edges(points)
    a, b = (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))
    corner = {"sw": (box.x0, box.y0), "se": (box.x1, box.y0), "ne": (box.x1, box.y1), "nw": (box.x0, box.y1)}
    inside = lambda p: p[0].between(box.x0, box.x1) & p[1].between(box.y0, box.y1)
    hit = inside(a) | inside(b)
    for one, two in (("sw", "se"), ("se", "ne"), ("ne", "nw"), ("nw", "sw")):
        hit = hit | segments_meet(a, b, corner[one], corner[two])
    return rows.where(_meets(_box_columns(box))).where(hit)


def _in_cells(rows: DataFrame, names: dict[str, str], grid: Grid) -> DataFrame:
    """A row for every cell that the rectangle of the named columns covers."""
    spans = []
    for i, c in enumerate(("x", "y")):
        a, b = F.col(names[f"{c}0"]), F.col(names[f"{c}1"])
        spans.append(F.sequence(ordinate(F.least(a, b), grid, i), ordinate(F.greatest(a, b), grid, i)))
    return rows.withColumn("gx", F.explode(spans[0])).withColumn("gy", F.explode(spans[1]))


def batch(points: DataFrame, boxes: DataFrame, grid: Grid) -> DataFrame:
    """Clipped edges for many boxes (qid, x0, y0, t0, x1, y1, t1) at once: qid, object_id, seq, u1, u2 and the ends.

    Boxes and edges meet by an equi-join on the cells of a two-dimensional grid
    that they cover; a pair counts in the first cell they share, so nothing has
    to be deduplicated."""
    q = {c: F.col(f"q_{c}") for c in ("x0", "y0", "t0", "x1", "y1", "t1")}
    asked = _in_cells(boxes.select("qid", *[F.col(c).alias(f"q_{c}") for c in q]), {c: f"q_{c}" for c in q}, grid)
    there = _in_cells(edges(points), {c: c for c in q}, grid)
    met = there.join(asked, ["gx", "gy"]).where(_meets(q))
    first = [F.greatest(ordinate(F.least(f"{c}0", f"{c}1"), grid, i), ordinate(q[f"{c}0"], grid, i)) for i, c in enumerate(("x", "y"))]
    met = met.where((F.col("gx") == first[0]) & (F.col("gy") == first[1]))
    return clip_edges(met, q, keys=("qid", "object_id"))
