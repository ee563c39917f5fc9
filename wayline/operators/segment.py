"""Cutting trajectories into segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import between, distance, ordinate
from ..functions.hilbert import with_number
from ..schema import Grid
from .assemble import ORDER, with_cells


def _points(*more: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("pos", *ORDER, *more)))


def _numbered(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("object_id").orderBy(*ORDER)
    return points.withColumn("pos", (F.row_number().over(w)).cast("bigint"))


def _with_last(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("object_id")
    return segments.withColumn("is_last", F.col("seg_no") == F.max("seg_no").over(w))


def by_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """Segments of consecutive points in one cell, unclipped: the first point of the next cell closes a segment and opens the next.

    object_id, seg_no (from 1), is_last, ordinates, pts (pos, t, x, y)."""
    names = ["gx", "gy", "gt"][: grid.dims]
    w = Window.partitionBy("object_id").orderBy("pos")
    rows = with_cells(_numbered(points), grid)
    changed = F.coalesce(F.struct(*names) != F.lag(F.struct(*names)).over(w), F.lit(False))
    rows = rows.withColumn("new", changed.cast("int"))
    rows = rows.withColumn("seg_no", (F.sum("new").over(w) + 1).cast("int"))
    shared = rows.where("new = 1").select("object_id", (F.col("seg_no") - 1).alias("seg_no"), "pos", *ORDER, *[F.lit(None).cast("int").alias(n) for n in names])
    both = rows.select("object_id", "seg_no", "pos", *ORDER, *names).unionByName(shared)
    return _with_last(both.groupBy("object_id", "seg_no").agg(*[F.max(n).alias(n) for n in names], _points().alias("pts")))


def fixed_size(points: DataFrame, k: int) -> DataFrame:
    """Segments of k steps; consecutive ones share a point. object_id, seg_no, is_last, pts."""
    rows = _numbered(points)
    w = Window.partitionBy("object_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w))
    own = rows.withColumn("seg_no", F.greatest(F.lit(1), F.ceil((F.col("pos") - 1) / k)).cast("int"))
    shared = own.where(f"pos > 1 and pos < n and (pos - 1) % {k} = 0").withColumn("seg_no", F.col("seg_no") + 1)
    return _with_last(own.unionByName(shared).groupBy("object_id", "seg_no").agg(_points().alias("pts")))


def _share(a: Column, b: Column, low: float, width: Column):
    """The share of the way from a to b at which grid line k is crossed."""
    return lambda k: (F.lit(low) + k * width - a) / (b - a)


def field(c: str):
    return lambda p: p[c]


def sub_edges(points: DataFrame, grid: Grid) -> DataFrame:
    """Edges cut where they cross grid lines: object_id, seq, sub, u0, u1, the edge's ends, and the ordinates of the cell of the part's middle.

    A lone point is one part of length 0."""
    axes = grid.axes()
    w = Window.partitionBy("object_id").orderBy(*ORDER)
    nexts = [F.lead(c).over(w).alias(f"{c}1") for c in ORDER]
    rows = points.select("object_id", (F.row_number().over(w) - 1).alias("seq"), *[F.col(c).alias(f"{c}0") for c in ORDER], *nexts)
    # a lone point is the first of its object and the last
    rows = rows.withColumn("alone", F.col("t1").isNull() & (F.col("seq") == 0)).where("t1 is not null or alone")
    rows = rows.withColumns({f"{c}1": F.coalesce(f"{c}1", f"{c}0") for c in ORDER})
    cuts = F.array(F.lit(0.0), F.lit(1.0))
    for i, (name, low, high) in enumerate(axes):
        a, b = F.col(f"{name}0").cast("double"), F.col(f"{name}1").cast("double")
        ga, gb = ordinate(a, grid, i), ordinate(b, grid, i)
        lines = F.when(ga != gb, F.sequence(F.least(ga, gb) + 1, F.greatest(ga, gb))).otherwise(F.expr("cast(array() as array<int>)"))
        width = F.lit((high - low) / grid.parts)
        # the ends are in already: an edge that leaves a line downwards crosses it at -0.0, which array_distinct tells from 0.0
        cuts = F.concat(cuts, F.filter(F.transform(lines, _share(a, b, low, width)), lambda u: (u > 0) & (u < 1)))
    rows = rows.withColumn("cuts", F.array_sort(F.array_distinct(cuts)))
    parts = rows.select("*", F.posexplode(F.arrays_zip(F.expr("slice(cuts, 1, size(cuts) - 1)").alias("u0"), F.expr("slice(cuts, 2, size(cuts) - 1)").alias("u1"))).alias("sub", "u"))
    parts = parts.select("object_id", "seq", "sub", "alone", "u.u0", "u.u1", *[f"{c}{i}" for i in (0, 1) for c in ORDER])
    middle = (F.col("u0") + F.col("u1")) / 2
    names = ["gx", "gy", "gt"]
    cells = {names[i]: ordinate(F.col(f"{n}0").cast("double") + middle * (F.col(f"{n}1").cast("double") - F.col(f"{n}0").cast("double")), grid, i) for i, (n, _, _) in enumerate(axes)}
    return parts.withColumns(cells)


def clipped(points: DataFrame, grid: Grid) -> DataFrame:
    """Segments cut at cell borders, with artificial points there.

    object_id, seg_no (from 1 in order of travel), is_last, cell, ordinates, pts
    (t, x, y, pos, is_real; pos numbers the real points from 1), the box of all
    points (mbr_*), of the real ones (core_*, null without any), the range of
    real points (first_pos, last_pos, null likewise) and ``n_total``, the
    object's points."""
    names = ["gx", "gy", "gt"][: grid.dims]
    w, totals = Window.partitionBy("object_id").orderBy("seq", "sub"), Window.partitionBy("object_id")
    parts = sub_edges(points, grid)
    changed = F.coalesce(F.struct(*names) != F.lag(F.struct(*names)).over(w), F.lit(False))
    parts = parts.withColumn("seg_no", (F.sum(changed.cast("int")).over(w) + 1).cast("int"))
    parts = parts.withColumn("n_total", (F.max("seq").over(totals) + F.when(F.col("alone"), 1).otherwise(2)).cast("bigint"))

    def at(u: str) -> Column:
        point = [between(F.col(f"{c}0"), F.col(f"{c}1"), F.col(u), whole=c == "t").alias(c) for c in ORDER]
        real = (F.col(u) == 0) | (F.col(u) == 1)
        pos = F.when((F.col(u) == 0) | F.col("alone"), F.col("seq") + 1).when(F.col(u) == 1, F.col("seq") + 2)
        return F.struct(F.when(F.col("alone"), 0.0).otherwise(F.col("seq") + F.col(u)).alias("at"), *point, pos.cast("bigint").alias("pos"), real.alias("is_real"))

    # a real point on a border belongs to the part that begins there, so that each is in one segment only
    ends = F.array(at("u0"), at("u1"))
    grouped = parts.groupBy("object_id", "seg_no").agg(*[F.first(n).alias(n) for n in names], F.max("n_total").alias("n_total"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(ends)))).alias("all"))
    grouped = _with_last(grouped)
    own = F.expr("transform(all, (p, i) -> named_struct('t', p.t, 'x', p.x, 'y', p.y, 'pos', p.pos, 'is_real', p.is_real and (is_last or i < size(all) - 1 or size(all) = 1)))")
    grouped = grouped.withColumn("pts", own).withColumn("real", F.filter("pts", lambda p: p["is_real"]))
    out = grouped.withColumns(
        {f"{kind}_{n}_{c}": f(F.transform(source, field(c))) for kind, source in (("mbr", "pts"), ("core", "real")) for c in ("x", "y", "t") for n, f in (("min", F.array_min), ("max", F.array_max))}
        | {"first_pos": F.array_min(F.transform("real", lambda p: p["pos"])), "last_pos": F.array_max(F.transform("real", lambda p: p["pos"]))}
    )
    return with_number(out.drop("all"), names, grid.bits, "cell")


def with_pivots(segments: DataFrame) -> DataFrame:
    """Segments with ``pivots``: of the real points the one nearest to their box's centre, the farthest from that, the farthest from this one; then the object's first and last point where the segment holds them. Ties go to the earlier point; null without real points."""
    cx, cy = (F.col("core_min_x") + F.col("core_max_x")) / 2, (F.col("core_min_y") + F.col("core_max_y")) / 2

    def pick(x: Column, y: Column, sign: int) -> Column:
        # the distance is computed the same way on every path, so equal ones tie exactly
        best = F.array_min(F.transform("real", lambda p: F.struct((distance(p["x"], p["y"], x, y) * sign).alias("d"), p["pos"].alias("pos"), p["x"].alias("x"), p["y"].alias("y"))))
        return F.struct(best["pos"].alias("pos"), best["x"].alias("x"), best["y"].alias("y"))

    rows = segments.withColumn("p1", pick(cx, cy, 1))
    rows = rows.withColumn("p2", pick(F.col("p1.x"), F.col("p1.y"), -1))
    rows = rows.withColumn("p3", pick(F.col("p2.x"), F.col("p2.y"), -1))
    ends = F.filter("real", lambda p: (p["pos"] == 1) | (p["pos"] == F.col("n_total")))
    ends = F.transform(ends, lambda p: F.struct(p["pos"].alias("pos"), p["x"].alias("x"), p["y"].alias("y")))
    pivots = F.array_distinct(F.concat(F.array("p1", "p2", "p3"), ends))
    return rows.withColumn("pivots", F.when(F.size("real") > 0, pivots)).drop("p1", "p2", "p3")


def complete_by_number(pieces: DataFrame) -> DataFrame:
    """Objects of which all segments are in ``pieces`` (object_id, seg_no, is_last): the numbers from 1 to the last one's."""
    seen = pieces.groupBy("object_id").agg(F.countDistinct("seg_no").alias("n_segments"), F.max(F.when(F.col("is_last"), F.col("seg_no"))).cast("bigint").alias("last"))
    return seen.where("n_segments = last").select("object_id", "n_segments")


def unlinked(segments: DataFrame) -> DataFrame:
    """Joints at which a trajectory's segments (object_id, seg_no, pts) do not fit: a number is missing, or one does not begin where the one before ends. object_id, seg_no of the later one."""
    w = Window.partitionBy("object_id").orderBy("seg_no")
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    ends = segments.select("object_id", "seg_no", *[first[c].alias(f"{c}0") for c in ORDER], *[last[c].alias(f"{c}1") for c in ORDER])
    before = ends.withColumns({"n": F.lag("seg_no").over(w)} | {f"{c}b": F.lag(f"{c}1").over(w) for c in ORDER})
    fits = (F.col("seg_no") == F.coalesce("n", F.lit(0)) + 1) & (F.col("n").isNull() | ((F.col("t0") == F.col("tb")) & (F.col("x0") == F.col("xb")) & (F.col("y0") == F.col("yb"))))
    return before.where(~fits).select("object_id", "seg_no")


def complete(pieces: DataFrame) -> DataFrame:
    """Objects of which all real points are in ``pieces`` (object_id, first_pos, last_pos, n_total)."""
    seen = pieces.where("first_pos is not null").groupBy("object_id").agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n_seen"), F.max("n_total").alias("n_total"), F.count(F.lit(1)).alias("n_segments"))
    return seen.where("n_seen = n_total").select("object_id", "n_total", "n_segments")
