"""From points to trajectories, edges, bounds and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ordinates
from ..functions.hilbert import with_number
from ..schema import PAD_DEGREES, PAD_MILLIS, Grid

ORDER = ("t", "x", "y")


def trajectories(points: DataFrame) -> DataFrame:
    """One row an object: its points in order of (t, x, y), their number and bounding box.

    All points of an object meet in one row, as the similarity queries need
    them; queries that don't, work on ``edges`` instead."""
    grouped = points.groupBy("object_id").agg(
        F.array_sort(F.collect_list(F.struct(*ORDER))).alias("pts"),
        F.count(F.lit(1)).alias("n_points"),
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "t") for n, f in (("min", F.min), ("max", F.max))],
    )
    return grouped.select("object_id", "n_points", "pts", "min_x", "max_x", "min_y", "max_y", "min_t", "max_t")


def edges(points: DataFrame) -> DataFrame:
    """Consecutive points of each object: object_id, seq (from 0), t0, x0, y0, t1, x1, y1. A lone point has none."""
    w = Window.partitionBy("object_id").orderBy(*ORDER)
    nexts = [F.lead(c).over(w).alias(f"{c}1") for c in ORDER]
    rows = points.select("object_id", (F.row_number().over(w) - 1).alias("seq"), *[F.col(c).alias(f"{c}0") for c in ORDER], *nexts)
    return rows.where("t1 is not null").select("object_id", "seq", "t0", "x0", "y0", "t1", "x1", "y1")


def bounds(points: DataFrame) -> DataFrame:
    """One row: the bounding box of all points, its upper sides padded."""
    agg = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "t") for n, f in (("min", F.min), ("max", F.max))])
    return agg.select("min_x", (F.col("max_x") + PAD_DEGREES).alias("max_x"), "min_y", (F.col("max_y") + PAD_DEGREES).alias("max_y"), "min_t", (F.col("max_t") + PAD_MILLIS).alias("max_t"))


def grid_of(points: DataFrame, bits: int, dims: int) -> Grid:
    """A grid over the data's bounds: six numbers come to the driver."""
    b = bounds(points).first()
    if b is None or b["min_x"] is None:
        return Grid(bits, dims, 0.0, 0.0, 0, 1.0, 1.0, 1)
    return Grid(bits, dims, b["min_x"], b["min_y"], b["min_t"], b["max_x"], b["max_y"], b["max_t"])


def with_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Points with the ordinates of their cell (gx, gy and, in three dimensions, gt)."""
    names = ["gx", "gy", "gt"][: grid.dims]
    return points.withColumns(dict(zip(names, ordinates({c: F.col(c) for c in ORDER}, grid), strict=True)))


def with_cell_number(points: DataFrame, grid: Grid) -> DataFrame:
    """Points with ordinates and the curve number of their cell."""
    return with_number(with_cells(points, grid), ["gx", "gy", "gt"][: grid.dims], grid.bits, "cell")


def occupancy(points: DataFrame, grid: Grid) -> DataFrame:
    """Points and objects of each cell that has any."""
    names = ["gx", "gy", "gt"][: grid.dims]
    return with_cells(points, grid).groupBy(*names).agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("object_id").alias("n_objects"))


def cells_per_trajectory(points: DataFrame, grid: Grid) -> DataFrame:
    """One row: number of trajectories, and the mean number of distinct cells of their points."""
    names = ["gx", "gy", "gt"][: grid.dims]
    each = with_cells(points, grid).select("object_id", *names).distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("n_trajectories"), F.avg("n").alias("avg_cells"))
