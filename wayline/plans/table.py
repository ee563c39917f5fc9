"""A stored segment table: segments by cell, whole trajectories by id, and the grid.

Segments lie in directories of a coarse cell, the leading bits of the curve
number, sorted by the full number and time inside. A box or a query trajectory
becomes a list of cells on the driver, so Spark prunes directories and, by the
bounding-box columns, row groups. Whole trajectories are sorted by id, so that
a handful of ids reads a handful of row groups."""

from __future__ import annotations

import itertools
import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hilbert
from ..functions.geometry import distance, ordinate
from ..operators import assemble, range as ranges, segment, similar
from ..schema import Box, Grid

MAX_DIRECTORIES = 12  # bits of the coarse cell at most
PER_DIRECTORY = 50_000  # points; small data sets stay in few files
MAX_RUNS = 500  # runs of curve numbers that a filter names
MAX_LISTED = 20_000  # cells that a query lists; beyond it bounding boxes alone prune
MAX_SPREAD = 1024  # cells that a point of a query meets the table on; larger reaches meet on coarser cells
_SIDES = ("x0", "y0", "t0", "x1", "y1", "t1")


def _steps(segments: DataFrame, *keep: str) -> DataFrame:
    """The edges inside segments: the kept columns, seq and the ends."""
    steps = F.arrays_zip(F.expr("slice(pts, 1, greatest(size(pts) - 1, 0))").alias("a"), F.expr("slice(pts, 2, greatest(size(pts) - 1, 0))").alias("b"))
    parts = segments.select(*keep, F.posexplode(steps).alias("step", "e"))
    ends = {f"{c}{i}": F.col(f"e.{p}.{c}") for i, p in enumerate("ab") for c in ("t", "x", "y")}
    return parts.select(*keep, F.col("step").alias("seq"), *[v.alias(k) for k, v in ends.items()])


def _path_to_cells(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The distance of the segment ab to each rectangle; 0 where they meet."""

    def to_rectangle(p: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(np.maximum(low - p, p - high), 0.0) ** 2).sum(1))

    gap = np.minimum(to_rectangle(a), to_rectangle(b))
    d = b - a
    square = float(d @ d)
    if square == 0:
        return gap
    for corner in (low, high, np.stack([low[:, 0], high[:, 1]], 1), np.stack([high[:, 0], low[:, 1]], 1)):
        u = np.clip((corner - a) @ d / square, 0.0, 1.0)
        gap = np.minimum(gap, np.sqrt(((corner - a - u[:, None] * d) ** 2).sum(1)))
    enters, leaves, inside = np.zeros(len(low)), np.ones(len(low)), np.ones(len(low), bool)
    for i in (0, 1):
        if d[i] == 0:
            inside &= (low[:, i] <= a[i]) & (a[i] <= high[:, i])
            continue
        at = np.sort(np.stack([(low[:, i] - a[i]) / d[i], (high[:, i] - a[i]) / d[i]]), 0)
        enters, leaves = np.maximum(enters, at[0]), np.minimum(leaves, at[1])
    return np.where(inside & (enters <= leaves), 0.0, gap)


class PointTable:
    """A row a point, sorted by the cell's curve number over all files, so that a box reads few row groups."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid):
        self.grid, self.rows = grid, spark.read.parquet(path)

    @classmethod
    def write(cls, points: DataFrame, path: str, bits: int = 4, dims: int = 2) -> PointTable:
        grid = assemble.grid_of(points, bits, dims)
        rows = assemble.with_cell_number(points, grid).drop("gx", "gy", "gt")
        rows.repartitionByRange("cell", "t").sortWithinPartitions("cell", "t").write.parquet(path)
        return cls(points.sparkSession, path, grid)

    def range(self, box: Box) -> DataFrame:
        """The points in a box: runs of curve numbers skip, the box itself decides."""
        g = self.grid
        low, high = (box.x0, box.y0, box.t0)[: g.dims], (box.x1, box.y1, box.t1)[: g.dims]
        runs = hilbert.ranges([g.ordinate(i, v) for i, v in enumerate(low)], [g.ordinate(i, v) for i, v in enumerate(high)], g.bits)
        rows = self.rows
        if len(runs) <= MAX_RUNS:
            rows = rows.where(reduce(lambda a, b: a | b, [F.col("cell").between(a, b) for a, b in runs]))
        return ranges.points_in(rows, box)


def _contained(low: dict[str, Column], high: dict[str, Column]) -> Column:
    """Whether a segment's box lies inside a query's: all its edges do then, as those of inner cells, and need no test of their own."""
    return reduce(lambda a, b: a & b, [(F.col(f"mbr_min_{c}") >= low[c]) & (F.col(f"mbr_max_{c}") <= high[c]) for c in ("x", "y", "t")])


def write_unclipped(points: DataFrame, path: str, bits: int = 4, dims: int = 2) -> DataFrame:
    """Segments by cell as they are, without points at borders: object_id, seg_no, is_last, cell, pts and their box (min_x .. max_t), sorted by cell and time."""
    grid = assemble.grid_of(points, bits, dims)
    cut = hilbert.with_number(segment.by_cell(points, grid), ["gx", "gy", "gt"][:dims], bits, "cell")
    cut = cut.withColumns({f"{n}_{c}": f(F.transform("pts", segment.field(c))) for c in ("x", "y", "t") for n, f in (("min", F.array_min), ("max", F.array_max))})
    cut.repartitionByRange("cell", "min_t").sortWithinPartitions("cell", "min_t").write.parquet(path)
    return points.sparkSession.read.parquet(path)


def range_unclipped(table: DataFrame, box: Box) -> DataFrame:
    """Clipped parts of edges in the box from ``write_unclipped``'s table: object_id, seg_no, seq and ends. An edge lies in one segment only, as the closing point of one is the first of the next."""
    rows = ranges.overlapping(table, box)
    return ranges.clip_edges(_steps(rows, "object_id", "seg_no"), {k: F.lit(getattr(box, k)) for k in _SIDES}, keys=("object_id", "seg_no"))


def write_flat(points: DataFrame, path: str, bits: int = 4, dims: int = 2, grid: Grid | None = None) -> DataFrame:
    """Clipped segments in one sorted table instead of directories: row groups alone prune."""
    cut = segment.clipped(points, grid or assemble.grid_of(points, bits, dims)).drop("real")
    cut.repartitionByRange("cell", "mbr_min_t").sortWithinPartitions("cell", "mbr_min_t").write.parquet(path)
    return points.sparkSession.read.parquet(path)


class SegmentTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{self.path}/meta").collect()))
        self.grid = Grid(**meta["grid"])
        self.n_trajectories, self.avg_cells, self.shift = meta["n_trajectories"], meta["avg_cells"], meta["shift"]
        schema = spark.read.parquet(f"{self.path}/segments").schema
        self.segments = spark.read.schema(schema).parquet(f"{self.path}/segments")
        self.trajectories = spark.read.parquet(f"{self.path}/trajectories")

    @classmethod
    def write(cls, points: DataFrame, path: str, bits: int = 4, dims: int = 2, per_directory: int = PER_DIRECTORY) -> SegmentTable:
        """Cuts points (object_id, t, x, y) and stores them, in as many directories as give each ``per_directory`` points on average."""
        spark, path = points.sparkSession, path.rstrip("/")
        grid = assemble.grid_of(points, bits, dims)
        wanted = max(1, points.count() // per_directory).bit_length() - 1
        shift = bits * dims - min(wanted, MAX_DIRECTORIES, bits * dims)
        cut = segment.with_pivots(segment.clipped(points, grid)).drop("real")
        cut = cut.withColumn("dir", F.shiftright("cell", shift).cast("int"))
        # the hint lets a hot directory be written by many tasks and small ones by one
        cut.createOrReplaceTempView("_wayline_cut")
        even = spark.sql("SELECT /*+ REBALANCE(dir) */ * FROM _wayline_cut")
        spark.catalog.dropTempView("_wayline_cut")
        even.sortWithinPartitions("dir", "cell", "mbr_min_t").write.partitionBy("dir").parquet(f"{path}/segments")
        whole = assemble.trajectories(points)
        whole.repartitionByRange("object_id").sortWithinPartitions("object_id").write.parquet(f"{path}/trajectories")
        told = spark.read.parquet(f"{path}/segments").groupBy("object_id").agg(F.countDistinct("cell").alias("n")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("avg")).first()
        meta = json.dumps({"grid": grid.as_dict(), "n_trajectories": told["n"], "avg_cells": told["avg"], "shift": shift})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
        return cls(spark, path)

    # ---------------------------------------------------------------- pruning

    def box_cells(self, box: Box) -> tuple[list[int], list[int]] | None:
        """(border, inner) cells of a box; none outside the data; None if they are too many to list."""
        g = self.grid
        low, high = (box.x0, box.y0, box.t0), (box.x1, box.y1, box.t1)
        if any(h < a or lo > b for (_, a, b), lo, hi in zip(g.axes(), low, high, strict=False) for h in [hi]):
            return [], []
        lo = [g.ordinate(i, v) for i, v in enumerate(low[: g.dims])]
        hi = [g.ordinate(i, v) for i, v in enumerate(high[: g.dims])]
        if np.prod([b - a + 1 for a, b in zip(lo, hi, strict=True)]) > MAX_LISTED:
            return None
        cells = np.array(list(itertools.product(*[range(a, b + 1) for a, b in zip(lo, hi, strict=True)])))
        border = ((cells == lo) | (cells == hi)).any(1)
        number = hilbert.numbers(cells, g.bits)
        return sorted(number[border].tolist()), sorted(number[~border].tolist())

    def near_cells(self, query: np.ndarray, eps: float, edges: bool = False) -> list[int] | None:
        """Cells within eps of a point of the query, or of one of its ``edges`` (in all slices of time); None if they are too many to list."""
        g, found = self.grid, set()
        wide = np.array([(hi - lo) / g.parts for _, lo, hi in g.axes()[:2]])
        origin = np.array([g.x0, g.y0])
        ends = np.stack([query[:-1], query[1:]], 1) if edges and len(query) > 1 else np.stack([query, query], 1)
        for a, b in ends:
            lo = [g.ordinate(i, min(a[i], b[i]) - eps) for i in (0, 1)]
            hi = [g.ordinate(i, max(a[i], b[i]) + eps) for i in (0, 1)]
            if (hi[0] - lo[0] + 1) * (hi[1] - lo[1] + 1) > MAX_LISTED:
                return None
            c = np.stack(np.meshgrid(*[np.arange(p, q + 1) for p, q in zip(lo, hi, strict=True)], indexing="ij"), -1).reshape(-1, 2)
            gap = _path_to_cells(a, b, origin + c * wide, origin + (c + 1) * wide)
            # cells at the rim hold what lies beyond it too
            near = (gap <= eps * (1 + 1e-9) + 1e-12) | (c == 0).any(1) | (c == g.parts - 1).any(1)
            found.update(map(tuple, c[near].tolist()))
            if len(found) > MAX_LISTED:
                return None
        if not 0 < len(found) * (g.parts if g.dims == 3 else 1) <= MAX_LISTED:
            return None
        cells = [(*c, t) for c in found for t in range(g.parts)] if g.dims == 3 else list(found)
        return sorted(hilbert.numbers(np.array(cells), g.bits).tolist())

    def _in_cells(self, rows: DataFrame, cells: list[int] | None) -> DataFrame:
        if cells is None:
            return rows
        dirs = sorted({c >> self.shift for c in cells})
        return rows.where(F.col("dir").isin(dirs)).where(F.col("cell").isin(cells))

    # ---------------------------------------------------------------- queries

    def range(self, box: Box) -> DataFrame:
        """Clipped parts of edges in the box: object_id, seg_no, seq and ends.

        One scan reads border and inner cells. Segments whose box lies inside
        the query's, as those of inner cells do while the time is inside too,
        pass whole; edges of the others are tested and clipped."""
        cells = self.box_cells(box)
        rows = self._in_cells(self.segments, None if cells is None else cells[0] + cells[1])
        sides = {k: F.lit(getattr(box, k)) for k in _SIDES}
        for c, (lo, hi) in {"x": (box.x0, box.x1), "y": (box.y0, box.y1), "t": (box.t0, box.t1)}.items():
            rows = rows.where((F.col(f"mbr_max_{c}") >= lo) & (F.col(f"mbr_min_{c}") <= hi))
        rows = rows.withColumn("_inner", _contained({c: sides[f"{c}0"] for c in "xyt"}, {c: sides[f"{c}1"] for c in "xyt"}))
        return ranges.clip_edges(_steps(rows, "object_id", "seg_no", "_inner"), sides, keys=("object_id", "seg_no"), inner="_inner")

    def points(self, box: Box) -> DataFrame:
        """The original points in the box: object_id, t, x, y, pos."""
        cells = self.box_cells(box)
        rows = self._in_cells(self.segments, None if cells is None else cells[0] + cells[1]).where("first_pos is not null")
        for c, (lo, hi) in {"x": (box.x0, box.x1), "y": (box.y0, box.y1), "t": (box.t0, box.t1)}.items():
            rows = rows.where((F.col(f"core_max_{c}") >= lo) & (F.col(f"core_min_{c}") <= hi))
        each = rows.select("object_id", F.explode("pts").alias("p")).where("p.is_real").select("object_id", "p.t", "p.x", "p.y", "p.pos")
        return ranges.points_in(each, box)

    def candidates(self, query: np.ndarray, eps: float, prune: str = "pivots", edges: bool = False) -> DataFrame:
        """Objects all of whose points may be within eps of the query, from metadata only: no point column is read, but for ``points``.

        prune: ``mbr`` (some of the query is within eps of the box of a segment's
        real points), ``pivots`` or ``points``. ``edges``: cells near the
        query's edges, not its points alone."""
        rows = self._in_cells(self.segments, self.near_cells(query, eps, edges)).where("first_pos is not null")
        lo, hi = query.min(0) - eps, query.max(0) + eps
        rows = rows.where((F.col("core_min_x") >= float(lo[0])) & (F.col("core_max_x") <= float(hi[0])) & (F.col("core_min_y") >= float(lo[1])) & (F.col("core_max_y") <= float(hi[1])))
        asked = similar.cover(query)
        rows = rows.where(F.exists(asked, lambda q: similar.to_box(q, *[F.col(f"core_{s}_{c}") for s in ("min", "max") for c in "xy"]) <= eps))

        def near(p: Column) -> Column:
            return F.exists(asked, lambda q: similar.to_box(q, p["x"], p["y"], p["x"], p["y"]) <= eps)

        if prune == "pivots":
            rows = rows.where(F.forall("pivots", near))
        elif prune == "points":
            rows = rows.where(F.forall("pts", lambda p: ~p["is_real"] | near(p)))
        elif prune != "mbr":
            raise ValueError(prune)
        return segment.complete(rows.select("object_id", "first_pos", "last_pos", "n_total")).select("object_id")

    def similar(self, query: np.ndarray, eps: float, prune: str = "pivots", window: tuple[int, int] | None = None, edges: bool = False) -> DataFrame:
        """(object_id, score) within Frechet distance eps: candidates from metadata, then their whole trajectories; ``window`` keeps those whole inside a time range."""
        ids = self.candidates(query, eps, prune, edges).withColumnRenamed("object_id", "_id")
        whole = self.trajectories.join(ids, F.col("object_id") == F.col("_id"), "left_semi")
        return similar.within(whole, query, eps, window=window)

    def range_batch(self, boxes: DataFrame) -> DataFrame:
        """Clipped parts of edges for many boxes (qid, x0, y0, t0, x1, y1, t1): qid, object_id, seg_no, seq and ends.

        Boxes go to the cells that they cover and meet the segments on them, so
        Spark reads only the directories that any box needs (dynamic pruning)."""
        g = self.grid
        q = {c: F.col(f"q_{c}") for c in ("x0", "y0", "t0", "x1", "y1", "t1")}
        asked = boxes.select("qid", *[F.col(c).alias(f"q_{c}") for c in q])
        for (c, low, high), name in zip(g.axes(), ("gx", "gy", "gt"), strict=False):
            asked = asked.where((q[f"{c}1"] >= low) & (q[f"{c}0"] <= high))
        for i, ((c, _, _), name) in enumerate(zip(g.axes(), ("gx", "gy", "gt"), strict=False)):
            span = F.sequence(ordinate(q[f"{c}0"].cast("double"), g, i), ordinate(q[f"{c}1"].cast("double"), g, i))
            asked = asked.withColumn(name, F.explode(span))
        asked = hilbert.with_number(asked, ["gx", "gy", "gt"][: g.dims], g.bits, "q_cell").withColumn("q_dir", F.shiftright("q_cell", self.shift).cast("int"))
        met = self.segments.join(asked.drop("gx", "gy", "gt"), (F.col("dir") == F.col("q_dir")) & (F.col("cell") == F.col("q_cell")))
        for c in ("x", "y", "t"):
            met = met.where((F.col(f"mbr_max_{c}") >= q[f"{c}0"]) & (F.col(f"mbr_min_{c}") <= q[f"{c}1"]))
        met = met.withColumn("_inner", _contained({c: q[f"{c}0"] for c in "xyt"}, {c: q[f"{c}1"] for c in "xyt"}))
        return ranges.clip_edges(_steps(met, "qid", "object_id", "seg_no", "_inner", *[f"q_{c}" for c in q]), q, keys=("qid", "object_id", "seg_no"), inner="_inner")

    def similar_batch(self, queries: DataFrame, eps: float, window: tuple[int, int] | None = None) -> DataFrame:
        """(qid, object_id, score) within Frechet distance eps for many queries (qid, pts) at once.

        Queries go to the cells near their points and meet segment metadata by an
        equi-join on cells (coarser ones for a large eps); boxes, pivots and
        completeness leave pairs of ids, and only those meet whole trajectories."""
        g = self.grid
        wide = min((hi - lo) / g.parts for _, lo, hi in g.axes()[:2])
        coarse = 0
        while coarse < g.bits and (2 * eps / (wide * (1 << coarse)) + 2) ** 2 * (g.parts >> coarse if g.dims == 3 else 1) > MAX_SPREAD:
            coarse += 1
        spans = [F.sequence(*[F.shiftright(ordinate(F.col(f"q.{c}") + d, g, i), coarse) for d in (-eps, eps)]) for i, c in enumerate("xy")]
        spread = queries.select("qid", F.explode("pts").alias("q"))
        for name, span in zip(("gx", "gy"), spans, strict=True):
            spread = spread.withColumn(name, F.explode(span))
        spread = spread.select("qid", "gx", "gy").distinct()
        if g.dims == 3:
            spread = spread.withColumn("gt", F.explode(F.sequence(F.lit(0), F.lit((g.parts - 1) >> coarse))))
        names = ["gx", "gy", "gt"][: g.dims]
        # a coarse cell's number is the beginning of those of its cells
        spread = hilbert.with_number(spread, names, g.bits - coarse, "q_cell").select("qid", "q_cell")
        side = {f"{n}_{c}": f(F.transform("pts", segment.field(c))) for c in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))}
        asked = queries.select("qid", "pts").withColumns(side).select("qid", F.col("pts").alias("q_pts"), *[F.col(c).alias(f"q_{c}") for c in side])
        rows = self.segments.where("first_pos is not null").select("object_id", "dir", "cell", "first_pos", "last_pos", "n_total", "pivots", *[f"core_{n}_{c}" for n in ("min", "max") for c in "xy"])
        on = F.shiftright("cell", coarse * g.dims) == F.col("q_cell")
        if coarse * g.dims <= self.shift:  # whole directories drop out
            on = on & (F.col("dir") == F.shiftright("q_cell", self.shift - coarse * g.dims).cast("int"))
        met = rows.join(spread, on).join(asked, "qid")
        for c in "xy":
            met = met.where((F.col(f"core_min_{c}") >= F.col(f"q_min_{c}") - eps) & (F.col(f"core_max_{c}") <= F.col(f"q_max_{c}") + eps))
        met = met.where(F.forall("pivots", lambda p: F.exists("q_pts", lambda q: distance(p["x"], p["y"], q["x"], q["y"]) <= eps)))
        seen = met.groupBy("qid", "object_id").agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n"), F.max("n_total").alias("n_total"))
        pairs = seen.where("n = n_total").select("qid", "object_id")
        whole = self.trajectories
        if window:
            whole = whole.where((F.col("min_t") >= window[0]) & (F.col("max_t") <= window[1]))
        both = whole.select("object_id", "pts").join(pairs, "object_id").join(asked.select("qid", "q_pts"), "qid")
        ends = [distance(F.element_at("pts", at)["x"], F.element_at("pts", at)["y"], F.element_at("q_pts", at)["x"], F.element_at("q_pts", at)["y"]) <= eps for at in (1, -1)]
        return similar.score(both.where(ends[0] & ends[1]), None, eps)

    def nearest(self, query: np.ndarray, k: int, window: tuple[int, int] | None = None) -> DataFrame:
        """The k trajectories of least Frechet distance, ties by id; ``window`` keeps those whole inside a time range.

        The search grows by cells: the radius begins at a cell's width and doubles
        until k trajectories lie within it, each time reading the metadata of the
        cells that it reaches, then the candidates' points. All nearer ones lie
        within it too, so the best k are the answer. The driver holds k rows. A
        query far from all data has its radius begin where the grid does."""
        g = self.grid
        axes = g.axes()[:2]
        corners = np.array(list(itertools.product(*[(lo, hi) for _, lo, hi in axes])))
        reach = float(np.sqrt(((query[:, None, :] - corners[None]) ** 2).sum(2)).max()) * (1 + 1e-9)
        away = max(max(lo - query[:, i].min(), query[:, i].max() - hi, 0.0) for i, (_, lo, hi) in enumerate(axes))
        eps = float(away) + min((hi - lo) / g.parts for _, lo, hi in axes)
        kinds = similar.within(self.trajectories, query, eps).schema
        while True:
            best = self.similar(query, min(eps, reach), window=window).orderBy("score", "object_id").limit(k).collect()
            if len(best) >= k or eps >= reach:
                return self.spark.createDataFrame(best, kinds)
            eps *= 2
