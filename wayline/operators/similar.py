"""Discrete Frechet similarity: threshold queries and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, rectangle_to_rectangle
from ..schema import POINTS
from ..ship import ship

Point = tuple[float, float]
MAX_COVER = 64  # boxes that stand for a query's points in a plan


def frechet(a: np.ndarray, b: np.ndarray, stop: float = np.inf) -> float:
    """Discrete Frechet distance of two rows of (x, y) points; infinite once it is known to exceed ``stop``.

    The table is filled by anti-diagonals, so each step is one vector operation,
    and holds three of them, whatever the lengths."""
    n, m = len(a), len(b)

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dx, dy = a[i, 0] - b[j, 0], a[i, 1] - b[j, 1]
        return np.sqrt(dx * dx + dy * dy)

    if apart(np.array([0, n - 1]), np.array([0, m - 1])).max() > stop:
        return np.inf
    before, older = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n - 1, s)
        now = np.full(n + 1, np.inf)
        rows = np.arange(lo, hi + 1)
        here = apart(rows, s - rows)
        if s == 0:
            now[1] = here[0]
        else:
            best = np.minimum(np.minimum(before[rows + 1], before[rows]), older[rows])
            now[rows + 1] = np.maximum(best, here)
        if min(now.min(), before.min()) > stop:
            return np.inf
        older, before = before, now
    return float(before[n])


def _xy(points: pa.ListScalar) -> np.ndarray:
    flat = points.values
    return np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], 1)


def _scored(queries: dict[int, np.ndarray] | None, stop: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pts, qid = batch.column("pts"), batch.column("qid").to_pylist()
            asked = [queries[q] for q in qid] if queries else [_xy(p) for p in batch.column("q_pts")]
            score = [frechet(q, _xy(p), stop) for q, p in zip(asked, pts, strict=True)]
            keep = pa.array([s <= stop for s in score], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("object_id"), pa.array(score, pa.float64())], names=["qid", "object_id", "score"])
            yield out.filter(keep)

    return run


def score(rows: DataFrame, queries: dict[int, np.ndarray] | None = None, stop: float = np.inf) -> DataFrame:
    """(qid, object_id, score) of rows (qid, object_id, pts), or with ``q_pts`` where the queries are not given; only scores up to ``stop``."""
    ship(rows.sparkSession)
    columns = ["qid", "object_id", "pts"] + ([] if queries else ["q_pts"])
    kind = rows.schema["object_id"].dataType.simpleString()
    return rows.select(*columns).mapInArrow(_scored(queries, stop), f"qid {rows.schema['qid'].dataType.simpleString()}, object_id {kind}, score double")


def _first_last(points: Column) -> tuple[Column, Column]:
    return F.element_at(points, 1), F.element_at(points, -1)


def _ends_near(query: np.ndarray, eps: float) -> Column:
    """Both ends within eps: needed for a Frechet distance of at most eps, and cheap."""
    a, b = _first_last(F.col("pts"))
    return (distance(a["x"], a["y"], *map(float, query[0])) <= eps) & (distance(b["x"], b["y"], *map(float, query[-1])) <= eps)


def cover(query: np.ndarray) -> Column:
    """The query as an array of at most ``MAX_COVER`` boxes of consecutive points, so that a plan's size does not grow with it.

    What is within eps of a point is within eps of its box: tests on boxes may keep more than tests on points, never less. Short queries have a box a point."""
    runs = [r for r in np.array_split(query, min(len(query), MAX_COVER)) if len(r)]
    sides = ("x0", "y0", "x1", "y1")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(sides, (*r.min(0), *r.max(0)), strict=True)]) for r in runs])


def to_box(q: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The distance of a box of ``cover`` to a rectangle."""
    return rectangle_to_rectangle(q["x0"], q["y0"], q["x1"], q["y1"], x0, y0, x1, y1)


def lower_bound(query: np.ndarray) -> Column:
    """No trajectory is nearer than: every query point must come near the bounding box. Uses only plain columns."""
    return F.array_max(F.transform(cover(query), lambda q: to_box(q, F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))))


def within(trajectories: DataFrame, query: np.ndarray, eps: float, prune: bool = True, window: tuple[int, int] | None = None) -> DataFrame:
    """(object_id, score) of the trajectories within Frechet distance eps of the query; ``window`` keeps those whole inside a time range."""
    rows = trajectories
    if window:
        rows = rows.where((F.col("min_t") >= window[0]) & (F.col("max_t") <= window[1]))
    if prune:
        lo, hi = query.min(0) - eps, query.max(0) + eps
        # all points of an answer are near some query point, so its box lies in the query's, widened
        rows = rows.where((F.col("min_x") >= float(lo[0])) & (F.col("max_x") <= float(hi[0])) & (F.col("min_y") >= float(lo[1])) & (F.col("max_y") <= float(hi[1])))
        rows = rows.where(_ends_near(query, eps))
    return score(rows.withColumn("qid", F.lit(0)), {0: query}, eps).select("object_id", "score")


def within_batch(trajectories: DataFrame, queries: DataFrame, eps: float, cell: float) -> DataFrame:
    """(qid, object_id, score) for many queries (qid, pts) at once.

    An answer starts within eps of where the query starts, so starts meet by an
    equi-join on squares of side ``cell``: the query's go to all squares that eps
    reaches. Ends are compared before the kernel runs."""
    a, b = _first_last(F.col("pts"))
    square = lambda v: F.floor(v / cell).cast("bigint")
    there = trajectories.select("object_id", "pts", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")).withColumn("sx", square(F.col("ax"))).withColumn("sy", square(F.col("ay")))
    asked = queries.select("qid", F.col("pts").alias("q_pts"), a["x"].alias("q_ax"), a["y"].alias("q_ay"), b["x"].alias("q_bx"), b["y"].alias("q_by"))
    asked = asked.withColumn("sx", F.explode(F.sequence(square(F.col("q_ax") - eps), square(F.col("q_ax") + eps))))
    asked = asked.withColumn("sy", F.explode(F.sequence(square(F.col("q_ay") - eps), square(F.col("q_ay") + eps))))
    near = (distance(F.col("ax"), F.col("ay"), F.col("q_ax"), F.col("q_ay")) <= eps) & (distance(F.col("bx"), F.col("by"), F.col("q_bx"), F.col("q_by")) <= eps)
    return score(there.join(asked, ["sx", "sy"]).where(near), None, eps)


def nearest_brute(trajectories: DataFrame, query: np.ndarray, k: int) -> DataFrame:
    """The k trajectories of least Frechet distance, ties by id: all are scored."""
    return score(trajectories.withColumn("qid", F.lit(0)), {0: query}).select("object_id", "score").orderBy("score", "object_id").limit(k)


def nearest(trajectories: DataFrame, query: np.ndarray, k: int) -> DataFrame:
    """The same by two rounds: a lower bound from bounding boxes and ends orders the trajectories; the best few give a radius, and all within it are scored.

    The driver holds the few ids and one radius."""
    a, b = _first_last(F.col("pts"))
    ends = F.greatest(distance(a["x"], a["y"], *map(float, query[0])), distance(b["x"], b["y"], *map(float, query[-1])))
    bounded = trajectories.withColumn("bound", F.greatest(lower_bound(query), ends)).withColumn("qid", F.lit(0))
    # ids alone are sorted; points are read for those chosen
    seeds = bounded.select(F.col("object_id").alias("_id"), "bound").orderBy("bound", "_id").limit(4 * k)
    seeds = bounded.join(F.broadcast(seeds.select("_id")), F.col("object_id") == F.col("_id"), "left_semi")
    radius = score(seeds, {0: query}).agg(F.sort_array(F.collect_list("score")).alias("s")).select(F.try_element_at("s", F.lit(k)).alias("r")).first()["r"]
    near = bounded if radius is None else bounded.where(F.col("bound") <= radius)
    return score(near, {0: query}, np.inf if radius is None else radius).select("object_id", "score").orderBy("score", "object_id").limit(k)


def query_points(trajectories: DataFrame, object_id) -> np.ndarray:
    """The (x, y) points of one trajectory, to ask with."""
    row = trajectories.where(F.col("object_id") == object_id).select(F.col("pts").cast(POINTS).alias("pts")).first()
    if row is None:
        raise ValueError(f"no trajectory {object_id}")
    return np.array([(p["x"], p["y"]) for p in row["pts"]])
