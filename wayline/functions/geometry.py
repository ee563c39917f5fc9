"""Planar geometry as column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Box, Grid


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def distance(ax, ay, bx, by) -> Column:
    dx, dy = lit(ax) - lit(bx), lit(ay) - lit(by)
    return F.sqrt(dx * dx + dy * dy)


def in_box(x, y, t, box: Box) -> Column:
    """Closed on all sides."""
    return x.between(box.x0, box.x1) & y.between(box.y0, box.y1) & t.between(box.t0, box.t1)


def in_rectangle(x, y, x0, y0, x1, y1) -> Column:
    """Closed below, open above."""
    return (lit(x) >= lit(x0)) & (lit(x) < lit(x1)) & (lit(y) >= lit(y0)) & (lit(y) < lit(y1))


def in_window(t, t0, t1) -> Column:
    return lit(t).between(lit(t0), lit(t1))


def intervals_meet(a0, a1, b0, b1) -> Column:
    return (lit(a1) >= lit(b0)) & (lit(a0) <= lit(b1))


def boxes_meet(lows: list, highs: list, box: Box) -> Column:
    """Bounding boxes given by columns (x, y and perhaps t) against a box."""
    pairs = zip(lows, highs, ((box.x0, box.x1), (box.y0, box.y1), (box.t0, box.t1)), strict=False)
    return reduce(lambda a, b: a & b, [intervals_meet(lo, hi, *b) for lo, hi, b in pairs])


def time_at(x, ax, at, bx, bt) -> Column:
    """The time at which a straight move from (ax, at) to (bx, bt) passes x, cut to whole ms before adding."""
    return lit(at) + ((lit(bt) - lit(at)) / (lit(bx) - lit(ax)) * (lit(x) - lit(ax))).cast("bigint")


def segments_cross(a, b, c, d) -> Column:
    """The point where segments ab and cd meet, as struct(x, y), or null; parallel segments have none. Points: (x, y) columns."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    rx, ry, sx, sy = lit(bx) - lit(ax), lit(by) - lit(ay), lit(dx) - lit(cx), lit(dy) - lit(cy)
    across = rx * sy - ry * sx
    u = F.when(across != 0, ((lit(cx) - lit(ax)) * sy - (lit(cy) - lit(ay)) * sx) / across)
    v = F.when(across != 0, ((lit(cx) - lit(ax)) * ry - (lit(cy) - lit(ay)) * rx) / across)
    return F.when(u.between(0, 1) & v.between(0, 1), F.struct((lit(ax) + u * rx).alias("x"), (lit(ay) + u * ry).alias("y")))


def segments_meet(a, b, c, d, touching: bool = True) -> Column:
    """Whether ab meets cd; with ``touching`` off, a meeting at an end of ab does not count."""
    p = segments_cross(a, b, c, d)
    met = p.isNotNull()
    if touching:
        return met
    at_end = ((p["x"] == lit(a[0])) & (p["y"] == lit(a[1]))) | ((p["x"] == lit(b[0])) & (p["y"] == lit(b[1])))
    return F.coalesce(met & ~at_end, F.lit(False))


def clip(start: list[Column], end: list[Column], low: list, high: list) -> tuple[Column, Column, Column]:
    """(meets, u1, u2): the share of a straight move that lies in a closed box, of as many axes as are given."""
    enters, leaves, inside = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for a, b, lo, hi in zip(start, end, low, high, strict=True):
        d = (b - a).cast("double")
        p, q = (lit(lo) - a).cast("double"), (lit(hi) - a).cast("double")
        enters.append(F.when(d == 0, 0.0).otherwise(F.least(p / d, q / d)))
        leaves.append(F.when(d == 0, 1.0).otherwise(F.greatest(p / d, q / d)))
        inside = inside & ((d != 0) | ((p <= 0) & (q >= 0)))
    u1, u2 = F.greatest(*enters), F.least(*leaves)
    return inside & (u1 <= u2), u1, u2


def between(a: Column, b: Column, u: Column, whole: bool = False, rounded: bool = False) -> Column:
    """The value at share u of the way from a to b; the ends exactly. ``whole``: cut to an integer, or ``rounded``."""
    v = a + u * (b - a)
    if whole:
        v = F.floor(v + 0.5).cast("bigint") if rounded else v.cast("bigint")
    return F.when(u == 0, a).when(u == 1, b).otherwise(v)


def point_to_rectangle(x, y, x0, y0, x1, y1) -> Column:
    """0 inside."""
    dx = F.greatest(lit(x0) - lit(x), F.lit(0.0), lit(x) - lit(x1))
    dy = F.greatest(lit(y0) - lit(y), F.lit(0.0), lit(y) - lit(y1))
    return F.sqrt(dx * dx + dy * dy)


def point_to_segment(x, y, ax, ay, bx, by) -> Column:
    dx, dy = lit(bx) - lit(ax), lit(by) - lit(ay)
    square = dx * dx + dy * dy
    u = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lit(x) - lit(ax)) * dx + (lit(y) - lit(ay)) * dy) / square)))
    return distance(x, y, lit(ax) + u * dx, lit(ay) + u * dy)


def segment_to_rectangle(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """The least distance of ends to the rectangle and of corners to the segment; segments that cross it are to be tested with ``clip`` first."""
    ends = [point_to_rectangle(ax, ay, x0, y0, x1, y1), point_to_rectangle(bx, by, x0, y0, x1, y1)]
    corners = [point_to_segment(cx, cy, ax, ay, bx, by) for cx in (x0, x1) for cy in (y0, y1)]
    return F.least(*ends, *corners)


def rectangle_to_rectangle(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    dx = F.greatest(lit(bx0) - lit(ax1), F.lit(0.0), lit(ax0) - lit(bx1))
    dy = F.greatest(lit(by0) - lit(ay1), F.lit(0.0), lit(ay0) - lit(by1))
    return F.sqrt(dx * dx + dy * dy)


def min_max_distance(x, y, x0, y0, x1, y1) -> Column:
    """MINMAXDIST of R-trees: within it some object of a tight bounding box must lie."""
    x, y, x0, y0, x1, y1 = (lit(v) for v in (x, y, x0, y0, x1, y1))
    near = lambda v, lo, hi: F.when(v <= (lo + hi) / 2, lo).otherwise(hi)
    far = lambda v, lo, hi: F.when(v >= (lo + hi) / 2, lo).otherwise(hi)
    sq = lambda v: v * v
    one = sq(x - near(x, x0, x1)) + sq(y - far(y, y0, y1))
    two = sq(y - near(y, y0, y1)) + sq(x - far(x, x0, x1))
    return F.sqrt(F.least(one, two))


# --------------------------------------------------- over arrays of points


def any_edge(points: Column, test) -> Column:
    """Whether ``test(a, b)`` holds for an edge of consecutive points."""
    n = F.size(points)
    edges = F.arrays_zip(F.slice(points, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.exists(edges, lambda e: test(e["a"], e["b"]))


def crosses_rectangle(points: Column, x0, y0, x1, y1) -> Column:
    return any_edge(points, lambda a, b: clip([a["x"], a["y"]], [b["x"], b["y"]], [x0, y0], [x1, y1])[0])


def within_of_rectangle(points: Column, eps: float, x0, y0, x1, y1) -> Column:
    """Whether an edge lies within eps of a rectangle."""

    def test(a, b):
        met = clip([a["x"], a["y"]], [b["x"], b["y"]], [x0, y0], [x1, y1])[0]
        return met | (segment_to_rectangle(a["x"], a["y"], b["x"], b["y"], x0, y0, x1, y1) <= eps)

    return any_edge(points, test)


def points_within_of_rectangle(points: Column, eps: float, x0, y0, x1, y1) -> Column:
    return F.exists(points, lambda p: point_to_rectangle(p["x"], p["y"], x0, y0, x1, y1) <= eps)


def trajectory_to_rectangle(points: Column, x0, y0, x1, y1) -> Column:
    return F.array_min(F.transform(points, lambda p: point_to_rectangle(p["x"], p["y"], x0, y0, x1, y1)))


def trajectory_min_max(points: Column, x0, y0, x1, y1) -> Column:
    return F.array_min(F.transform(points, lambda p: min_max_distance(p["x"], p["y"], x0, y0, x1, y1)))


def farther_than(points: Column, eps: float, x, y) -> Column:
    """No point of the trajectory is within eps of (x, y)."""
    return ~F.exists(points, lambda p: distance(p["x"], p["y"], x, y) <= eps)


def min_max_greater(points: Column, eps: float, x0, y0, x1, y1) -> Column:
    return trajectory_min_max(points, x0, y0, x1, y1) > eps


# ------------------------------------------------------------------- grid


def ordinate(value: Column, grid: Grid, axis: int) -> Column:
    _, low, high = grid.axes()[axis]
    return F.greatest(F.lit(0), F.least(F.lit(grid.parts - 1), F.floor((value - F.lit(low)) / F.lit(high - low) * grid.parts))).cast("int")


def ordinates(point: dict[str, Column], grid: Grid) -> list[Column]:
    return [ordinate(point[name].cast("double"), grid, i) for i, (name, _, _) in enumerate(grid.axes())]
