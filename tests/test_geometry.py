"""Scalar geometry against values worked out by hand."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geometry as g
from wayline.functions import hilbert
from wayline.operators.similar import frechet
from wayline.schema import Box, Grid


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*values):
    return [F.lit(v) for v in values]


def test_distances(spark):
    assert value(spark, g.distance(0.0, 0.0, 3.0, 4.0)) == 5.0
    assert value(spark, g.point_to_rectangle(0.5, 0.5, 0.0, 0.0, 1.0, 1.0)) == 0.0
    assert value(spark, g.point_to_rectangle(4.0, 5.0, 0.0, 0.0, 1.0, 1.0)) == 5.0
    assert value(spark, g.point_to_segment(0.0, 1.0, -1.0, 0.0, 1.0, 0.0)) == 1.0
    assert value(spark, g.point_to_segment(3.0, 4.0, 0.0, 0.0, 0.0, 0.0)) == 5.0
    assert value(spark, g.segment_to_rectangle(*lits(2.0, 2.0, 3.0, 5.0), 0.0, 0.0, 1.0, 1.0)) == pytest.approx(math.sqrt(2))
    assert value(spark, g.rectangle_to_rectangle(*lits(0.0, 0.0, 1.0, 1.0, 4.0, 5.0, 6.0, 6.0))) == 5.0
    assert value(spark, g.min_max_distance(0.0, 0.0, 1.0, 1.0, 2.0, 3.0)) == pytest.approx(math.sqrt(5))


def test_closed_and_half_open(spark):
    assert not value(spark, g.in_rectangle(1.0, 0.0, 0.0, 0.0, 1.0, 1.0))
    assert value(spark, g.in_rectangle(0.0, 0.0, 0.0, 0.0, 1.0, 1.0))
    assert value(spark, g.in_box(F.lit(1.0), F.lit(1.0), F.lit(5), Box(0.0, 0.0, 0, 1.0, 1.0, 5)))
    assert value(spark, g.in_window(5, 0, 5)) and value(spark, g.intervals_meet(0, 1, 1, 2))


def test_segments(spark):
    cross = value(spark, g.segments_cross((0.0, 0.0), (2.0, 2.0), (0.0, 2.0), (2.0, 0.0)))
    assert (cross["x"], cross["y"]) == (1.0, 1.0)
    assert value(spark, g.segments_cross((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))) is None
    touch = ((0.0, 0.0), (1.0, 0.0), (1.0, -1.0), (1.0, 1.0))
    assert value(spark, g.segments_meet(*touch)) and not value(spark, g.segments_meet(*touch, touching=False))
    assert value(spark, g.time_at(0.5, 0.0, 100, 2.0, 103)) == 100


def clipped(spark, a, b, low, high):
    hit, u1, u2 = g.clip(lits(*a), lits(*b), low, high)
    return spark.range(1).select(hit.alias("hit"), u1.alias("u1"), u2.alias("u2")).first()


def test_clip(spark):
    assert tuple(clipped(spark, (0.0, 0.0), (4.0, 0.0), (1.0, -1.0), (3.0, 1.0))) == (True, 0.25, 0.75)
    assert not clipped(spark, (0.0, 2.0), (4.0, 2.0), (1.0, -1.0), (3.0, 1.0))["hit"]
    # a move that only takes time
    assert tuple(clipped(spark, (25.0, 25.0, 25), (25.0, 25.0, 51), (0.0, 0.0, 30), (76.0, 85.0, 97))) == (True, pytest.approx(5 / 26), 1.0)
    # a start exactly on a side stays as it is
    r = clipped(spark, (-2.077968139158168, 49.87955242626847, 1453530800444), (-1.6198933, 50.042137, 1453534739000), (-2.077968139158168, 48.9932022366616, 1452645442462), (-0.5779681391581679, 50.4932022366616, 1455237442462))
    assert tuple(r) == (True, 0.0, 1.0)


def test_clip_of_vessel_edges(spark):
    a, b = (-1.5356, 50.056896, 1448991819000), (-5.9120865, 48.507065, 1449491897000)
    low, high = (-6.076733124375, 48.426718281250004, 1449085501687), (-5.77368330140625, 48.607016875, 1449579601750)
    r = clipped(spark, a, b, low, high)
    x = a[0] + r["u1"] * (b[0] - a[0])
    assert r["hit"] and x == pytest.approx(high[0]) and r["u2"] == 1.0


def test_trajectory_predicates(spark):
    pts = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4)])])
    assert value(spark, g.crosses_rectangle(pts, 1.0, -1.0, 2.0, 1.0))
    assert not value(spark, g.crosses_rectangle(pts, 1.0, 1.0, 2.0, 2.0))
    assert value(spark, g.within_of_rectangle(pts, 1.0, 1.0, 1.0, 2.0, 2.0))
    assert not value(spark, g.points_within_of_rectangle(pts, 1.0, 1.0, 1.0, 2.0, 2.0))
    assert value(spark, g.trajectory_to_rectangle(pts, 1.0, 1.0, 2.0, 2.0)) == pytest.approx(math.sqrt(2))
    assert value(spark, g.farther_than(pts, 0.5, 2.0, 2.0)) and not value(spark, g.min_max_greater(pts, 9.0, 0.0, 0.0, 1.0, 1.0))


def test_grid_and_curve(spark):
    grid = Grid(2, 2, 0.0, 0.0, 0, 100.0, 100.0, 1)
    assert [grid.ordinate(0, v) for v in (0.0, 24.9, 25.0, 100.0, 500.0, -3.0)] == [0, 0, 1, 3, 3, 0]
    assert value(spark, g.ordinate(F.lit(50.0), grid, 1)) == 2
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        h = hilbert.numbers(cells, bits)
        assert sorted(h) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()
        assert (hilbert.cells(h, bits, dims) == cells).all()
        names = ["a", "b", "c"][:dims]
        df = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"{n} int" for n in names))
        got = hilbert.with_number(df, names, bits, "h").collect()
        assert {tuple(r[n] for n in names): r["h"] for r in got} == dict(zip(map(tuple, cells.tolist()), h.tolist(), strict=True))
    runs = hilbert.ranges([1, 2], [5, 6], 4)
    inside = {int(v) for a, b in runs for v in range(a, b + 1)}
    assert inside == set(hilbert.numbers(np.array(list(itertools.product(range(1, 6), range(2, 7)))), 4).tolist())


def test_frechet():
    assert frechet(np.array([(0, 0), (2, 2.0)]), np.array([(0, 1), (0, 2), (2, 2.0)])) == 2.0
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.random((rng.integers(1, 9), 2)), rng.random((rng.integers(1, 9), 2))
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        c = np.full(d.shape, np.inf)
        for i, j in itertools.product(*map(range, d.shape)):
            before = [c[i - 1, j]] * (i > 0) + [c[i, j - 1]] * (j > 0) + [c[i - 1, j - 1]] * (i > 0 and j > 0)
            c[i, j] = max(d[i, j], min(before)) if before else d[0, 0]
        assert frechet(a, b) == pytest.approx(c[-1, -1]) and frechet(b, a) == pytest.approx(c[-1, -1])
        assert frechet(a, a) == 0
        assert frechet(a, b, c[-1, -1] * 0.999) == (np.inf if c[-1, -1] else 0)
