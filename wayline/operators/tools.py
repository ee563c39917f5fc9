"""Query generators, exports and geometry in well-known binary."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Grid
from ..ship import ship
from ..sources.points import format_trajectory


def random_boxes(spark: SparkSession, grid: Grid, n: int, width: float, height: float, millis: int, seed: int = 1) -> DataFrame:
    """n boxes of one size inside the grid's bounds: qid, x0, y0, t0, x1, y1, t1. The same seed gives the same boxes on any number of machines."""
    width, height, millis = min(width, grid.x1 - grid.x0), min(height, grid.y1 - grid.y0), min(millis, grid.t1 - grid.t0)
    rows = spark.range(n).select(F.col("id").cast("int").alias("qid"))
    x = F.lit(grid.x0) + share(seed, "x") * F.lit(grid.x1 - width - grid.x0)
    y = F.lit(grid.y0) + share(seed, "y") * F.lit(grid.y1 - height - grid.y0)
    t = F.lit(grid.t0) + F.floor(share(seed, "t") * F.lit(float(grid.t1 - millis - grid.t0)))
    rows = rows.withColumns({"x0": x, "y0": y, "t0": t.cast("bigint")})
    return rows.select("*", (F.col("x0") + width).alias("x1"), (F.col("y0") + height).alias("y1"), (F.col("t0") + millis).alias("t1"))


def share(seed: int, what: str) -> Column:
    """A number from 0 to below 1 for each qid: the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("qid").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_trajectories(trajectories: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n trajectories by a hash of id and seed, as lines of a query file: object_id, line."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("object_id").cast("string")))
    chosen = trajectories.select(F.col("object_id").alias("_id"), draw.alias("_draw")).orderBy("_draw", "_id").limit(n)
    kept = trajectories.join(F.broadcast(chosen), F.col("object_id") == F.col("_id"), "left_semi")
    return kept.select("object_id", format_trajectory(F.col("pts")).alias("line"))


# Little-endian mark and geometry type of a three-dimensional line in well-known binary; fixed values.
_LITTLE, _LINE_Z = 1, 1002


def with_wkb(trajectories: DataFrame, name: str = "wkb") -> DataFrame:
    """Trajectories with their points (``pts``) as a line in well-known binary: x, y and the time of each."""
    ship(trajectories.sparkSession)
    return trajectories.withColumn(name, F.arrow_udf(_lines, "binary")(F.col("pts")))


def _lines(points: pa.Array) -> pa.Array:
    made = []
    for line in points:
        if not line.is_valid:
            made.append(None)
            continue
        flat = line.values
        sides = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype("<f8") for c in ("x", "y", "t")], 1)
        made.append(struct.pack("<BII", _LITTLE, _LINE_Z, len(sides)) + sides.tobytes())
    return pa.array(made, pa.binary())


def line_to_wkb(points: list[tuple[float, float, float]]) -> bytes:
    return struct.pack("<BII", _LITTLE, _LINE_Z, len(points)) + b"".join(struct.pack("<ddd", *p) for p in points)


def line_from_wkb(data: bytes) -> list[tuple[float, float, float]]:
    mark, kind, n = struct.unpack_from("<BII", data)
    if mark != _LITTLE or kind != _LINE_Z:
        raise ValueError("not a little-endian line with three coordinates")
    return [struct.unpack_from("<ddd", data, 9 + 24 * i) for i in range(n)]
