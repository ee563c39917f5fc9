"""Points from delimited text, and query files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, id_column: int = 0, x_column: int = 1, y_column: int = 2, time_column: int = 3, time_format: str = "yyyy-MM-dd HH:mm:ss", delimiter: str = ",", on_bad_time: str = "drop") -> DataFrame:
    """object_id, t (epoch ms, the session's zone), x, y of the lines of a text file.

    Rows without an id or coordinates go; times that can't be parsed are dropped
    (``drop``), kept as null (``null``) or an error (``error``)."""
    width = max(id_column, x_column, y_column, time_column) + 1
    raw = spark.read.csv(path, sep=delimiter, schema=", ".join(f"c{i} string" for i in range(width)))
    when = F.unix_millis(F.try_to_timestamp(F.col(f"c{time_column}"), F.lit(time_format)))
    rows = raw.select(F.col(f"c{id_column}").alias("object_id"), when.alias("t"), F.col(f"c{x_column}").try_cast("double").alias("x"), F.col(f"c{y_column}").try_cast("double").alias("y"))
    rows = rows.where("object_id is not null and x is not null and y is not null")
    if on_bad_time == "drop":
        return rows.where("t is not null")
    if on_bad_time == "error":
        return rows.withColumn("t", F.when(F.col("t").isNotNull(), F.col("t")).otherwise(F.raise_error(F.lit("a time can't be parsed"))))
    if on_bad_time != "null":
        raise ValueError(on_bad_time)
    return rows


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """qid, x0, y0, t0, x1, y1, t1 of a file of ``minLon;minLat;minT;maxLon;maxLat;maxT`` lines; qid: the line's place."""
    lines = spark.read.csv(path, sep=";", schema="x0 double, y0 double, t0 bigint, x1 double, y1 double, t1 bigint")
    return lines.select(F.monotonically_increasing_id().alias("qid"), "*")


def parse_trajectory(line: Column) -> Column:
    """An array of points from ``lon,lat,t;lon,lat,t;...``."""
    parts = F.filter(F.split(line, ";"), lambda p: F.trim(p) != "")
    point = lambda p: F.struct(F.split(p, ",")[2].cast("bigint").alias("t"), F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    return F.transform(parts, point)


def _field(c: str):
    return lambda p: p[c]


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """qid, pts and bounding box of a file with a trajectory a line."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("qid"), parse_trajectory(F.col("value")).alias("pts"))
    box = [f(F.transform("pts", _field(c))).alias(f"{n}_{c}") for c in ("x", "y", "t") for n, f in (("min", F.array_min), ("max", F.array_max))]
    return rows.select("qid", "pts", *box)


def format_trajectory(points: Column) -> Column:
    """The line that ``parse_trajectory`` reads."""
    return F.concat(F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"], p["t"])), ";"), F.lit(";"))
