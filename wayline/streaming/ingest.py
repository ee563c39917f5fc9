"""Points as they arrive, appended to a table that the batch operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_points(points: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Writes a stream of points (object_id, ts, t, x, y), each once: copies that come within ``late`` of each other are dropped. Ends when all that is there is written."""
    once = points.withWatermark("ts", late).dropDuplicatesWithinWatermark(["object_id", "t", "x", "y"]).drop("ts")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
