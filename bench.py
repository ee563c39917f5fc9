"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (8).
Each query runs BENCH_RUNS times (2) after a warm-up on the session; the best
counts. ``table_write`` is the cost of the stored index; the queries on it are
timed without it, beside their unindexed twins."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession


PER_DIRECTORY = 5_000  # points on average, so that the index has directories to prune at this size


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    shared = tempfile.mkdtemp(prefix="wayline-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from wayline import queries as q
    from wayline.operators import assemble, range as ranges, similar
    from wayline.plans.metrics import measure
    from wayline.plans.table import SegmentTable

    def timed(run) -> float:
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        return round(best, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    try:
        drain(q.traj_points(spark, sf_dir))
        out: dict[str, float] = {}
        names = ["traj_assemble", "edge_list", "cell_occupancy", "hilbert_index_2d", "segment_by_cell", "segment_clip_2d", "range_points", "range_clip", "range_clip_concat", "range_batch", "frechet_threshold", "frechet_batch", "knn_brute"]
        for name in names:
            out[name] = timed(lambda name=name: drain(q.queries()[name](spark, sf_dir)))
        began = time.perf_counter()
        table = SegmentTable.write(q.points(spark, sf_dir), f"file://{shared}/table", bits=4, dims=2, per_directory=PER_DIRECTORY)
        out["table_write"] = round(time.perf_counter() - began, 3)
        query = similar.query_points(table.trajectories, q.QUERY_USER)
        whole = assemble.trajectories(q.points(spark, sf_dir))
        out["indexed_range"] = timed(lambda: drain(table.range(q.BOX)))
        out["indexed_points"] = timed(lambda: drain(table.points(q.BOX)))
        out["indexed_frechet"] = timed(lambda: drain(table.similar(query, q.EPS)))
        out["indexed_knn"] = timed(lambda: drain(table.nearest(query, q.K)))
        out["unindexed_frechet"] = timed(lambda: drain(similar.within(whole, query, q.EPS, prune=False)))
        cost = {"range": measure(table.range(q.BOX)), "unindexed_range": measure(ranges.clipped(q.points(spark, sf_dir), q.BOX)), "points": measure(table.points(q.BOX)), "frechet": measure(table.similar(query, q.EPS)), "unindexed_frechet": measure(similar.within(table.trajectories, query, q.EPS, prune=False))}
        print(json.dumps({"scans": {k: v.as_dict() for k, v in cost.items()}, "segments": table.segments.count()}), file=sys.stderr)
        print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    finally:
        spark.stop()
        shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
