"""What a query cost: time, rows, and what its scans read, from the metrics that Spark keeps for the executed plan."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

# Names of Spark's own metrics of a file scan; fixed values.
_SCAN = {"numFiles": "files", "numPartitions": "directories", "numOutputRows": "rows_scanned", "filesSize": "bytes"}


@dataclass
class Metrics:
    millis: int = 0
    rows: int = 0
    scans: int = 0
    files: int = 0
    directories: int = 0
    rows_scanned: int = 0
    bytes: int = 0

    def as_dict(self) -> dict:
        return asdict(self)


def measure(df: DataFrame) -> Metrics:
    """Runs ``df``'s own plan to its end, keeping no row, and tells what it took."""
    run = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = run.toRdd().count()
    out = Metrics(round((time.perf_counter() - began) * 1000), rows)
    _add(run.executedPlan(), out)
    return out


def _add(node, out: Metrics) -> None:
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _add(node.executedPlan(), out)
    if kind.endswith("QueryStageExec"):
        return _add(node.plan(), out)
    if kind == "ReusedExchangeExec":
        return None
    if kind in ("FileSourceScanExec", "BatchScanExec"):
        out.scans += 1
        for name, to in _SCAN.items():
            found = node.metrics().get(name)
            if found.isDefined():
                setattr(out, to, getattr(out, to) + max(found.get().value(), 0))
    below = node.children()
    for i in range(below.size()):
        _add(below.apply(i), out)
    return None
