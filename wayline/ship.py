"""Makes the package importable in Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH, _LARGE = "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b", "67108864")


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once a Spark application.

    The archive is made on the driver and served by Spark itself, so nothing
    needs to be installed on the executors. Also bounds the Arrow batches that
    workers get: by default one may hold 64 MB, several times over."""
    if spark.conf.get(_BATCH, None) in _LARGE:
        spark.conf.set(_BATCH, str(4 << 20))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wayline-")) / "wayline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
