"""Python functions on executors: the package travels with the job, so that executors need no copy installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
#: Rows of an Arrow batch where the session has Spark's default: long texts by the ten thousand don't fit a worker.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once, and keeps Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if getattr(context, "_spanwise_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spanwise-")) / "spanwise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(str(target))
    context._spanwise_shipped = True


def map_in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
