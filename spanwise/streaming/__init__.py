"""Decisions over streams: the plan is row-local, so a stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.decide import decide


def decide_stream(stream: DataFrame, question, **options) -> DataFrame:
    """``decide`` over a streaming DataFrame; write it in append mode."""
    return decide(stream, question, **options)


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there now, exactly once, to Parquet at ``path``; returns the rows so far, none if nothing came yet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)
