"""SQL names: estimate_tokens(text), plan_chunks(text, max_tokens), and the table function chunks(text, max_tokens)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.chunks import SPAN_TYPE, _planned, plan
from .shipping import ship


class Chunks:
    """A row for each chunk of a text: its place, share of new text, and text. None for a null text."""

    def eval(self, text: str, max_tokens: int) -> Iterator[tuple[int, int, int, float, str]]:
        if text is not None and max_tokens is not None:
            for idx, (start, end, weight) in enumerate(plan(text, max_tokens)):
                yield idx, start, end, weight, text[start:end]


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udf.register("plan_chunks", F.arrow_udf(_planned, SPAN_TYPE))
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="idx int, start int, end int, weight double, state string", useArrow=True))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(text STRING) RETURNS BIGINT RETURN ceil(octet_length(text) / 3.0D)")
