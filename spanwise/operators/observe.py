"""Counters of a run of decisions, gathered while its rows are written or read, without a second pass."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

CODES = ("invalid_request", "input_too_large", "request_failed", "aborted")


def observed(rows: DataFrame, output_col: str = "result") -> tuple[DataFrame, Observation]:
    """(rows as they are, counters): ``counters.get`` is a dict once an action has read all rows.

    inputs, answered, chunks, requests, input_tokens, cost_usd, agreement and confidence (means of answers),
    and errors by code. No text is held.
    """
    r, counters = F.col(output_col), Observation(f"decisions-{uuid.uuid4().hex}")
    code, usage = r["error"]["code"], r["usage"]
    answered = r["error"].isNull()
    counts = [
        F.count(F.lit(1)).alias("inputs"),
        F.count_if(answered).alias("answered"),
        F.coalesce(F.sum(F.when(answered, F.size(r["chunks"]))), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(usage["requests"]), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(usage["input_tokens"]), F.lit(0)).alias("input_tokens"),
        F.sum(usage["cost_usd"]).alias("cost_usd"),
        F.avg(F.when(answered, r["agreement"])).alias("agreement"),
        F.avg(F.when(answered, r["confidence"])).alias("confidence"),
        *[F.count_if(F.coalesce(code == c, F.lit(False))).alias(c) for c in CODES],
    ]
    return rows.observe(counters, *counts), counters
