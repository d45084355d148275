"""Deciding: one question about every text of a DataFrame.

The model is a transport: a function of columns (chunk text to raw answer), which stays in the plan and
needs no shuffle, or a remote call run on executors. Cheap gates come before planning and asking.
"""

from __future__ import annotations

import inspect
import os
import threading
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DecideError, invalid
from ..functions.answers import malformed, read_answer
from ..functions.text import estimate_tokens, let, nonblank, size_gate, token_count
from ..plans.chunks import SPAN_TYPE, chunk_text, plan_chunks
from ..question import MIN_CHUNK_TOKENS, chunk_tokens, is_blank, validate_question
from ..shipping import ship
from ..sources.http import HttpTransport
from .ask import TIMEOUT_S, Run
from .combine import agreement, combine, public

MAX_INPUT_TOKENS = 250_000
API_KEY = "SPANWISE_API_KEY"
ANSWER_TYPE = "struct<start:int,end:int,weight:double,value:double,label:string,probs:array<double>,confidence:double>"
USAGE_TYPE = "struct<requests:bigint,input_tokens:bigint,cost_usd:double>"
ERROR_TYPE = "struct<code:string,message:string,chunk:int,status:int>"
#: Columns that ``decide`` works with; a caller's columns of these names step aside meanwhile.
_WORKING = {"_error", "_chunks", "_answer", "_agreement", "_model", "_usage", "_spans", "_read", "_done", "_by_model"}
_OPTIONS = {"question", "combine", "max_input_tokens", "model", "transport", "url", "api_key"}


class ColumnTransport:
    """A model as a column expression: ``function(chunk text)`` gives a raw answer struct."""

    def __init__(self, function, model: str = "column"):
        self.function, self.model = function, model


def prepare(question, combine_how="average", max_input_tokens=MAX_INPUT_TOKENS, model="default", transport=None, url=None, api_key=None):
    """The gates before any input is read, in this order: question, combine, limit, model, transport, question's size."""
    validate_question(question)
    if combine_how not in ("average", "max"):
        raise invalid('combine must be "average" or "max".')
    if combine_how == "max" and question["type"] == "choice":
        raise invalid('Choices can only be averaged: combine="max" needs a score or noul question.')
    if not isinstance(max_input_tokens, int) or isinstance(max_input_tokens, bool) or not 0 < max_input_tokens < 1 << 53:
        raise invalid("max_input_tokens must be a positive integer.")
    if not isinstance(model, str) or is_blank(model):
        raise invalid("model must be a string with some text in it.")
    if transport is None:
        key = api_key if api_key is not None else os.environ.get(API_KEY)
        if not isinstance(key, str) or is_blank(key):
            raise invalid(f"No API key: set {API_KEY}, or pass api_key.")
        if not isinstance(url, str) or not (urlsplit(url).scheme and urlsplit(url).netloc):
            raise invalid("url needs a scheme and a host.")
        transport = HttpTransport(url, key)
    if not callable(transport) and not isinstance(transport, ColumnTransport):
        raise invalid("transport must be a function.")
    return transport, chunk_tokens(question)


def error_of(code: str, message: Column, chunk: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(code).alias("code"), message.alias("message"), (none if chunk is None else chunk).alias("chunk"), none.alias("status"))


def gates(text: Column, max_input_tokens: int, ask_blank: bool = False) -> Column:
    too_large = size_gate(text, max_input_tokens)
    return F.when(text.isNull() if ask_blank else ~nonblank(text), error_of("invalid_request", F.lit("input must be a string with some text in it."))).when(too_large.isNotNull(), error_of("input_too_large", too_large))


def decide(
    df: DataFrame,
    question,
    input_col: str = "text",
    combine_how: str = "average",
    max_input_tokens: int = MAX_INPUT_TOKENS,
    model: str = "default",
    transport=None,
    url: str | None = None,
    api_key: str | None = None,
    on_error: str = "fail",
    max_chunk_tokens: int | None = None,
    timeout: float = TIMEOUT_S,
    output_col: str = "result",
    fallbacks=(),
    ask_blank: bool = False,
) -> DataFrame:
    """``df`` with ``result``: value, label, probs and confidence, the public ``answer``, agreement, chunks, model, usage and error.

    ``on_error``: "fail" fails the job for any failing input; "column" puts the error beside a null
    answer. An answer never comes from a part of an input. ``max_chunk_tokens`` overrides the budget.
    All columns of ``df`` stay, whatever their names; ``output_col`` must not be one of them. ``fallbacks``: further
    (model, function) pairs that only chunks go to which the one before has failed; ``result.by_model`` then holds
    the chunks that each answered and its usage. ``ask_blank``: also asks about texts that are empty or nothing but
    white space, which are errors otherwise; nulls stay errors.
    """
    fallbacks = _checked(fallbacks, transport)
    transport, budget = prepare(question, combine_how, max_input_tokens, model, transport, url, api_key)
    budget = max_chunk_tokens or budget
    if on_error not in ("fail", "column"):
        raise invalid('on_error must be "fail" or "column".')
    if output_col.lower() in {c.lower() for c in df.columns}:
        raise invalid(f'There is a column "{output_col}" already: pass another output_col.')
    ship(df.sparkSession)
    aside = {c: f"_aside_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in _WORKING}
    df, input_col = df.withColumnsRenamed(aside), aside.get(input_col, input_col)
    rows = df.withColumn("_error", gates(F.col(input_col), max_input_tokens, ask_blank))
    if isinstance(transport, ColumnTransport):
        rows = _by_column(rows, question, input_col, transport, budget)
    else:
        rows = _by_calls(rows, question, input_col, transport, model, budget, timeout, fallbacks)
    none = F.lit(None)
    ok = F.col("_error").isNull()
    chunks = F.col("_chunks")
    out = F.struct(
        F.lit(question["type"]).alias("type"),
        *[F.when(ok, F.col("_answer")[c]).alias(c) for c in ("value", "label", "probs", "confidence")],
        F.when(ok, public(question, F.col("_answer"))).alias("answer"),
        F.when(ok, F.col("_agreement")).alias("agreement"),
        F.when(ok, chunks).otherwise(none).alias("chunks"),
        F.col("_model").alias("model"),
        F.col("_usage").alias("usage"),
        F.col("_error").alias("error"),
        *([F.col("_by_model").alias("by_model")] if fallbacks else []),
    )
    rows = rows.withColumn("_answer", F.when(ok, combine(question, chunks, combine_how))).withColumn("_agreement", F.when(ok, agreement(question, chunks)))
    if on_error == "fail":
        said = F.concat_ws(": ", F.col("_error.code"), F.col("_error.message"))
        out = F.when(F.col("_error").isNotNull(), F.raise_error(said)).otherwise(out)
    # Filters on the result stay above a generator, so that no answer is computed once more for each mention; those on
    # other columns go below it, down to the scan.
    rows = rows.select("*", F.explode_outer(F.array(out)).alias(output_col)).drop("_error", "_chunks", "_answer", "_agreement", "_model", "_usage", "_by_model")
    return rows.withColumnsRenamed({v: k for k, v in aside.items()})


def _checked(fallbacks, transport) -> tuple:
    out = tuple(fallbacks)
    if out and isinstance(transport, ColumnTransport):
        raise invalid("Fallbacks are for remote models.")
    for one in out:
        if not isinstance(one, tuple) or len(one) != 2 or not isinstance(one[0], str) or is_blank(one[0]) or not callable(one[1]):
            raise invalid("fallbacks must be pairs of a model's name and a function.")
    return out


def result_schema(question) -> T.StructType:
    """The type of ``result`` for a question."""
    validate_question(question)
    fields = {"choice": "choice:string,probabilities:map<string,double>,confidence:double", "score": "score:double,probabilities:map<string,double>,confidence:double", "noul": "noul:double"}
    shown = f"answer struct<{fields[question['type']]}>"
    return T._parse_datatype_string(f"type string, value double, label string, probs array<double>, confidence double, {shown}, agreement double, chunks array<{ANSWER_TYPE}>, model string, usage {USAGE_TYPE}, error {ERROR_TYPE}")


def _by_column(rows: DataFrame, question, input_col: str, transport: ColumnTransport, budget: int) -> DataFrame:
    # Texts that the gates stop aren't planned.
    rows = rows.withColumn("_spans", plan_chunks(F.when(F.col("_error").isNull(), F.col(input_col)), budget))
    one = lambda text: lambda c: let(read_answer(question, transport.function(chunk_text(text, c))), lambda a: F.struct(*[c[n].alias(n) for n in ("start", "end", "weight")], *[a[n].alias(n) for n in ("value", "label", "probs", "confidence", "problem")]))
    rows = rows.withColumn("_read", let(F.col(input_col), lambda text: F.transform("_spans", one(text))))
    bad = F.transform(F.filter(F.transform("_read", lambda c, i: F.struct(i.alias("i"), c["problem"].alias("problem"))), lambda x: x["problem"].isNotNull()), lambda x: x)
    first = F.get(bad, F.lit(0))
    count = F.size("_read").cast("string")
    said = F.concat(F.lit("Chunk "), (first["i"] + 1).cast("string"), F.lit(" of "), count, F.lit(" failed: "), F.concat(F.lit(malformed("\x00").split("\x00")[0]), first["problem"], F.lit(".")))
    rows = rows.withColumn("_error", F.coalesce("_error", F.when(first.isNotNull(), error_of("request_failed", said, first["i"]))))
    chunks = F.transform("_read", lambda c: F.struct(*[c[n].alias(n) for n in ("start", "end", "weight", "value", "label", "probs", "confidence")]))
    usage = F.struct(F.size("_spans").cast("long").alias("requests"), F.lit(0).cast("long").alias("input_tokens"), F.lit(None).cast("double").alias("cost_usd"))
    return rows.withColumns({"_chunks": chunks, "_model": F.lit(transport.model), "_usage": usage}).drop("_spans", "_read")


#: What a remote call's row comes to, in Arrow's types.
_DONE = pa.struct([("chunks", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64()), ("value", pa.float64()), ("label", pa.string()), ("probs", pa.list_(pa.float64())), ("confidence", pa.float64())]))), ("model", pa.string()), ("usage", pa.struct([("requests", pa.int64()), ("input_tokens", pa.int64()), ("cost_usd", pa.float64())])), ("error", pa.struct([("code", pa.string()), ("message", pa.string()), ("chunk", pa.int32()), ("status", pa.int32())]))])


_BY_MODEL = pa.list_(pa.struct([("model", pa.string()), ("chunks", pa.int64()), ("requests", pa.int64()), ("input_tokens", pa.int64()), ("cost_usd", pa.float64())]))


def _by_calls(rows: DataFrame, question, input_col: str, transport, model: str, budget: int, timeout: float, fallbacks=()) -> DataFrame:
    """A scalar function of text and gate: all other columns stay in the JVM."""
    least = min(MIN_CHUNK_TOKENS, budget)
    kind, schema = _DONE, f"chunks:array<{ANSWER_TYPE}>,model:string,usage:{USAGE_TYPE},error:{ERROR_TYPE}"
    if fallbacks:
        kind = pa.struct([*_DONE, ("by_model", _BY_MODEL)])
        schema += ",by_model:array<struct<model:string,chunks:bigint,requests:bigint,input_tokens:bigint,cost_usd:double>>"

    def ask(text: str | None, error) -> dict:
        if error is not None:
            return {"chunks": None, "model": model, "usage": {"requests": 0, "input_tokens": 0, "cost_usd": None}, "error": error}
        run = Run(text, question, transport, model, timeout, fallbacks=fallbacks)
        chunks = problem = None
        try:
            spans, answers = run.decide(budget, least)
            chunks = [{"start": a, "end": b, "weight": w} | x for (a, b, w), x in zip(spans, answers, strict=True)]
        except DecideError as e:
            problem = {"code": e.code, "message": e.message, "chunk": e.chunk, "status": e.status}
        return {"chunks": chunks, "model": run.answered_by(), "usage": {"requests": run.requests, "input_tokens": int(run.input_tokens), "cost_usd": run.cost}, "error": problem, "by_model": run.by_choice}

    def asked(texts: pa.Array, gates: pa.Array) -> pa.Array:
        return pa.array([ask(t.as_py(), g.as_py()) for t, g in zip(texts, gates, strict=True)], kind)

    done = F.arrow_udf(asked, f"struct<{schema}>")
    called = rows.withColumn("_done", done(F.col(input_col), F.col("_error")))
    return called.withColumns({"_chunks": F.col("_done.chunks"), "_model": F.col("_done.model"), "_usage": F.col("_done.usage"), "_error": F.col("_done.error"), **({"_by_model": F.col("_done.by_model")} if fallbacks else {})}).drop("_done")


def _first(rows: DataFrame, cancelled: threading.Event | None) -> Row:
    """The only row; the job ends, and its requests with it, once ``cancelled`` is set."""
    if cancelled is None:
        return rows.first()
    context, tag, out = rows.sparkSession.sparkContext, f"decide-{uuid.uuid4().hex}", []

    def work() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            out.append(rows.first())
        except Exception as error:
            out.append(error)

    job = InheritableThread(target=work, daemon=True, session=rows.sparkSession)
    job.start()
    while job.is_alive():
        if cancelled.wait(0.05):
            # The job may not have begun yet: told again until it ends.
            context.cancelJobsWithTag(tag)
            job.join(0.2)
            if not job.is_alive():
                break
        job.join(0.01)
    if cancelled.is_set():
        raise DecideError("aborted", "Cancelled before it was done.")
    if isinstance(out[0], Exception):
        raise out[0]
    return out[0]


def decide_one(spark: SparkSession, **options) -> Row:
    """One input's result; raises DecideError, naming the first gate that fails."""
    for name in options:
        if name not in _OPTIONS | {"input", "max_chunk_tokens", "cancelled", "timeout"}:
            raise invalid(f'Unknown option "{name}".')
    text, question = options.pop("input", None), options.pop("question", None)
    cancelled: threading.Event | None = options.pop("cancelled", None)
    if not isinstance(text, str) or is_blank(text):
        raise invalid("input must be a string with some text in it.")
    how, limit = options.pop("combine", "average"), options.get("max_input_tokens", MAX_INPUT_TOKENS)
    prepare(question, how, **{k: v for k, v in options.items() if k in inspect.signature(prepare).parameters})
    if (tokens := token_count(text)) > limit:
        raise DecideError("input_too_large", f"The input is about {tokens:,} tokens, over the limit of {limit:,}. Split it, or raise max_input_tokens.")
    if cancelled is not None and cancelled.is_set():
        raise DecideError("aborted", "Cancelled before it was done.")
    frame = spark.createDataFrame([(text,)], "text string")
    result = _first(decide(frame, question, combine_how=how, on_error="column", **options), cancelled)["result"]
    if result["error"] is not None:
        e = result["error"]
        raise DecideError(e["code"], e["message"], e["chunk"], e["status"])
    return result


__all__ = ["API_KEY", "ColumnTransport", "SPAN_TYPE", "decide", "decide_one", "estimate_tokens", "prepare", "result_schema"]
