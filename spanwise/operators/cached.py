"""Deciding with a cache of answers, addressed by content: a chunk that was answered once is never asked about again.

An answer's address is the hash of the chunk's text, below a folder for each question and model. Texts are
planned, their chunks addressed, and one chunk of each address that the cache lacks (a left anti join)
is asked about and appended, in one write job. So a run pays for different new chunks only, whatever
repeats there are within it; what was written survives lost executors and later failures, and a repeated
run asks for the rest. Results are read from the cache, never from the asking job itself.

Inputs whose chunk a model finds too long are planned anew with a smaller budget, all of them in one pass,
as often as a single input would be. Failures are written beside the answers, for this run to report,
and are asked about again by the next.

Requests are counted where they were made: with the smallest (id, chunk) of each address, in the run that
made them; a row that found all its answers counts none.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DecideError, invalid
from ..functions.text import estimate_tokens
from ..plans.chunks import chunk_text, plan_chunks
from ..question import MIN_CHUNK_TOKENS, question_json
from ..shipping import ship
from .ask import CONCURRENCY, MAX_REPLANS, SHRINK, TIMEOUT_S, Run, TooLong
from .combine import agreement, combine, public
from .decide import ANSWER_TYPE, ERROR_TYPE, MAX_INPUT_TOKENS, USAGE_TYPE, ColumnTransport, error_of, gates, prepare

_ANSWER = ("value", "label", "probs", "confidence")
#: The cache's columns below ``asked``, the folder of a question and model. ``owner``: the input that the requests count for; ``problem`` is null for an answer.
STORED = "key string, run string, owner string, value double, label string, probs array<double>, confidence double, model string, requests long, input_tokens long, cost_usd double, problem string, too_long boolean, status int, at double"
_TOLD = pa.struct([("value", pa.float64()), ("label", pa.string()), ("probs", pa.list_(pa.float64())), ("confidence", pa.float64()), ("model", pa.string()), ("requests", pa.int64()), ("input_tokens", pa.int64()), ("cost_usd", pa.float64()), ("problem", pa.string()), ("too_long", pa.bool_()), ("status", pa.int32()), ("at", pa.float64())])


class AnswerCache:
    """A folder of Parquet files that every executor can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def folder(question, model: str) -> str:
        return hashlib.sha256((model + "\n" + question_json(question)).encode()).hexdigest()

    def rows(self, question, model: str) -> DataFrame:
        """All rows of a question and model, failures included; other questions' files are not read."""
        try:
            found = self.spark.read.schema(STORED).parquet(f"{self.path}/asked={self.folder(question, model)}")
            # True of every row. Without it, a plan of two reads, one of them before an append, would do one for both: a
            # scan is told from another by its folder, not by the files that it lists.
            return found.where(F.col("run") != uuid.uuid4().hex)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED)

    def answers(self, question, model: str) -> DataFrame:
        """One answer of each address: the first that was written, if runs at the same time asked twice."""
        good = self.rows(question, model).where("problem is null")
        return good.groupBy("key").agg(F.min(F.struct("at", "run", *_ANSWER, "model")).alias("a")).select("key", "a.*")

    def planned(self, chunks: DataFrame, run: str, attempt: int) -> DataFrame:
        """A run's chunks, written: results read them as long as they are used."""
        path = f"{self.path}/plans/run={run}/{attempt}"
        chunks.write.parquet(path)
        return self.spark.read.schema(chunks.schema).parquet(path)

    def forget_plans(self) -> None:
        """Removes the plans of all runs, whose results can't be read any more; answers stay."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/plans")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def append(self, rows: DataFrame, question, model: str) -> None:
        rows.select(*T._parse_datatype_string(STORED).names).write.mode("append").parquet(f"{self.path}/asked={self.folder(question, model)}")


def chunk_key(text: Column) -> Column:
    """A chunk's address."""
    return F.sha2(text, 256)


def _asking(question, transport, model: str, timeout: float):
    """An Arrow function from chunk texts to what the model said, CONCURRENCY requests at a time."""

    def one(text: str) -> dict:
        run = Run(text, question, transport, model, timeout)
        told = dict.fromkeys(_ANSWER) | {"problem": None, "too_long": False, "status": None}
        try:
            told |= run.ask_all([(0, len(text), 1.0)])[0]
        except TooLong as e:
            told |= {"problem": str(e.cause), "too_long": True, "status": 413}
        except DecideError as e:
            told |= {"problem": e.message.partition(" failed: ")[2] or e.message, "status": e.status}
        return told | {"model": run.answered_by(), "requests": run.requests, "input_tokens": int(run.input_tokens), "cost_usd": run.cost, "at": time.time()}

    def ask(texts: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            return pa.array(list(pool.map(one, texts.to_pylist())), _TOLD)

    kinds = {pa.float64(): "double", pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    return F.arrow_udf(ask, "struct<" + ",".join(f"{f.name}:{kinds.get(f.type, 'array<double>')}" for f in _TOLD) + ">")


def decide_cached(
    df: DataFrame,
    question,
    cache: AnswerCache,
    id_col: str,
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
    max_requests: int | None = None,
    ask_blank: bool = False,
) -> DataFrame:
    """``decide`` over a remote model with a cache. The requests are made at once; the result reads the cache.

    ``id_col``: different for every row and never null, else the rows concerned get an ``invalid_request``.
    ``max_requests``: requests at a time over the whole cluster, CONCURRENCY at least; as many as tasks can run by default.
    ``ask_blank``: as for ``decide``.
    """
    transport, budget = prepare(question, combine_how, max_input_tokens, model, transport, url, api_key)
    if isinstance(transport, ColumnTransport):
        raise invalid("A column transport costs no requests: use decide.")
    if on_error not in ("fail", "column"):
        raise invalid('on_error must be "fail" or "column".')
    if output_col.lower() in {c.lower() for c in df.columns}:
        raise invalid(f'There is a column "{output_col}" already: pass another output_col.')
    spark, budget, run = df.sparkSession, max_chunk_tokens or budget, uuid.uuid4().hex
    least = min(MIN_CHUNK_TOKENS, budget)
    ship(spark)
    inputs = df.select(F.col(id_col).alias("id"), F.col(input_col).alias("text"))
    good = inputs.where(gates(F.col("text"), max_input_tokens, ask_blank).isNull() & F.col("id").isNotNull())
    ask = _asking(question, transport, model, timeout)
    if max_requests is not None and (isinstance(max_requests, bool) or not isinstance(max_requests, int) or max_requests < CONCURRENCY):
        raise invalid(f"max_requests must be a whole number of {CONCURRENCY} or more.")
    # A task asks CONCURRENCY at a time, and there are no more tasks than partitions.
    parts = spark.sparkContext.defaultParallelism if max_requests is None else max_requests // CONCURRENCY
    pending, passes = good.withColumn("budget", F.lit(budget)), []
    for attempt in range(MAX_REPLANS + 1):
        cut = pending.withColumn("s", plan_chunks(F.col("text"), F.col("budget")))
        state = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["weight"].alias("weight"), chunk_key(chunk_text(F.col("text"), s)).alias("key"), estimate_tokens(chunk_text(F.col("text"), s)).alias("tokens"))
        cut = cut.select("id", "budget", F.posexplode(F.transform("s", state)).alias("idx", "c")).select("id", "idx", "budget", "c.*")
        # Planned once, without the texts.
        chunks = cache.planned(cut, run, attempt)
        # One chunk of each address asks for all; texts are joined to those that the cache lacks.
        firsts = chunks.groupBy("key").agg(F.min(F.struct("id", "idx", "start", "end")).alias("f")).select("key", "f.*")
        known = cache.answers(question, model).select("key")
        failed_now = cache.rows(question, model).where((F.col("run") == run) & F.col("problem").isNotNull()).select("key")
        lacking = firsts.join(known, "key", "left_anti").join(failed_now, "key", "left_anti")
        state = chunk_text(F.col("text"), F.struct("start", "end"))
        told = good.join(lacking, "id").select("key", F.col("id").cast("string").alias("owner"), state.alias("state")).repartition(parts, "key")
        told = told.select("key", F.lit(run).alias("run"), "owner", ask("state").alias("t")).select("key", "run", "owner", "t.*")
        cache.append(told, question, model)
        read = cache.answers(question, model)
        failures = cache.rows(question, model).where((F.col("run") == run) & F.col("problem").isNotNull()).select("key", "problem", "too_long", "status")
        joined = chunks.join(read.select("key", *_ANSWER, "model"), "key", "left").join(failures, "key", "left")
        chunk = F.struct("idx", "start", "end", "weight", *_ANSWER, "model", "problem", "too_long", "status", "tokens", "key")
        # An input's chunks are as many as the size gate and the budget allow.
        gathered = joined.groupBy("id", "budget").agg(F.array_sort(F.collect_list(chunk)).alias("c"))
        bad = F.get(F.filter("c", lambda x: x["problem"].isNotNull()), F.lit(0))
        refused = F.get(F.filter("c", lambda x: x["too_long"]), F.lit(0))
        smaller = F.floor(F.least(F.col("budget").cast("long"), refused["tokens"]) * SHRINK).cast("int")
        gathered = gathered.withColumns({"bad": bad, "smaller": F.when(bad["too_long"], smaller)})
        again = F.coalesce(F.col("smaller") >= least, F.lit(False)) & F.lit(attempt < MAX_REPLANS)
        passes.append(gathered.where(~again))
        pending = good.join(gathered.where(again).select("id", F.col("smaller").alias("budget")), "id")
        if attempt == MAX_REPLANS or pending.isEmpty():
            break
    made = cache.rows(question, model).where(F.col("run") == run)
    usage = made.groupBy("owner").agg(*[F.sum(c).alias(c) for c in ("requests", "input_tokens", "cost_usd")])
    done = reduce(DataFrame.union, passes)
    chunks = F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in ("start", "end", "weight", *_ANSWER)]))
    twice = F.size(F.filter("c", lambda x: x["idx"] == 0)) > 1
    count = F.size("c").cast("string")
    reason = F.when(F.col("bad.too_long"), F.lit("The model rejected it as too long, even after shrinking chunks")).otherwise(F.col("bad.problem"))
    said = F.concat(F.lit("Chunk "), (F.col("bad.idx") + 1).cast("string"), F.lit(" of "), count, F.lit(" failed: "), reason)
    failed = F.struct(F.lit("request_failed").alias("code"), said.alias("message"), F.col("bad.idx").alias("chunk"), F.col("bad.status").alias("status"))
    done = done.select("id", chunks.cast(f"array<{ANSWER_TYPE}>").alias("chunks"), F.when(twice, error_of("invalid_request", F.lit("The id column holds an id twice."))).when(F.col("bad").isNotNull(), failed).alias("problem"), F.get("c", F.lit(0))["model"].alias("model"))
    done = done.join(usage, F.col("id").cast("string") == F.col("owner"), "left").select(F.col("id").alias("_of"), F.struct("chunks", "problem", "model", "requests", "input_tokens", "cost_usd").alias("_d"))
    out = df.join(done, F.col(id_col) == F.col("_of"), "left").drop("_of")
    missing = F.when(F.col(id_col).isNull(), error_of("invalid_request", F.lit("The id column holds a null.")))
    rows = out.withColumn("_e", F.coalesce(gates(F.col(input_col), max_input_tokens, ask_blank), missing, F.col("_d.problem")).cast(ERROR_TYPE))
    ok, chunks = F.col("_e").isNull(), F.col("_d.chunks")
    rows = rows.withColumns({"_a": F.when(ok, combine(question, chunks, combine_how)), "_g": F.when(ok, agreement(question, chunks))})
    zero = lambda c: F.coalesce(F.col(f"_d.{c}"), F.lit(0).cast("long")).alias(c)
    result = F.struct(
        F.lit(question["type"]).alias("type"),
        *[F.when(ok, F.col("_a")[c]).alias(c) for c in _ANSWER],
        F.when(ok, public(question, F.col("_a"))).alias("answer"),
        F.col("_g").alias("agreement"),
        F.when(ok, chunks).alias("chunks"),
        F.coalesce("_d.model", F.lit(model)).alias("model"),
        F.struct(zero("requests"), zero("input_tokens"), F.col("_d.cost_usd").alias("cost_usd")).cast(USAGE_TYPE).alias("usage"),
        F.col("_e").alias("error"),
    )
    if on_error == "fail":
        result = F.when(F.col("_e").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("_e.code"), F.col("_e.message")))).otherwise(result)
    return rows.select("*", F.explode_outer(F.array(result)).alias(output_col)).drop("_d", "_e", "_a", "_g")

