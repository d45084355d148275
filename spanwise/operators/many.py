"""Many questions about every text: one plan, and one request for each chunk that asks them all.

The budget leaves room for all questions together, so that one plan of a text serves every question. A
remote model gets ``questions`` by name and answers by name; a column model is one transport for each
name. Every question keeps its own way of combining. An input fails as a whole: a malformed answer
to one question leaves no answers to the others, as a part of the chunks would.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DecideError, invalid
from ..functions.answers import malformed, read_answer
from ..functions.text import let
from ..plans.chunks import chunk_text, plan_chunks
from ..question import MIN_CHUNK_TOKENS, chunk_tokens
from ..shipping import ship
from .ask import TIMEOUT_S, Run
from .combine import agreement, combine, public
from .decide import ANSWER_TYPE, ERROR_TYPE, MAX_INPUT_TOKENS, USAGE_TYPE, ColumnTransport, error_of, gates, prepare

_FIELDS = ("value", "label", "probs", "confidence")
_CHUNK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64()), ("value", pa.float64()), ("label", pa.string()), ("probs", pa.list_(pa.float64())), ("confidence", pa.float64())])


def _prepared(questions, combine_how, transport, **options):
    """(transport, or one for each name; how to combine each; budget)."""
    if not isinstance(questions, Mapping) or not questions or not all(isinstance(n, str) and n for n in questions):
        raise invalid("questions must be a mapping from names to questions.")
    hows = dict(combine_how) if isinstance(combine_how, Mapping) else dict.fromkeys(questions, combine_how)
    if set(hows) - set(questions):
        raise invalid("combine_how names a question that isn't asked.")
    by_name = isinstance(transport, Mapping)
    if by_name and (set(transport) != set(questions) or not all(isinstance(t, ColumnTransport) for t in transport.values())):
        raise invalid("Column transports have to be given for every question, by its name.")
    found = transport
    for name, question in questions.items():
        one, _ = prepare(question, hows.setdefault(name, "average"), transport=transport[name] if by_name else transport, **options)
        found = found if by_name else one
    if isinstance(found, ColumnTransport):
        raise invalid("Column transports have to be given for every question, by its name.")
    return found, hows, chunk_tokens(dict(questions))


def decide_many(
    df: DataFrame,
    questions: Mapping,
    input_col: str = "text",
    combine_how="average",
    max_input_tokens: int = MAX_INPUT_TOKENS,
    model: str = "default",
    transport=None,
    url: str | None = None,
    api_key: str | None = None,
    on_error: str = "fail",
    max_chunk_tokens: int | None = None,
    timeout: float = TIMEOUT_S,
    output_col: str = "result",
    ask_blank: bool = False,
) -> DataFrame:
    """``df`` with ``result``: ``answers``, which holds type, value, label, probs, confidence, the public answer,
    agreement and chunks of every question by its name; model, usage and error of them all.

    ``combine_how``: one way for all, or by name. ``transport``: a function, or a ColumnTransport by name. ``ask_blank``: as for ``decide``.
    """
    transport, hows, budget = _prepared(questions, combine_how, transport, max_input_tokens=max_input_tokens, model=model, url=url, api_key=api_key)
    budget = max_chunk_tokens or budget
    if on_error not in ("fail", "column"):
        raise invalid('on_error must be "fail" or "column".')
    if output_col.lower() in {c.lower() for c in df.columns}:
        raise invalid(f'There is a column "{output_col}" already: pass another output_col.')
    ship(df.sparkSession)
    # The working columns are one struct, whose name no column of df has.
    own = "_many"
    while own in {c.lower() for c in df.columns}:
        own += "_"
    gate = gates(F.col(input_col), max_input_tokens, ask_blank).cast(ERROR_TYPE)
    if isinstance(transport, Mapping):
        rows = _by_columns(df.withColumn(own, gate), own, questions, input_col, transport, budget)
    else:
        rows = _by_calls(df, own, gate, questions, input_col, transport, model, budget, timeout)
    error = F.col(own)["error"]
    ok = error.isNull()
    answers = []
    for i, (name, question) in enumerate(questions.items()):
        chunks = F.col(own)[f"chunks_{i}"]
        answers.append(F.when(ok, _answered(question, chunks, hows[name])).alias(name))
    out = F.struct(F.struct(*answers).alias("answers"), F.col(own)["model"].alias("model"), F.col(own)["usage"].alias("usage"), error.alias("error"))
    if on_error == "fail":
        out = F.when(error.isNotNull(), F.raise_error(F.concat_ws(": ", error["code"], error["message"]))).otherwise(out)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.explode_outer(F.array(out)).alias(output_col))


def _answered(question, chunks: Column, how: str) -> Column:
    whole = lambda a: F.struct(F.lit(question["type"]).alias("type"), *[a[f].alias(f) for f in _FIELDS], public(question, a).alias("answer"), agreement(question, chunks).alias("agreement"), chunks.alias("chunks"))
    return let(combine(question, chunks, how), whole)


def _by_columns(rows: DataFrame, own: str, questions, input_col: str, transports, budget: int) -> DataFrame:
    spans = F.struct(F.col(own).alias("error"), plan_chunks(F.when(F.col(own).isNull(), F.col(input_col)), budget).alias("spans"))
    rows = rows.withColumn(own, spans)
    read = lambda s, n, q: let(read_answer(q, transports[n].function(chunk_text(F.col(input_col), s))), lambda a: F.struct(*[s[c].alias(c) for c in ("start", "end", "weight")], *[a[c].alias(c) for c in (*_FIELDS, "problem")]))
    every = lambda n, q: F.transform(F.col(own)["spans"], lambda s: read(s, n, q))
    told = [every(n, q).alias(f"read_{i}") for i, (n, q) in enumerate(questions.items())]
    rows = rows.withColumn(own, F.struct(F.col(own)["error"].alias("error"), *told))
    of = lambda i: F.col(own)[f"read_{i}"]
    # The first chunk with a malformed answer, and there the first question.
    placed = lambda i: F.transform(of(i), lambda c, k: F.struct(k.alias("k"), F.lit(i).alias("i"), c["problem"].alias("problem")))
    first = F.array_min(F.filter(F.concat(*map(placed, range(len(questions)))), lambda x: x["problem"].isNotNull()))
    said = F.concat(F.lit("Chunk "), (first["k"] + 1).cast("string"), F.lit(" of "), F.size(of(0)).cast("string"), F.lit(" failed: "), F.lit(malformed("\x00").split("\x00")[0]), first["problem"], F.lit("."))
    error = F.coalesce(F.col(own)["error"], F.when(first.isNotNull(), error_of("request_failed", said, first["k"])).cast(ERROR_TYPE))
    chunks = [F.transform(of(i), lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "weight", *_FIELDS)])).alias(f"chunks_{i}") for i in range(len(questions))]
    asked = F.coalesce(F.size(of(0)), F.lit(0)).cast("long")
    usage = F.struct(F.greatest(asked, F.lit(0).cast("long")).alias("requests"), F.lit(0).cast("long").alias("input_tokens"), F.lit(None).cast("double").alias("cost_usd"))
    model = F.lit(next(iter(transports.values())).model)
    return rows.withColumn(own, F.struct(error.alias("error"), *chunks, model.alias("model"), usage.alias("usage")))


def _by_calls(df: DataFrame, own: str, gate: Column, questions, input_col: str, transport, model: str, budget: int, timeout: float) -> DataFrame:
    least, questions = min(MIN_CHUNK_TOKENS, budget), dict(questions)
    done = pa.struct([*[(f"chunks_{i}", pa.list_(_CHUNK)) for i in range(len(questions))], ("model", pa.string()), ("usage", pa.struct([("requests", pa.int64()), ("input_tokens", pa.int64()), ("cost_usd", pa.float64())])), ("error", pa.struct([("code", pa.string()), ("message", pa.string()), ("chunk", pa.int32()), ("status", pa.int32())]))])

    def ask(text: str | None, error) -> dict:
        if error is not None:
            return {"model": model, "usage": {"requests": 0, "input_tokens": 0, "cost_usd": None}, "error": error}
        run = Run(text, None, transport, model, timeout, questions=questions)
        out = {"error": None}
        try:
            spans, answers = run.decide(budget, least)
            for i, name in enumerate(questions):
                out[f"chunks_{i}"] = [{"start": a, "end": b, "weight": w} | x[name] for (a, b, w), x in zip(spans, answers, strict=True)]
        except DecideError as e:
            out["error"] = {"code": e.code, "message": e.message, "chunk": e.chunk, "status": e.status}
        return out | {"model": run.answered_by(), "usage": {"requests": run.requests, "input_tokens": int(run.input_tokens), "cost_usd": run.cost}}

    def asked(texts: pa.Array, gated: pa.Array) -> pa.Array:
        return pa.array([ask(t.as_py(), g.as_py()) for t, g in zip(texts, gated, strict=True)], done)

    chunks = ",".join(f"chunks_{i}:array<{ANSWER_TYPE}>" for i in range(len(questions)))
    return df.withColumn(own, F.arrow_udf(asked, f"struct<{chunks},model:string,usage:{USAGE_TYPE},error:{ERROR_TYPE}>")(F.col(input_col), gate))


def unnested(rows: DataFrame, questions: Mapping, *keys: str, output_col: str = "result") -> DataFrame:
    """(keys, question, type, value, label, probs, confidence, agreement, chunks) with one row for each text and question."""
    answers = F.col(output_col)["answers"]
    one = lambda n: F.struct(F.lit(n).alias("question"), *[answers[n][f].alias(f) for f in ("type", *_FIELDS, "agreement", "chunks")])
    return rows.select(*keys, F.inline(F.array(*map(one, questions))))
