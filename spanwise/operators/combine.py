"""Combining chunk answers into one: average by new text or the strongest, and how far the chunks agree.

The row-local form folds over the row's chunk array, in chunk order, so that equal answers give equal
bytes. The exploded form takes one row for each chunk and gathers no input's chunks: answers are sums and
firsts that combine before the shuffle, in decimals, so that no order of rows changes a byte. Its agreement
(``agreement_ranked``) sums distances by running sums over sorted values; equal values of an input are
added up first, and the rest is dealt by input and value range, so that an input with a large share of
all chunks is spread over up to RANGES tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..question import label_column, labels_of


def weighted(chunks: Column, value) -> Column:
    """The sum of weight * value(chunk), in chunk order."""
    return F.aggregate(chunks, F.lit(0.0), lambda a, c: a + c["weight"] * value(c))


def first_best(values: Column) -> Column:
    """The place, from 1, of the first of the largest."""
    return F.array_position(values, F.array_max(values)).cast("int")


def _distance(question, a: Column, b: Column) -> Column:
    if question["type"] == "score":
        return F.abs(a["value"] - b["value"]) / (len(labels_of(question)) - 1)
    return F.aggregate(F.zip_with(a["probs"], b["probs"], lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d) / 2


def agreement(question, chunks: Column) -> Column:
    """1 less the weighted mean distance of all pairs of chunks; 1 without pairs."""

    def pairs(all_chunks: Column) -> Column:
        def with_later(a: Column, i: Column) -> Column:
            later = F.slice(all_chunks, i + 2, F.size(all_chunks))
            zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("w"))
            step = lambda s, b: F.struct((s["d"] + a["weight"] * b["weight"] * _distance(question, a, b)).alias("d"), (s["w"] + a["weight"] * b["weight"]).alias("w"))
            return F.aggregate(later, zero, step)

        zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("w"))
        add = lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["w"] + x["w"]).alias("w"))
        return F.aggregate(F.transform(all_chunks, with_later), zero, add, lambda s: F.when(s["w"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - s["d"] / s["w"]))).otherwise(F.lit(1.0)))

    return let(chunks, pairs)


def average(question, chunks: Column) -> Column:
    """struct<value, label, probs, confidence>: weighted by the share of new text."""
    labels = label_column(question)
    zeros = F.array_repeat(F.lit(0.0), len(labels_of(question)))
    probs = F.aggregate(chunks, zeros, lambda a, c: F.zip_with(a, c["probs"], lambda x, p: x + c["weight"] * p))
    sure = F.when(~F.exists(chunks, lambda c: c["confidence"].isNull()), weighted(chunks, lambda c: c["confidence"]))
    if question["type"] == "choice":
        value, label = F.lit(None).cast("double"), let(probs, lambda p: F.element_at(labels, first_best(p)))
    else:
        top = float(len(labels_of(question)) - 1) if question["type"] == "score" else 1.0
        value, label = F.least(F.lit(top), weighted(chunks, lambda c: c["value"])), F.lit(None).cast("string")
    return F.struct(value.alias("value"), label.alias("label"), probs.alias("probs"), sure.alias("confidence"))


def _answer(c: Column) -> Column:
    return F.struct(c["value"].alias("value"), c["label"].alias("label"), c["probs"].alias("probs"), c["confidence"].alias("confidence"))


def strongest(chunks: Column) -> Column:
    """The answer of the first chunk with the largest value, whole."""
    return _answer(F.element_at(chunks, first_best(F.transform(chunks, lambda c: c["value"]))))


def combine(question, chunks: Column, how: str = "average") -> Column:
    """struct<value, label, probs, confidence> of array<struct<start, end, weight, value, label, probs, confidence>>; one chunk's answer stays as it is."""
    many = strongest(chunks) if how == "max" else average(question, chunks)
    return F.when(F.size(chunks) == 1, _answer(F.element_at(chunks, 1))).otherwise(many)


#: Value ranges of an input's label, each summed in a task of its own.
RANGES = 4096
_EXACT = "decimal(38,18)"


def _total(value: Column) -> Column:
    """A sum whose result doesn't depend on the order of rows."""
    return F.sum(value.cast(_EXACT)).cast("double")


def _averages(rows: DataFrame, question, id_col: str, index_col: str) -> DataFrame:
    labels = labels_of(question)
    shares = [_total(F.col("weight") * F.get("probs", F.lit(i))) for i in range(len(labels))]
    sums = rows.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*shares).alias("_probs"),
        _total(F.col("weight") * F.col("value")).alias("_value"),
        F.when(F.count("confidence") == F.count(F.lit(1)), _total(F.col("weight") * F.col("confidence"))).alias("_confidence"),
        # Of one chunk the answer stays as it is.
        F.min(F.struct(index_col, "value", "label", "probs", "confidence")).alias("_one"),
    )
    alone = F.col("_n") == 1
    if question["type"] == "choice":
        value, label = F.lit(None).cast("double"), F.element_at(label_column(question), first_best(F.col("_probs")))
    else:
        value, label = F.least(F.lit(float(len(labels) - 1) if question["type"] == "score" else 1.0), F.col("_value")), F.lit(None).cast("string")
    many = {"value": value, "label": label, "probs": F.col("_probs"), "confidence": F.col("_confidence")}
    return sums.select(id_col, *[F.when(alone, F.col("_one")[c]).otherwise(x).alias(c) for c, x in many.items()])


def _strongest_rows(rows: DataFrame, id_col: str, index_col: str) -> DataFrame:
    first = F.max(F.struct("value", (-F.col(index_col)).alias("i"), "label", "probs", "confidence")).alias("a")
    return rows.groupBy(id_col).agg(first).select(id_col, *[F.col("a")[c].alias(c) for c in ("value", "label", "probs", "confidence")])


def combine_rows(rows: DataFrame, question, how: str = "average", id_col: str = "id", index_col: str = "idx") -> DataFrame:
    """(id, value, label, probs, confidence, agreement) of one row for each chunk: id, index (whole numbers, different within an id), weight and an answer's columns."""
    answers = _strongest_rows(rows, id_col, index_col) if how == "max" else _averages(rows, question, id_col, index_col)
    agreed = agreement_ranked(rows, question, id_col, index_col).select(F.col(id_col).alias("_of"), "agreement")
    return answers.join(agreed, F.col(id_col).eqNullSafe(F.col("_of"))).drop("_of")


def agreement_ranked(rows: DataFrame, question, id_col: str = "id", index_col: str = "idx") -> DataFrame:
    """(id, agreement) from one row for each chunk, by sorting each label's values: sums of distances from running sums."""
    score = question["type"] == "score"
    if score:
        long = rows.select(id_col, "weight", F.lit(0).alias("k"), (F.col("value") / (len(labels_of(question)) - 1)).alias("p"))
    else:
        long = rows.select(id_col, "weight", F.posexplode("probs").alias("k", "p"))
    # Equal values are no distance apart.
    valued = long.groupBy(id_col, "k", "p").agg(_total(F.col("weight")).alias("w")).withColumn("b", F.least(F.lit(RANGES - 1), F.floor(F.col("p") * RANGES)).cast("int"))
    ranges = valued.groupBy(id_col, "k", "b").agg(_total(F.col("w")).alias("w"), _total(F.col("w") * F.col("p")).alias("s"))
    sofar = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    below = Window.partitionBy(id_col, "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(id_col).alias("_of"), F.col("k").alias("_k"), F.col("b").alias("_b"), sofar("w", below).alias("w0"), sofar("s", below).alias("s0"))
    here = F.col(id_col).eqNullSafe(F.col("_of")) & (F.col("k") == F.col("_k")) & (F.col("b") == F.col("_b"))
    within = Window.partitionBy(id_col, "k", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    apart = valued.withColumns({"w1": sofar("w", within), "s1": sofar(F.col("w") * F.col("p"), within)}).join(ranges, here)
    apart = apart.groupBy(id_col).agg(_total(F.col("w") * (F.col("p") * (F.col("w0") + F.col("w1")) - (F.col("s0") + F.col("s1")))).alias("d"))
    weights = rows.groupBy(F.col(id_col).alias("_id")).agg(_total(F.col("weight")).alias("w"), _total(F.col("weight") * F.col("weight")).alias("w2"))
    pairs = (F.col("w") * F.col("w") - F.col("w2")) / 2
    d = F.col("d") * (1.0 if score else 0.5)
    both = apart.join(weights, F.col(id_col).eqNullSafe(F.col("_id")))
    return both.select(id_col, F.when(pairs > 1e-15, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d / pairs))).otherwise(F.lit(1.0)).alias("agreement"))


def public(question, answer: Column) -> Column:
    """The answer's public fields: choice or score with probabilities by label and confidence, or noul alone."""
    if question["type"] == "noul":
        return F.struct(answer["value"].alias("noul"))
    main = answer["label"].alias("choice") if question["type"] == "choice" else answer["value"].alias("score")
    return F.struct(main, F.map_from_arrays(label_column(question), answer["probs"]).alias("probabilities"), answer["confidence"].alias("confidence"))
