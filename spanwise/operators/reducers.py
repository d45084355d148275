"""Other ways to reduce chunk answers, and signals about them. None is a default; all of them are row-local
expressions over ``chunks`` as ``combine`` takes them, and none moves a row.

* ``reduce_probs``: a reducer for each label's probabilities, the results divided by their sum.
* ``majority``: each chunk votes for its likeliest label, by weight or by head.
* ``answer_of``: label, score or probability of a reduced distribution.
* ``agreement_with``: 1 less the weighted distance of the chunks from a distribution, in one pass.
* ``effective_chunks`` and ``adjusted_confidence``: how many chunks' worth of new text there is, and a confidence
  that rises with it where chunks agree. It is a heuristic, not a probability of being right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.text import let
from ..question import label_column, labels_of
from .combine import first_best, weighted

# Fixed values of the confidence's heuristic.
SATURATION = 0.25
AGREEMENT_FLOOR = 0.5
AGREEMENT_POWER = 2.0
CONFIDENCE_CAP = 0.98
REDUCERS = ("weighted_mean", "mean", "median", "min", "max", "percentile")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _middle(values: Column) -> Column:
    """The middle value, or the mean of both."""
    at = lambda s, k: F.element_at(s, k.cast("int"))
    return let(F.sort_array(values), lambda s: (at(s, F.floor((F.size(s) + 1) / 2)) + at(s, F.floor(F.size(s) / 2) + 1)) / 2)


def weighted_percentile(values: Column, weights: Column, q: float) -> Column:
    """The smallest value at which the values up to it hold the share ``q`` of all weight."""
    pairs = F.sort_array(F.arrays_zip(values.alias("v"), weights.alias("w")))

    def found(sorted_: Column) -> Column:
        # Sums that are equal but for rounding count as equal.
        enough = _sum(F.transform(sorted_, lambda x: x["w"])) * q - 1e-12
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"))
        step = lambda s, x: F.struct((s["w"] + x["w"]).alias("w"), F.when(s["v"].isNull() & (s["w"] + x["w"] >= enough), x["v"]).otherwise(s["v"]).alias("v"))
        return F.aggregate(sorted_, start, step, lambda s: F.coalesce(s["v"], F.element_at(sorted_, -1)["v"]))

    return let(F.transform(pairs, lambda x: F.struct(x["v"].alias("v"), x["w"].alias("w"))), found)


def reduce_probs(question, chunks: Column, how: str, q: float = 0.5) -> Column:
    """Probabilities in label order: each label's reduced on its own, then divided by their sum (as they are if that is 0)."""
    if how not in REDUCERS:
        raise invalid(f"A reducer is one of {', '.join(REDUCERS)}.")
    if not 0 <= q <= 1:
        raise invalid("A percentile lies between 0 and 1.")

    def one(values: Column) -> Column:
        return {"mean": lambda: _sum(values) / F.size(values), "median": lambda: _middle(values), "min": lambda: F.array_min(values), "max": lambda: F.array_max(values), "percentile": lambda: weighted_percentile(values, F.transform(chunks, lambda c: c["weight"]), q), "weighted_mean": lambda: None}[how]()

    def of(i: int) -> Column:
        if how == "weighted_mean":
            return weighted(chunks, lambda c: F.get(c["probs"], F.lit(i)))
        return let(F.transform(chunks, lambda c: F.get(c["probs"], F.lit(i))), one)

    return let(F.array(*[of(i) for i in range(len(labels_of(question)))]), lambda p: let(_sum(p), lambda total: F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(p)))


def majority(question, chunks: Column, by_weight: bool = True) -> Column:
    """Shares of the votes in label order; a chunk votes for the first of its likeliest labels."""
    share = (lambda c: c["weight"]) if by_weight else (lambda c: F.lit(1.0))
    votes = lambda i: F.aggregate(chunks, F.lit(0.0), lambda a, c: a + F.when(first_best(c["probs"]) == i + 1, share(c)).otherwise(0.0))
    return let(F.array(*[votes(i) for i in range(len(labels_of(question)))]), lambda v: let(_sum(v), lambda total: F.transform(v, lambda x: x / total)))


def answer_of(question, probs: Column) -> Column:
    """The first likeliest label of a choice; the mean level of a score; the probability of yes."""
    if question["type"] == "choice":
        return F.element_at(label_column(question), first_best(probs))
    if question["type"] == "noul":
        return F.element_at(probs, 2)
    return _sum(F.transform(probs, lambda p, i: p * i))


def _distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2


def agreement_with(chunks: Column, probs: Column) -> Column:
    """1 less the weighted mean of the chunks' total variation distances from ``probs``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - weighted(chunks, lambda c: _distance(c["probs"], probs))))


def agreement_rows(rows: DataFrame, question, id_col: str = "id") -> DataFrame:
    """(id, agreement) against the average, of one row for each chunk: two sums and a join, linear in the chunks."""
    n = range(len(labels_of(question)))
    average = rows.groupBy(F.col(id_col).alias("_of")).agg(F.array(*[F.sum(F.col("weight") * F.get("probs", F.lit(i))) for i in n]).alias("_p"))
    apart = rows.join(average, F.col(id_col).eqNullSafe(F.col("_of"))).withColumn("_d", F.col("weight") * _distance(F.col("probs"), F.col("_p")))
    return apart.groupBy(id_col).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sum("_d"))).alias("agreement"))


def effective_chunks(chunks: Column) -> Column:
    """1 for one chunk; for more, how many chunks of the largest new share all shares make."""
    return let(F.transform(chunks, lambda c: c["weight"]), lambda w: _sum(w) / F.array_max(w))


def base_confidence(question, chunks: Column, probs: Column) -> Column:
    """The weighted mean confidence, null if a chunk lacks it; for noul how far the probability is from even."""
    if question["type"] == "noul":
        return F.abs(2 * F.element_at(probs, 2) - 1)
    return F.when(~F.exists(chunks, lambda c: c["confidence"].isNull()), weighted(chunks, lambda c: c["confidence"]))


def adjusted_confidence(base: Column, effective: Column, agreement: Column) -> Column:
    """base + (cap - base) * saturation * gate: base itself for one chunk, and where agreement is at the floor or below."""
    saturation = 1 - F.exp(-SATURATION * (effective - 1))
    gate = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (agreement - AGREEMENT_FLOOR) / (1 - AGREEMENT_FLOOR))), F.lit(AGREEMENT_POWER))
    return base + (CONFIDENCE_CAP - base) * saturation * gate
