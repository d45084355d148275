"""Reading answers: as columns over parsed structs, and as a scalar twin for remote calls.

Both give the same values and name the same problem first: type, probabilities, confidence, value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..question import label_column, labels_of
from .text import let

SUM_TOLERANCE = 0.1
UNIT_TOLERANCE = 1e-6
RAW_TYPE = "struct<type:string,choice:string,score:double,noul:double,probabilities:map<string,double>,confidence:double>"
READ_TYPE = "struct<value:double,label:string,probs:array<double>,confidence:double,problem:string>"

# What can be wrong.
WRONG_TYPE = "expected a {} answer"
NO_PROBABILITIES = "the probabilities are missing"
UNKNOWN_OPTION = "a probability is for an unknown option"
NOT_A_PROBABILITY = "a probability is not between 0 and 1"
BAD_SUM = "the probabilities do not sum to 1"
NOT_AN_OPTION = "the choice is not one of the options"
OUTSIDE = "the score is outside the rubric"
NOT_UNIT = "{} is not between 0 and 1"


def malformed(problem: str) -> str:
    return f"The model returned a malformed answer: {problem}."


def _within(x: Column, low: float, high: float) -> Column:
    """Whether x is a number in [low, high]; NaN and null are not."""
    return F.coalesce(~F.isnan(x) & (x >= low) & (x <= high), F.lit(False))


def _clamped(x: Column, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(0.0), x))


def read_answer(question, raw: Column) -> Column:
    """struct<value, label, probs, confidence, problem> of a raw answer; ``problem`` is null where all is well."""
    kind = question["type"]
    return let(raw, lambda r: _read_noul(r) if kind == "noul" else _read_distribution(question, r))


def _unit(x: Column) -> Column:
    return _within(x, -UNIT_TOLERANCE, 1 + UNIT_TOLERANCE)


def _wrong(raw: Column, kind: str) -> Column:
    return F.when(~F.coalesce(raw["type"] == kind, F.lit(False)), WRONG_TYPE.format(kind))


def _fields(value: Column, label: Column, probs: Column, confidence: Column, problem: Column) -> Column:
    def kept(p: Column) -> Column:
        values = {"value": value, "label": label, "probs": probs, "confidence": confidence}
        return F.struct(*[F.when(p.isNull(), v).alias(n) for n, v in values.items()], p.alias("problem"))

    return let(problem, kept)


def _read_noul(raw: Column) -> Column:
    none = F.lit(None)
    p = _clamped(raw["noul"], 1)
    problem = _wrong(raw, "noul").when(~_unit(raw["noul"]), NOT_UNIT.format("noul"))
    return _fields(p, none.cast("string"), F.array(1 - p, p), none.cast("double"), problem)


def _read_distribution(question, raw: Column) -> Column:
    kind, labels, top, none = question["type"], label_column(question), len(labels_of(question)) - 1, F.lit(None)
    given, confidence = raw["probabilities"], raw["confidence"]

    def read(probs: Column, total: Column) -> Column:
        problem = (
            _wrong(raw, kind)
            .when(given.isNull(), NO_PROBABILITIES)
            .when(F.size(F.array_except(F.map_keys(given), labels)) > 0, UNKNOWN_OPTION)
            .when(F.exists(F.map_values(given), lambda p: ~_within(p, 0.0, 1 + UNIT_TOLERANCE)), NOT_A_PROBABILITY)
            .when(~(F.abs(total - 1) <= SUM_TOLERANCE), BAD_SUM)
            .when(confidence.isNotNull() & ~_unit(confidence), NOT_UNIT.format("confidence"))
        )
        if kind == "choice":
            problem = problem.when(~F.coalesce(F.array_contains(labels, raw["choice"]), F.lit(False)), NOT_AN_OPTION)
            value, label = none.cast("double"), raw["choice"]
        else:
            problem = problem.when(~_within(raw["score"], -UNIT_TOLERANCE, top + UNIT_TOLERANCE), OUTSIDE)
            value, label = _clamped(raw["score"], top), none.cast("string")
        return _fields(value, label, F.transform(probs, lambda p: p / total), F.when(confidence.isNotNull(), _clamped(confidence, 1)), problem)

    listed = F.transform(labels, lambda k: F.coalesce(F.try_element_at(given, k), F.lit(0.0)))
    return let(listed, lambda probs: let(F.aggregate(probs, F.lit(0.0), lambda a, p: a + p), lambda total: read(probs, total)))


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def read_scalar(question, response, name: str = "decision") -> tuple[dict | None, str | None]:
    """(answer, problem) of a whole response: the answer of this name is read as ``read_answer`` does."""
    kind, labels = question["type"], labels_of(question)
    answers = response.get("answers") if isinstance(response, Mapping) else None
    raw = answers.get(name) if isinstance(answers, Mapping) else None
    if not isinstance(raw, Mapping) or raw.get("type") != kind:
        return None, WRONG_TYPE.format(kind)

    def unit(x) -> bool:
        return _number(x) and -UNIT_TOLERANCE <= x <= 1 + UNIT_TOLERANCE

    clamp = lambda x, high: min(float(high), max(0.0, float(x)))
    if kind == "noul":
        if not unit(raw.get("noul")):
            return None, NOT_UNIT.format("noul")
        p = clamp(raw["noul"], 1)
        return {"value": p, "label": None, "probs": [1 - p, p], "confidence": None}, None
    given, confidence = raw.get("probabilities"), raw.get("confidence")
    if not isinstance(given, Mapping):
        return None, NO_PROBABILITIES
    if any(k not in labels for k in given):
        return None, UNKNOWN_OPTION
    probs = [given.get(k, 0) for k in labels]
    if not all(_number(p) and 0 <= p <= 1 + UNIT_TOLERANCE for p in probs):
        return None, NOT_A_PROBABILITY
    total = math.fsum(probs)
    if not abs(total - 1) <= SUM_TOLERANCE:
        return None, BAD_SUM
    if confidence is not None and not unit(confidence):
        return None, NOT_UNIT.format("confidence")
    out = {"value": None, "label": None, "probs": [p / total for p in probs], "confidence": None if confidence is None else clamp(confidence, 1)}
    if kind == "choice":
        if not isinstance(raw.get("choice"), str) or raw["choice"] not in labels:
            return None, NOT_AN_OPTION
        return out | {"label": raw["choice"]}, None
    top = len(labels) - 1
    if not _number(raw.get("score")) or not -UNIT_TOLERANCE <= raw["score"] <= top + UNIT_TOLERANCE:
        return None, OUTSIDE
    return out | {"value": clamp(raw["score"], top)}, None
