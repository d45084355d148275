"""Typed questions about long texts, asked chunk by chunk, for whole DataFrames at a time."""

from __future__ import annotations

import importlib

#: Loaded at first use: executors import the package for one function at a time.
_PLACES = {
    "AnswerCache": "operators.cached",
    "ColumnTransport": "operators.decide",
    "DecideError": "errors",
    "decide": "operators.decide",
    "decide_cached": "operators.cached",
    "decide_levels": "operators.levels",
    "decide_many": "operators.many",
    "decide_one": "operators.decide",
    "estimate_tokens": "functions.text",
    "observed": "operators.observe",
    "result_schema": "operators.decide",
    "unnested": "operators.many",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_PLACES[name]}"), name)
