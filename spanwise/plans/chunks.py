"""Overlapping, evenly sized, sentence-aligned chunk plans within a budget of estimated tokens.

A text is cut into pieces, none longer than half the overlap: sentences; words of a long sentence,
gathered greedily; characters of a long word. Chunks are ranges of pieces. With prefix sums of their
bytes, a greedy chunk's end and the next one's start are two binary searches, so that a trial costs
one search for each chunk, and the smallest limit with as few chunks as the budget needs is found by
bisection. Planning is sequential within a text and local to its row: an Arrow UDF, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ATOM, BYTES_PER_TOKEN, ENDING, WORD_SPACE

OVERLAP = 0.05
_ENDING = re.compile(ENDING)
_ATOM = re.compile(ATOM)
PIECE_TYPE = "array<struct<start:int,end:int,bytes:int>>"
SPAN_TYPE = "array<struct<start:int,end:int,weight:double>>"


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def limits(max_tokens: int) -> tuple[int, int, int]:
    """(bytes of a chunk, bytes that neighbours share, bytes of a piece at most)."""
    limit = max_tokens * BYTES_PER_TOKEN
    overlap = int(limit * OVERLAP)
    return limit, overlap, max(4, overlap // 2)


def _gathered(parts: list[str], most: int, out: list[tuple[int, int]]) -> None:
    """Adds (characters, bytes) of runs of parts, each run filled while it fits."""
    chars = size = 0
    for part in parts:
        n = _bytes(part)
        if size and size + n > most:
            out.append((chars, size))
            chars = size = 0
        chars, size = chars + len(part), size + n
    if size:
        out.append((chars, size))


@lru_cache(maxsize=64)
def _filled(most: int) -> re.Pattern:
    """Runs of whole words and their spaces, each as long as ``most`` characters allow."""
    return re.compile(rf"[\s\S]{{1,{most}}}(?:\Z|(?<=[{WORD_SPACE}])(?![{WORD_SPACE}]))")


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _ENDING.finditer(text):
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:]


def pieces(text: str, most: int) -> list[tuple[int, int]]:
    """(characters, bytes) of the pieces in order."""
    out: list[tuple[int, int]] = []
    for sentence in _sentences(text):
        n = _bytes(sentence)
        if n <= most:
            out.append((len(sentence), n))
            continue
        if sentence.isascii():
            ends, filled = [0], _filled(most)
            while ends[-1] < n and (run := filled.match(sentence, ends[-1])):
                ends.append(run.end())
            # A word that is too long for a run stops them: then each word is looked at.
            if ends[-1] == n:
                out.extend((b - a, b - a) for a, b in pairwise(ends))
                continue
        words: list[str] = []
        for atom in _ATOM.findall(sentence):
            if _bytes(atom) <= most:
                words.append(atom)
            else:
                _gathered(words, most, out)
                words = []
                _gathered(list(atom), most, out)
        _gathered(words, most, out)
    return out


def _packed(sums: list[int], limit: int, overlap: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """(first, last) piece of every chunk; None as soon as there are more than ``most``."""
    out, first, n = [], 0, len(sums) - 1
    while True:
        last = max(first, bisect_right(sums, sums[first] + limit) - 2)
        out.append((first, last))
        if last == n - 1:
            return out
        if most is not None and len(out) >= most:
            return None
        first = max(first + 1, bisect_right(sums, sums[last + 1] - overlap) - 1)


def plan(text: str, max_tokens: int) -> list[tuple[int, int, float]]:
    """(start, end, weight) of every chunk; the weight is the share of bytes that no earlier chunk covers."""
    if not text:
        return [(0, 0, 1.0)]
    limit, overlap, most = limits(max_tokens)
    parts = pieces(text, most)
    chars = [0, *accumulate(c for c, _ in parts)]
    sums = [0, *accumulate(b for _, b in parts)]
    best = _packed(sums, limit, overlap)
    count, least = len(best), overlap + 2 * most
    if count > 1 and least < limit:
        # As few chunks as before, as even as possible: the smallest limit with that count.
        as_few = lambda size: len(_packed(sums, size, overlap, count) or ()) == count
        best = _packed(sums, least + bisect_left(range(least, limit), True, key=as_few), overlap)
    covered, out = 0, []
    for first, last in best:
        out.append((chars[first], chars[last + 1], (sums[last + 1] - sums[covered]) / sums[-1]))
        covered = last + 1
    return out


_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))


def _planned(texts: pa.Array, budgets: pa.Array) -> pa.Array:
    out = []
    for text, budget in zip(texts, budgets, strict=True):
        t, b = text.as_py(), budget.as_py()
        out.append(None if t is None or b is None else [{"start": a, "end": z, "weight": w} for a, z, w in plan(t, b)])
    return pa.array(out, _ARROW)


def plan_chunks(text: Column, max_tokens: Column | int) -> Column:
    """array<struct<start, end, weight>>; null for null. ``max_tokens``: 2 or more."""
    budget = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    return F.arrow_udf(_planned, SPAN_TYPE)(text, budget.cast("int"))


def chunk_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def piece_table(text: Column, max_tokens: int) -> Column:
    """array<struct<start, end, bytes>> of the pieces of a budget."""
    return F.arrow_udf(_pieces, PIECE_TYPE)(text, F.lit(limits(max_tokens)[2]))


def _pieces(texts: pa.Array, most: pa.Array) -> pa.Array:
    out = []
    for text, m in zip(texts, most, strict=True):
        at, rows = 0, []
        for c, b in pieces(text.as_py() or "", m.as_py()):
            rows.append({"start": at, "end": at + c, "bytes": b})
            at += c
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bytes", pa.int32())])))
