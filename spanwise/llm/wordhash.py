"""Words, counts and shingles of many texts at once, as 64-bit hashes in numpy.

The texts of a block are joined by spaces into one byte array, in which A-Z are lower-cased. Words
are the runs between space bytes. A word's hash is a polynomial in an odd base over random 64-bit
values of its bytes, from one prefix sum and the base's inverse powers, mixed so that all bits count.
Blocks hold about BLOCK bytes, or one longer text, so memory doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 19
_U = np.uint64
_RANDOM = np.random.RandomState(20231).randint(0, 1 << 63, size=256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_C1, _C2, _C3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        up, down = np.empty(size, _U), np.empty(size, _U)
        for out, base in ((up, _BASE), (down, _INVERSE)):
            out[0], have, step = 1, 1, base
            while have < size:  # doubling: the next stretch is the first times base**have
                more = min(have, size - have)
                out[have : have + more] = out[:more] * _U(step)
                step, have = step * step % (1 << 64), have + more
        _POWERS[:] = [up, down]
    return _POWERS[0], _POWERS[1]


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, the texts as UTF-8) in blocks; null becomes empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if held and size + len(b) > BLOCK:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def words(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offset of each text's first word, one more at the end); A-Z lower-cased."""
    data = _LOWER[np.frombuffer(b" ".join(block) + b" ", np.uint8)]
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    # Edges alternate: a word begins, a word ends.
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum(_RANDOM[data] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U) * _C3)
    lengths = np.fromiter(map(len, block), np.int64, len(block)) + 1
    return h, np.concatenate(([0], np.searchsorted(begin, np.cumsum(lengths))))


def shingle_sets(block: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, hashed and ascending; shorter texts are one shingle, empty ones none."""
    h, at = words(block)
    rolled = None
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, _U)
        for k in range(width):
            rolled = rolled * _C3 + h[k : k + len(rolled)]
        rolled = mix(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            x = _U(0)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = x * _C1 + v
                yield mix(np.array([x + _U(b - a)], _U))
        else:
            yield np.zeros(0, _U)
