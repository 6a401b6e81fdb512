"""Common runs of two texts with numpy: exact gram numbers, shares of grams, maximal runs."""
from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def gram_numbers(chars: np.ndarray, n: int) -> np.ndarray:
    """A number for the n characters from each place on: equal grams, and only they, have equal numbers.
    Numbers of grams of twice the length come from pairs of numbers, so nothing is hashed."""
    if len(chars) < n:
        return np.zeros(0, np.int64)
    level, size = np.unique(chars, return_inverse=True)[1], 1
    out, done = None, 0
    while True:
        if n & size:
            here = level[done : done + len(chars) - n + 1]
            out = here if out is None else _ranked(out, here)
            done += size
        if done == n:
            return out
        level = _ranked(level[:-size], level[size:])
        size *= 2


def _both(a: str, b: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram numbers of two texts that mean the same in both."""
    x, y = code_points(a), code_points(b)
    numbers = gram_numbers(np.concatenate([x, y]), n)
    return numbers[: max(0, len(x) - n + 1)], numbers[len(x) :]


def shared_grams(a: str, b: str, n: int) -> tuple[int, int, int]:
    """Distinct grams in both, in a, in b."""
    x, y = (np.unique(g) for g in _both(a, b, n))
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def _unlike(x: np.ndarray, y: np.ndarray, side_x: np.ndarray, side_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal grams whose neighbours differ; a missing neighbour (-1) differs from
    any. Only such pairs are made, so a text that repeats itself costs what its runs do."""
    ox, oy = np.lexsort((side_x, x)), np.lexsort((side_y, y))
    width = int(max(side_x.max(initial=0), side_y.max(initial=0))) + 2
    key_x, key_y = x[ox] * width + side_x[ox] + 1, y[oy] * width + side_y[oy] + 1
    first, last = np.searchsorted(y[oy], x[ox], "left"), np.searchsorted(y[oy], x[ox], "right")
    same_first, same_last = np.searchsorted(key_y, key_x, "left"), np.searchsorted(key_y, key_x, "right")
    none = side_x[ox] == -1
    same_first, same_last = np.where(none, first, same_first), np.where(none, first, same_last)
    before, behind = same_first - first, last - same_last
    n = before + behind
    of = np.repeat(np.arange(len(ox)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = np.where(k < before[of], first[of] + k, same_last[of] + k - before[of])
    return ox[of], oy[at]


def maximal_runs(a: str, b: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both texts and lengths of every common run of at least `least` characters that cannot be
    made longer on either side.

    Grams of that length that begin a run (what stands before differs) and grams that end one (what
    follows differs) are found apart; on one diagonal they take turns, so sorted they are the runs."""
    x, y = _both(a, b, least)
    if not len(x) or not len(y):
        return (np.zeros(0, np.int64),) * 3
    ca, cb = code_points(a), code_points(b)
    begin = _unlike(x, y, np.r_[-1, ca[: len(x) - 1]], np.r_[-1, cb[: len(y) - 1]])
    end = _unlike(x, y, np.r_[ca[least:], -1], np.r_[cb[least:], -1])
    by_diagonal = lambda p: np.lexsort((p[0], p[0] - p[1]))
    ob, oe = by_diagonal(begin), by_diagonal(end)
    i, j = begin[0][ob], begin[1][ob]
    return i, j, end[0][oe] - i + least
