"""Pairwise protein alignment scores, as pandas functions over candidate pairs.

Pairs of like length are scored together: NumPy fills the anti-diagonals of all their tables at once, so that nothing runs
cell by cell or pair by pair in Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .sequence import KAPPA, LAMBDA

#: BLOSUM62 as NCBI publishes it, rows and columns in the order of the letters (X: unknown, *: stop).
LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
#: Gap costs.
OPEN, EXTEND = 11, 1
#: Table cells of the anti-diagonals that are filled together.
CELLS = 1 << 18

SCORES = np.array([[int(x) for x in line.split()] for line in BLOSUM62.strip().split("\n")], np.int32)
_NEVER = np.int32(-(1 << 29))
_code = np.full(128, LETTERS.index("X"), np.uint8)
_code[[ord(c) for c in LETTERS]] = range(len(LETTERS))


def _codes(text: str) -> np.ndarray:
    """Row of each letter in the matrix; letters that aren't amino acids count as X."""
    return _code[np.minimum(np.frombuffer(text.upper().encode("utf-32-le"), np.uint32), 127) if text else np.zeros(0, np.uint32)]


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(size.max())), LETTERS.index("X"), np.uint8)
    for row, t in zip(out, texts):
        row[: len(t)] = t
    return out, size


def _fill(first: list[np.ndarray], second: list[np.ndarray], simple: bool, border: int, floor: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best cell and last cell of each pair's table, best being 0 at least.

    A border cell costs ``border`` more than the one before it. ``simple``: a gap costs EXTEND where the neighbouring cell ends in
    the same gap or lies on the border, OPEN elsewhere, and ties go to gaps, first to those downwards. Otherwise gaps are affine and begin at inner
    cells. ``floor``: no cell is below 0.
    """
    a, n = _padded(first)
    b, m = _padded(second)
    pairs, rows, columns = len(a), a.shape[1], b.shape[1]
    kind, edge = (bool, True) if simple else (np.int32, _NEVER)

    def diagonal(d: int, value: int, kind: type) -> np.ndarray:
        """A new anti-diagonal by row, of which only border cells are known; cells off the table are never read."""
        out = np.empty((pairs, rows + 1), kind)
        out[:, 0] = value
        if d <= rows:
            out[:, d] = value
        return out

    older, old, down, along = diagonal(0, 0, np.int32), diagonal(1, -border, np.int32), diagonal(1, edge, kind), diagonal(1, edge, kind)
    best, last = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    for d in range(2, rows + columns + 1):
        low, high = max(1, d - columns), min(rows, d - 1)
        here, above = slice(low, high + 1), slice(low - 1, high)
        v = older[:, above] + SCORES[a[:, above], b[:, d - high - 1 : d - low][:, ::-1]]
        new, new_down, new_along = diagonal(d, -border * d, np.int32), diagonal(d, edge, kind), diagonal(d, edge, kind)
        if simple:
            x = old[:, above] - np.where(down[:, above], EXTEND, OPEN)
            y = old[:, here] - np.where(along[:, here], EXTEND, OPEN)
            gap = (v <= x) | (v <= y)
            new_down[:, here], new_along[:, here] = gap & (x >= y), gap & (x < y)
        else:
            x = np.maximum(down[:, above] - EXTEND, old[:, above] - OPEN)
            y = np.maximum(along[:, here] - EXTEND, old[:, here] - OPEN)
            if low == 1:  # no gap begins on the border
                x[:, 0] = _NEVER
            if high == d - 1:
                y[:, -1] = _NEVER
            new_down[:, here], new_along[:, here] = x, y
        v = np.maximum(v, np.maximum(x, y))
        if floor:
            v = np.maximum(v, 0)
        new[:, here] = v
        i = np.arange(low, high + 1)
        inside = (i <= n[:, None]) & (d - i <= m[:, None])
        best = np.maximum(best, np.where(inside, v, 0).max(axis=1))
        ends = np.flatnonzero(n + m == d)
        last[ends] = new[ends, n[ends]]
        older, old, down, along = old, new, new_down, new_along
    return best, last


def _grouped(rows: list[int], key) -> list[list[int]]:
    """Rows of one key together."""
    groups: dict = {}
    for i in rows:
        groups.setdefault(key(i), []).append(i)
    return [*groups.values()]


def raw_scores(first: list[str], second: list[str], kind: str, least: float = -math.inf) -> np.ndarray:
    """Scores of pairs by one of the recurrences; NaN where no alignment of the pair can reach more than ``least``.

    ``local``: best cell anywhere, free beginning, scores not held at zero (V18). ``global``: both sequences from end to end, border
    gaps costing one each (V19). ``simple``: best cell under the simple gap rule (V20). ``classical``: Smith and Waterman's.
    Against an empty sequence the score is 0, or that of the border in ``global``.
    """
    a, b = [_codes(t) for t in first], [_codes(t) for t in second]
    out = np.full(len(a), np.nan)
    most = SCORES.max(axis=1)
    todo = []
    for i, (x, y) in enumerate(zip(a, b)):
        if not len(x) or not len(y):
            out[i] = -EXTEND * max(len(x), len(y)) if kind == "global" else 0
        elif min(most[x].sum(), most[y].sum()) > least:
            todo.append(i)
    like = lambda i: (len(a[i]).bit_length(), len(a[i]) * 4 >> len(a[i]).bit_length(), len(b[i]).bit_length(), len(b[i]) * 4 >> len(b[i]).bit_length())
    for part in (group[at : at + size] for group in _grouped(todo, like) for size in [max(1, CELLS // (max(len(a[i]) for i in group) + 1))] for at in range(0, len(group), size)):
        best, last = _fill([a[i] for i in part], [b[i] for i in part], kind == "simple", EXTEND if kind == "global" else 0, kind == "classical")
        out[part] = last if kind == "global" else best
    return out


def bits(raw):
    return (LAMBDA * raw - math.log(KAPPA)) / math.log(2.0)


def alignment_bits(kind: str, least_bits: float | None = None):
    """Bit score of two text columns by ``kind`` of ``raw_scores``; null for null, and for pairs that cannot exceed ``least_bits``."""
    least = -math.inf if least_bits is None else (least_bits * math.log(2.0) + math.log(KAPPA)) / LAMBDA

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = bits(raw_scores(a[known].tolist(), b[known].tolist(), kind, least))
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return score
