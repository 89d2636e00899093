"""Jaro-Winkler on whole Arrow batches, with numpy; the one Python function that runs inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Ship these few functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of one side that are compared at a time.
MATRIX_CELLS = 1 << 20


def _char_matrix(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    flat = "".join(v.ljust(width, "\0") for v in values)
    codes = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).reshape(len(values), width)
    return codes, lengths


def jaro_winkler_batch(left: list[str], right: list[str]) -> np.ndarray:
    """S-11 for two equally long lists of strings.

    A character of the left string takes the first free equal character of
    the right string inside the window. Transpositions count as halves without
    rounding, and the prefix bonus applies at every similarity.
    """
    n = len(left)
    out = np.zeros(n)
    if n == 0:
        return out
    a, la = _char_matrix(left)
    b, lb = _char_matrix(right)
    same = np.array([x == y for x, y in zip(left, right)])
    reach = np.maximum(la, lb) // 2 - 1
    todo = ~same & (la > 0) & (lb > 0) & (reach >= 0)
    rows = np.flatnonzero(todo)
    out[same] = 1.0
    if rows.size == 0:
        return out
    a, b, la, lb, reach = a[rows], b[rows], la[rows], lb[rows], reach[rows]
    k = np.arange(rows.size)
    cols = np.arange(b.shape[1])
    free = cols[None, :] < lb[:, None]
    used_a = np.zeros(a.shape, dtype=bool)
    for i in range(int(la.max())):
        ok = free & (b == a[:, i : i + 1]) & (np.abs(cols[None, :] - i) <= reach[:, None])
        ok &= (i < la)[:, None]
        pick = ok.argmax(axis=1)
        hit = ok[k, pick]
        used_a[hit, i] = True
        free[k[hit], pick[hit]] = False
    used_b = ~free & (cols[None, :] < lb[:, None])
    m = used_a.sum(axis=1)
    # Matched characters of both sides, in order and left-aligned, then compared position by position.
    width = max(int(m.max()), 1)
    seq_a = np.zeros((rows.size, width), dtype=np.uint32)
    seq_b = np.zeros((rows.size, width), dtype=np.uint32)
    ra, ca = np.nonzero(used_a)
    seq_a[ra, (np.cumsum(used_a, axis=1) - 1)[ra, ca]] = a[ra, ca]
    rb, cb = np.nonzero(used_b)
    seq_b[rb, (np.cumsum(used_b, axis=1) - 1)[rb, cb]] = b[rb, cb]
    swaps = (seq_a != seq_b).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - swaps / 2) / m) / 3
    head = min(4, a.shape[1], b.shape[1])
    eq = (a[:, :head] == b[:, :head]) & (np.arange(head)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(eq, axis=1).sum(axis=1)
    score = jaro + prefix * 0.1 * (1 - jaro)
    out[rows] = np.where(m == 0, 0.0, score)
    return out


def jaro_winkler_series(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.full(len(left), np.nan)
    known = (left.notna() & right.notna()).to_numpy()
    idx = np.flatnonzero(known)
    a, b = left.to_numpy()[idx].tolist(), right.to_numpy()[idx].tolist()
    # Sub-batches of similar width keep the matrices small when one string is very long.
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])))
    lo = 0
    while lo < len(order):
        hi = min(lo + 2048, len(order))
        # Rows times width stays below a bound; a pair of very long strings goes alone.
        while hi > lo + 1 and (hi - lo) * max(len(a[order[hi - 1]]), len(b[order[hi - 1]])) > MATRIX_CELLS:
            hi = lo + (hi - lo) // 2
        part = order[lo:hi]
        out[idx[part]] = jaro_winkler_batch([a[i] for i in part], [b[i] for i in part])
        lo = hi
    return pd.Series(out).where(known, None)
