"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

Round r inserts suffix number r of every string that is long enough: one symbol per
string.  The transform and the common-prefix table of the suffixes inserted so far are
two sequential files of bytes; a round reads both once from front to back and writes
them anew with the new rows in place.  Strings come from one bounded bucket, so the
files are held in memory.
"""

from __future__ import annotations

import numpy as np

#: Ends of strings, and rows whose symbol is not known yet; no byte of UTF-8 text.
END = 255


def _range_min(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of table[a:b] for every pair, a < b."""
    if not len(a):
        return np.zeros(0, table.dtype)
    order = np.argsort(-a, kind="stable")  # from the back, so that the stretches between pairs cost nothing
    pairs = np.stack([a[order], b[order]], axis=1).ravel()
    out = np.empty(len(a), table.dtype)
    out[order] = np.minimum.reduceat(np.append(table, np.uint8(255)), pairs)[::2]
    return out


def construct(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, prefixes) of all suffixes, empty ones first; prefixes: bytes in common with the row before, at most ``cap`` (below 255)."""
    m = len(strings)
    length = np.array([len(s) for s in strings], np.int64)
    widest = int(length.max(initial=0))
    columns = np.zeros((m, widest), np.uint8)
    for i, s in enumerate(strings):
        columns[i, widest - len(s) :] = np.frombuffer(s, np.uint8)
    columns = np.ascontiguousarray(columns.T)
    bwt, lcp, row = np.full(m, END, np.uint8), np.zeros(m, np.uint8), np.arange(m)
    for r in range(1, widest + 1):
        active = np.flatnonzero(length >= r)
        at = row[active]
        bwt[at] = columns[widest - r, active]
        order = np.argsort(bwt, kind="stable")  # row of suffix s -> place of (symbol before s) + s
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        place = rank[at]
        by = np.argsort(place, kind="stable")
        place, at, active = place[by], at[by], active[by]
        symbol = bwt[at]

        before = np.zeros(len(at), np.uint8)
        q = order[np.maximum(place - 1, 0)]
        same = (place > 0) & (bwt[q] == symbol)
        before[same] = np.minimum(_range_min(lcp, q[same] + 1, at[same] + 1), cap - 1) + 1
        last = m + place + 1 >= len(bwt) + len(at)
        q = order[np.minimum(place + 1, len(bwt) - 1)]
        same = ~last & (bwt[q] == symbol)
        after = np.zeros(len(at), np.uint8)
        after[same] = np.minimum(_range_min(lcp, at[same] + 1, q[same] + 1), cap - 1) + 1

        target = m + place
        fresh = np.zeros(len(bwt) + len(at), bool)
        fresh[target] = True
        new_bwt, new_lcp = np.full(len(fresh), END, np.uint8), np.zeros(len(fresh), np.uint8)
        new_bwt[~fresh], new_lcp[~fresh] = bwt, lcp
        new_lcp[target[~last] + 1] = after[~last]
        new_lcp[target] = before
        bwt, lcp = new_bwt, new_lcp
        row[active] = target
    return bwt, lcp


def rows_of(bwt: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, row) of all suffixes of at least ``least`` symbols, by walking back from the ends."""
    m = len(lengths)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    at, out = np.arange(m), []
    for r in range(1, int(lengths.max(initial=0)) + 1):
        active = np.flatnonzero(lengths >= r)
        at[active] = m + rank[at[active]]
        if r >= least:
            out.append((active, np.full(len(active), r), at[active].copy()))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeats(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of every window of ``width`` bytes; windows of one class are equal."""
    lengths = np.array([len(s) for s in strings], np.int64)
    bwt, lcp = construct(strings, width)
    string, size, row = rows_of(bwt, lengths, width)
    return string, lengths[string] - size, np.cumsum(lcp < width)[row]
