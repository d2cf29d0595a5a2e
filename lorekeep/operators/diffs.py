"""Differences between two texts: fewest lines added and removed, and the hunks that turn one into the other.

A longest common subsequence is found bit by bit in parallel: a row of its table is one whole number with a bit for
each line of the new text, clear where the length grows, and a line of the old text updates the row by an addition.
Rows are kept to walk back along them; where they would take more than ``KEPT_BITS``, the old text is halved, the place
that the halves meet at is read off their last rows, and each part is done alone.  Memory is bounded so; time is
lines times lines over the bits of a machine word.  Lines that only one text has, and the common start and end, are
set aside before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of table rows that are kept at once (16 MB).
KEPT_BITS = 1 << 27

HUNK = T.StructType([
    T.StructField("old_start", T.IntegerType()), T.StructField("old_lines", T.IntegerType()),
    T.StructField("new_start", T.IntegerType()), T.StructField("new_lines", T.IntegerType()), T.StructField("body", T.StringType()),
])
DIFF = T.StructType([T.StructField("added", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("hunks", T.ArrayType(HUNK))])


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """The table's rows after each line of ``a`` (only the last unless ``keep``), before it a row of ones."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, [full]
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
        if keep:
            out.append(row)
    return out if keep else [row]


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and of each beginning of ``b``, the empty one first."""
    row = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _meet(a: list, b: list, kept: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > kept:
        mid = len(a) // 2
        cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
        return _meet(a[:mid], b[:cut], kept) + [(i + mid, j + cut) for i, j in _meet(a[mid:], b[cut:], kept)]
    rows, i, j, out = _rows(a, b, True), len(a), len(b), []
    while i and j:
        bit = 1 << j - 1
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def common(a: list, b: list, kept: int = KEPT_BITS) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists, ascending."""
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    left = [i for i in range(head, len(a) - tail) if a[i] in both]
    right = [j for j in range(head, len(b) - tail) if b[j] in both]
    inner = [(left[i], right[j]) for i, j in _meet([a[i] for i in left], [b[j] for j in right], kept)]
    return [(k, k) for k in range(head)] + inner + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def hunks(a: list[str], b: list[str], pairs: list[tuple[int, int]], context: int) -> list[tuple]:
    """Changes with up to ``context`` unchanged lines around each; changes whose contexts touch are one hunk.

    Starts count from 1; a side without lines has the number of the line before it.  Of one change, removed lines come first.
    """
    changes, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        if p > i or q > j:
            changes.append((i, p, j, q))
        i, j = p + 1, q + 1
    groups: list[list] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for g in groups:
        before, after = min(context, g[0][0]), min(context, len(a) - g[-1][1])
        i, j, end, last = g[0][0] - before, g[0][2] - before, g[-1][1] + after, g[-1][3] + after
        body, at = [], i
        for p, p2, q, q2 in g:
            body += [" " + x for x in a[at:p]] + ["-" + x for x in a[p:p2]] + ["+" + x for x in b[q:q2]]
            at = p2
        body += [" " + x for x in a[at:end]]
        out.append((i + (end > i), end - i, j + (last > j), last - j, "\n".join(body)))
    return out


def text_diff(by: str = "\n", context: int = 3):
    """``added, removed, hunks`` between two texts cut at ``by``, as a function of two columns.

    The counts are the fewest possible.  A null text is the empty text, which is one empty line; equal texts have no hunk.
    Hunk bodies have a line for each part, so ``by`` other than a line feed suits texts whose parts hold none.
    """

    @F.pandas_udf(DIFF)
    def differ(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(old.fillna(""), new.fillna(""), strict=True):
            a, b = x.split(by), y.split(by)
            pairs = common(a, b)
            out.append((len(b) - len(pairs), len(a) - len(pairs), hunks(a, b, pairs, context)))
        return pd.DataFrame(out, columns=["added", "removed", "hunks"])

    return differ
