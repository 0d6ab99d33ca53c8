"""Edit distances and alignments. Levenshtein is built in; the others are Arrow functions, pruned by it where they join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(a: Column, b: Column) -> Column:
    """1 minus the Levenshtein distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def within(a: Column, b: Column, k: int) -> Column:
    """Whether the Levenshtein distance is at most k; stops early beyond it."""
    return (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b, k) >= 0)


def swaps_adjacent(a: str, b: str) -> int:
    """Optimal string alignment: a swapped pair isn't edited again."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def swaps_any(a: str, b: str) -> int:
    """Damerau-Levenshtein without restriction: text may be inserted between swapped characters."""
    big = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = [[big] * (len(b) + 2)] + [[big] + [i if not j else j if not i else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        last_column = 0
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_column
            if x == y:
                last_column = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last_row[x] = i
    return d[-1][-1]


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run


_osa = F.pandas_udf(_pairwise(swaps_adjacent), T.IntegerType())
_damerau = F.pandas_udf(_pairwise(swaps_any), T.IntegerType())


def osa_distance(a: Column, b: Column) -> Column:
    return _osa(a, b)


def damerau_distance(a: Column, b: Column) -> Column:
    return _damerau(a, b)


ALIGNMENT = T.StructType([T.StructField(n, T.StringType() if len(n) == 1 else T.IntegerType()) for n in ("a", "b", "score", "start_a", "end_a", "start_b", "end_b", "matches", "length")])


def _align(a: str, b: str, match: int, mismatch: int, gap: int, local: bool) -> tuple:
    """Best global or local alignment; ties go to the diagonal, then up, then left, and to the first best cell."""
    n, m = len(a), len(b)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    if not local:
        for i in range(n + 1):
            score[i][0] = i * gap
        score[0] = [j * gap for j in range(m + 1)]
    top, end = (0, (0, 0)) if local else (None, (n, m))
    for i in range(1, n + 1):
        row, above = score[i], score[i - 1]
        for j in range(1, m + 1):
            s = max(above[j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), above[j] + gap, row[j - 1] + gap)
            row[j] = max(0, s) if local else s
            if local and row[j] > top:
                top, end = row[j], (i, j)
    i, j = end
    left, right = [], []
    while (i or j) if not local else (i and j and score[i][j] > 0):
        here = score[i][j]
        if i and j and here == score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and here == score[i - 1][j] + gap:
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    x, y = "".join(reversed(left)), "".join(reversed(right))
    same = sum(p == q and p != "-" for p, q in zip(x, y, strict=True))
    return x, y, score[end[0]][end[1]], i, end[0], j, end[1], same, len(x)


def _alignment(match: int, mismatch: int, gap: int, local: bool):
    names = ALIGNMENT.names

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None,) * len(names) if x is None or y is None else _align(x, y, match, mismatch, gap, local) for x, y in zip(a, b, strict=True)]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int32" for c in names if c not in ("a", "b")})

    return run


_global, _local = _alignment(1, -1, -2, False), _alignment(2, -1, -2, True)


def global_alignment(a: Column, b: Column) -> Column:
    """Needleman-Wunsch with 1, -1 and -2: gapped texts, score, offsets, matches and length."""
    return _global(a, b)


def local_alignment(a: Column, b: Column) -> Column:
    """Smith-Waterman with 2, -1 and -2; empty where nothing scores above 0."""
    return _local(a, b)


def identity(alignment: Column) -> Column:
    return F.when(alignment["length"] > 0, alignment["matches"] / alignment["length"]).otherwise(0.0)
