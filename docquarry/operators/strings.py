"""Exact matching, suffix arrays and multi-pattern search."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def occurrences(text: Column, pattern: Column) -> Column:
    """Ascending starts, from 0, of the pattern, overlaps included; none for an empty or longer pattern, null for null."""
    last = F.length(text) - F.length(pattern)
    spots = F.when((last >= 0) & (F.length(pattern) > 0), F.sequence(F.lit(0), last)).otherwise(F.when(text.isNotNull() & pattern.isNotNull(), F.array().cast(T.ArrayType(T.IntegerType()))))
    return F.filter(spots, lambda i: F.substr(text, i + 1, F.length(pattern)) == pattern)


def occurrence_count(text: Column, pattern: str) -> Column:
    """How often a pattern known to the plan occurs, overlaps included."""
    if not pattern:
        return F.when(text.isNotNull(), 0)
    from docquarry.functions.text import escape_regex

    return F.regexp_count(text, F.lit(f"(?={escape_regex(pattern)})"))


def prefix_function(text: str) -> list[int]:
    """For each position, the longest proper prefix that ends there."""
    out = [0] * len(text)
    for i in range(1, len(text)):
        k = out[i - 1]
        while k and text[i] != text[k]:
            k = out[k - 1]
        out[i] = k + (text[i] == text[k])
    return out


def z_function(text: str) -> list[int]:
    """For each position, how far the text from there agrees with its beginning; the whole length at 0."""
    n = len(text)
    out = [n] * min(n, 1) + [0] * max(0, n - 1)
    low = high = 0
    for i in range(1, n):
        k = min(high - i, out[i - low]) if i < high else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > high:
            low, high = i, i + k
    return out


def suffix_array(text: str) -> np.ndarray:
    """Starts of the suffixes in code-point order, by prefix doubling on ranks."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else after[:0]
        order = np.lexsort((after, rank))
        fresh = np.ones(n, np.int64)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def common_prefixes(text: str, order: np.ndarray) -> list[int]:
    """Length of the common prefix of each suffix with the one before in order; 0 for the first."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, k = [0] * n, 0
    for i in range(n):
        if place[i] == 0:
            k = 0
            continue
        j = int(order[place[i] - 1])
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[place[i]] = k
        k = max(0, k - 1)
    return out


def longest_repeat(text: str) -> str:
    """The longest substring that occurs twice; the first in order where several are as long."""
    if len(text) < 2:
        return ""
    order = suffix_array(text)
    lengths = common_prefixes(text, order)
    best = int(np.argmax(lengths))
    return text[int(order[best]) : int(order[best]) + lengths[best]]


def _each(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        return c.map(f, na_action="ignore")

    return run


_prefix, _z = _each(prefix_function, T.ArrayType(T.IntegerType())), _each(z_function, T.ArrayType(T.IntegerType()))
_suffix, _lcp = _each(lambda t: suffix_array(t).tolist(), T.ArrayType(T.IntegerType())), _each(lambda t: common_prefixes(t, suffix_array(t)), T.ArrayType(T.IntegerType()))
_repeat = _each(longest_repeat, T.StringType())


def failure_function(c: Column) -> Column:
    return _prefix(c)


def z_array(c: Column) -> Column:
    return _z(c)


def suffixes(c: Column) -> Column:
    return _suffix(c)


def lcp_array(c: Column) -> Column:
    return _lcp(c)


def longest_repeated_substring(c: Column) -> Column:
    return _repeat(c)


class Automaton:
    """All patterns at once in one pass over a text."""

    def __init__(self, patterns: Sequence[str]) -> None:
        if any(not p for p in patterns):
            raise ValueError("patterns must not be null or empty")
        self.patterns = list(patterns)
        self.next: list[dict[str, int]] = [{}]
        self.own: list[list[int]] = [[]]
        for k, pattern in enumerate(self.patterns):
            state = 0
            for c in pattern:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.own.append([])
                state = self.next[state][c]
            self.own[state].append(k)
        self.fail = [0] * len(self.next)
        self.shorter = [0] * len(self.next)  # the next state on the way of failures that ends a pattern
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for c, child in self.next[state].items():
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                waiting.append(child)
            back = self.fail[state]
            self.shorter[state] = back if self.own[back] else self.shorter[back]

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern, start, end) by end, then the longest first, then the pattern's number."""
        state = 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            at = state if self.own[state] else self.shorter[state]
            while at:
                for k in self.own[at]:
                    yield k, i - len(self.patterns[k]), i
                at = self.shorter[at]


def pattern_matches(df: DataFrame, row_id: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """(row_id, pattern, start, end) for every occurrence of every pattern; one pass per text, in Arrow batches."""
    automaton = Automaton(patterns)
    of = df.select(F.col(row_id).alias("x")).dtypes[0][1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(row, *m) for row, t in zip(part["row_id"], part["text"], strict=True) if t is not None for m in automaton.find(t)]
            yield pd.DataFrame(found, columns=["row_id", "pattern", "start", "end"])

    return df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(run, f"row_id {of}, pattern int, start int, end int")
