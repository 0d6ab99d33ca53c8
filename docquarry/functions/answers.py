"""Cleaning generated answers and reading their citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy_answer(c: Column) -> Column:
    """Bracketed source marks as [n], bold text plain, asterisk bullets as hyphens, blanks at line ends and around it gone."""
    plain = F.regexp_replace(F.regexp_replace(c, r"【\s*(\d+)[^】]*】", "[$1]"), r"\*\*(.+?)\*\*", "$1")
    lines = F.regexp_replace(F.regexp_replace(plain, r"(?m)^([ \t]*)\*[ \t]+", "$1- "), r"(?m)[ \t]+$", "")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def citations(c: Column) -> Column:
    """Distinct source numbers of [1] and [1, 3] marks, ascending."""
    lists = F.regexp_extract_all(c, F.lit(r"\[(\d{1,4}(?:\s*,\s*\d{1,4})*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def prefixed(c: Column, prefix: str) -> Column:
    """Text as an asymmetric encoder wants it: questions with a prefix, passages without."""
    return F.concat(F.lit(prefix), c)
