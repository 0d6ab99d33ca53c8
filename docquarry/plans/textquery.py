"""A small query language over a corpus: find, findall, fuzzy, similar, prime. Parsed on the driver, run as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.edits import damerau_distance, global_alignment, local_alignment, osa_distance, similarity
from docquarry.operators.randomised import prime
from docquarry.operators.strings import occurrence_count

BLANKS = " \t\r\n"


@dataclass(frozen=True)
class TextQuery:
    kind: str
    terms: tuple[str, ...] = ()
    threshold: int = 0
    number: int = 0


def split_query(text: str) -> list[str]:
    """Bare words, and quoted ones that may hold blanks or be empty."""
    out, i = [], 0
    while i < len(text):
        if text[i] in BLANKS:
            i += 1
        elif text[i] == '"':
            end = text.find('"', i + 1)
            if end < 0:
                raise ValueError(f"unterminated quote starting at position {i}")
            out.append(text[i + 1 : end])
            i = end + 1
        else:
            end = next((j for j in range(i, len(text)) if text[j] in BLANKS), len(text))
            if '"' in text[i:end]:
                raise ValueError(f"unexpected quote inside a bare word at position {text.index(chr(34), i)}")
            out.append(text[i:end])
            i = end
    return out


def _whole(text: str, wrong: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise ValueError(wrong) from None


def parse(text: str | None) -> TextQuery:
    """Raises ValueError with what was expected where the query isn't well formed."""
    if text is None:
        raise ValueError("query must not be null")
    words = split_query(text)
    if not words:
        raise ValueError("empty query")
    kind, rest = words[0].lower(), words[1:]
    if kind == "find":
        if len(rest) != 1:
            raise ValueError(f"find expects exactly one quoted pattern, got {len(rest)}")
        return TextQuery("find", tuple(rest))
    if kind == "findall":
        if not rest:
            raise ValueError("findall expects at least one quoted pattern")
        return TextQuery("findall", tuple(rest))
    if kind == "fuzzy":
        threshold = 1
        if rest and rest[-1].startswith("~"):
            mark = rest.pop()
            threshold = _whole(mark[1:], f"malformed threshold '{mark}'")
            if threshold < 0:
                raise ValueError("threshold must not be negative")
        if len(rest) != 1:
            raise ValueError("fuzzy expects exactly one quoted pattern")
        return TextQuery("fuzzy", tuple(rest), threshold)
    if kind == "similar":
        if len(rest) != 2:
            raise ValueError(f"similar expects exactly two quoted strings, got {len(rest)}")
        return TextQuery("similar", tuple(rest))
    if kind == "prime":
        if len(rest) != 1:
            raise ValueError("prime expects exactly one integer")
        return TextQuery("prime", number=_whole(rest[0], f"prime expects an integer, got: {rest[0]}"))
    raise ValueError(f"unknown command '{words[0]}'; expected find, findall, fuzzy, similar or prime")


def find(corpus: DataFrame, text: str, pattern: str) -> DataFrame:
    """The rows that hold the pattern, with its number of occurrences, overlaps included."""
    return corpus.withColumn("n", occurrence_count(F.col(text), pattern)).where("n > 0")


def find_all(corpus: DataFrame, row_id: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """(row_id, pattern, n) for every row and pattern, 0 included."""
    each = F.array(*(F.struct(F.lit(p).alias("pattern"), occurrence_count(F.col(text), p).alias("n")) for p in patterns))
    return corpus.select(row_id, F.explode(each).alias("e")).select(row_id, "e.*")


def fuzzy(corpus: DataFrame, row_id: str, text: str, wanted: str, k: int) -> DataFrame:
    """Rows whose whole text is within k edits, nearest first."""
    near = corpus.where((F.abs(F.length(text) - len(wanted)) <= k)).withColumn("distance", F.levenshtein(F.col(text), F.lit(wanted), k)).where("distance >= 0")
    return near.orderBy("distance", row_id)


def similar(corpus: DataFrame, a: str, b: str) -> DataFrame:
    """One row with every distance and alignment of two texts."""
    one = corpus.sparkSession.createDataFrame([(a, b)], "a string, b string")
    x, y = F.col("a"), F.col("b")
    return one.select("a", "b", F.levenshtein(x, y).alias("levenshtein"), osa_distance(x, y).alias("osa"), damerau_distance(x, y).alias("damerau"), similarity(x, y).alias("similarity"), global_alignment(x, y).alias("whole"), local_alignment(x, y).alias("part"))


def run(text: str, corpus: DataFrame, row_id: str, column: str) -> DataFrame:
    """Parse and plan one query; nothing runs until an action."""
    q = parse(text)
    if q.kind == "find":
        return find(corpus, column, q.terms[0]).select(row_id, "n")
    if q.kind == "findall":
        return find_all(corpus, row_id, column, q.terms)
    if q.kind == "fuzzy":
        return fuzzy(corpus, row_id, column, q.terms[0], q.threshold).select(row_id, "distance")
    if q.kind == "similar":
        return similar(corpus, *q.terms)
    return corpus.sparkSession.createDataFrame([(q.number, prime(q.number))], "number bigint, prime boolean")


def totals(counted: DataFrame) -> DataFrame:
    """(pattern, n): the occurrences of each pattern in all rows, and under 'all patterns' of all of them."""
    return counted.rollup("pattern").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.grouping("pattern").alias("all")).select(F.when(F.col("all") == 1, "all patterns").otherwise(F.col("pattern")).alias("pattern"), "n")


# Each algorithm's name, category, time, space and note.
COSTS = (
    ("Naive search", "String", "O(n*m)", "O(1)", "Reference implementation"),
    ("KMP", "String", "O(n+m)", "O(m)", "No pathological input"),
    ("Z-Algorithm", "String", "O(n+m)", "O(m)", "No sentinel required"),
    ("Rabin-Karp", "String", "O(n+m) expected", "O(1)", "Every hash hit verified"),
    ("Aho-Corasick", "String", "O(n+z)", "O(m)", "Multi-pattern, one pass"),
    ("Suffix array", "String", "O(n log n)", "O(n)", "Prefix doubling, counting sort"),
    ("LCP (Kasai)", "String", "O(n)", "O(n)", "Requires the suffix array"),
    ("Levenshtein", "DP", "O(n*m)", "O(min(n,m))", "Rolling rows"),
    ("Damerau-Levenshtein", "DP", "O(n*m)", "O(n*m)", "Unrestricted variant"),
    ("Damerau-Levenshtein OSA", "DP", "O(n*m)", "O(n*m)", "Restricted variant"),
    ("Needleman-Wunsch", "DP", "O(n*m)", "O(n*m)", "Global alignment"),
    ("Smith-Waterman", "DP", "O(n*m)", "O(n*m)", "Local alignment"),
    ("Ford-Fulkerson", "Graph", "O(E*maxflow)", "O(V)", "DFS augmenting paths"),
    ("Edmonds-Karp", "Graph", "O(V*E^2)", "O(V)", "BFS augmenting paths"),
    ("Dinic", "Graph", "O(V^2*E)", "O(V)", "O(E*sqrt(E)) on unit capacity"),
    ("Bipartite matching", "Graph", "O(V*E)", "O(V)", "Kuhn's algorithm"),
    ("Vertex cover", "Approximation", "O(V+E)", "O(V)", "Ratio 2"),
    ("List scheduling", "Approximation", "O(n*m)", "O(n+m)", "Ratio 2 - 1/m"),
    ("LPT scheduling", "Approximation", "O(n log n)", "O(n+m)", "Ratio 4/3 - 1/3m"),
    ("Miller-Rabin", "Randomized", "O(k*log^3 n)", "O(1)", "Exact for 64-bit"),
    ("Universal hashing", "Randomized", "O(1) / O(L)", "O(1)", "Collision <= 1/m"),
    ("Reservoir sampling", "Randomized", "O(n)", "O(k)", "One pass, unknown length"),
)


def costs(spark, category: str = "", name: str = "") -> DataFrame:
    rows = spark.createDataFrame(list(COSTS), "name string, category string, time string, space string, note string")
    for column, value in (("category", category), ("name", name)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows
