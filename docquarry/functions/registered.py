"""The library's functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docquarry.operators import edits, randomised
from docquarry.operators.strings import Automaton

_CHUNKS = r"""CREATE OR REPLACE TEMPORARY FUNCTION chunks(body STRING, size INT, overlap INT) RETURNS TABLE (position INT, text STRING) RETURN
SELECT p.position, array_join(slice(w, p.position * (size - overlap) + 1, size), ' ') AS text
FROM (SELECT filter(split(coalesce(body, ''), '\\s+'), x -> x <> '') AS w) LATERAL VIEW posexplode(
  CASE WHEN size(w) = 0 THEN array() ELSE sequence(1, CAST(greatest(1, ceil((size(w) - overlap) / (size - overlap))) AS INT)) END) p AS position, n"""


@udtf(returnType="pattern int, start int, end int")
class PatternMatches:
    """Every occurrence of every pattern in a text, in one pass; none for null."""

    def __init__(self) -> None:
        self.automata: dict = {}

    def eval(self, text: str, patterns: list):
        if text is None:
            return
        key = tuple(patterns)
        if key not in self.automata:
            self.automata[key] = Automaton(key)
        yield from self.automata[key].find(text)


def register(spark: SparkSession) -> None:
    """Register osa_distance, damerau_distance, global_align, local_align, is_prime, similarity, and the table functions chunks and pattern_matches for the session."""
    for name, function in (("osa_distance", edits._osa), ("damerau_distance", edits._damerau), ("global_align", edits._global), ("local_align", edits._local), ("is_prime", randomised._prime)):
        spark.udf.register(name, function)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION similarity(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1.0D - levenshtein(a, b) / greatest(length(a), length(b)) END")
    spark.sql(_CHUNKS)
    spark.udtf.register("pattern_matches", PatternMatches)
