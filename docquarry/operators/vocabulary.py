"""Vocabulary, misspelt words and query correction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.lexical import edits_allowed, prefix_credit, query_terms, typo_credit
from docquarry.functions.text import let, tokens
from docquarry.operators.edits import osa_distance
from docquarry.session import broadcast_if_small, materialise

MIN_LENGTH = 4


def vocabulary(documents: DataFrame, *columns: str, least: int = MIN_LENGTH) -> DataFrame:
    """(word, n_docs): distinct tokens of so many letters over all columns, and in how many documents each occurs."""
    own = F.array_distinct(F.filter(F.flatten(F.array(*(tokens(F.col(c)) for c in columns))), lambda t: F.length(t) >= least))
    return documents.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def deletions(word: Column, most: Column | int) -> Column:
    """The word and what is left of it after up to two deletions, at most most of them."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))

    def grown(one: Column) -> Column:
        two = F.when(F.lit(most) >= 2, F.array_distinct(F.flatten(F.transform(one, less)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(word), one, two))

    return let(F.array_distinct(less(word)), grown)


def fuzzy_matches(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, word, n_docs, distance, credit): words within the edits a term allows, exactly.

    terms is the asking side. Each edit, a swap too, is undone by a deletion on either side: a term and a
    word within k edits share what is left of each after at most k deletions. So they meet in an
    equi-join on that, and the alignment distance is worked out once for each pair that met.
    """
    t = terms.select(F.col("term"), edits_allowed(F.length("term")).alias("allowed")).where("allowed > 0").distinct()
    left = t.select("term", "allowed", F.explode(deletions(F.col("term"), F.col("allowed"))).alias("rest"))
    n = t.count()
    # a small vocabulary would be worked off by one task, as its bytes say nothing of its deletions
    words = materialise(words.select("word", "n_docs"), "words")
    wide = words.repartition(max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "word")
    right = wide.select("word", "n_docs", F.explode(deletions(F.col("word"), 2)).alias("rest"))
    met = right.join(broadcast_if_small(left, n * 80, 96), "rest").where(F.abs(F.length("term") - F.length("word")) <= F.col("allowed"))
    met = met.select("term", "word", "n_docs", "allowed").distinct().withColumn("distance", osa_distance(F.col("term"), F.col("word"))).where("distance <= allowed")
    return met.withColumn("credit", typo_credit(F.col("distance"), F.col("term"), F.col("word"))).drop("allowed")


def prefix_matches(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, word, credit): longer words that a term of three letters begins. An equi-join on the first three letters."""
    t = terms.where(F.length("term") >= 3).select("term", F.substring("term", 1, 3).alias("head"))
    met = words.withColumn("head", F.substring("word", 1, 3)).join(t, "head")
    kept = met.where(F.col("word").startswith(F.col("term")) & (F.length("word") > F.length("term")))
    return kept.select("term", "word", "n_docs", prefix_credit(F.col("term"), F.col("word")).alias("credit"))


def correct_query(query: str, words: DataFrame) -> tuple[str, float] | None:
    """The query with misspelt terms replaced by the nearest words, and the credit that is left; None where nothing changes.

    A term is misspelt if it has no digit, allows edits, isn't in the vocabulary and begins no word of
    it. The best word by credit, then document count, then alphabet. One small result, a row a term,
    reaches the driver: it changes the query that is planned next.
    """
    query = " ".join(query.lower().split())
    wanted = [t for t in query_terms(query) if not any(c.isdigit() for c in t) and len(t) > 3]
    if not wanted:
        return None
    terms = words.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    known = words.join(F.broadcast(terms), F.col("word").startswith(F.col("term"))).select("term").distinct()
    unknown = terms.join(known, "term", "left_anti")
    best = fuzzy_matches(unknown, words).withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("credit"), F.desc("n_docs"), "word"))).where("r = 1")
    found = {x["term"]: (x["word"], x["credit"]) for x in best.select("term", "word", "credit").collect()}
    if not found:
        return None
    fixed = re.sub(r"[^\W_]+", lambda m: found[m.group().lower()][0] if m.group().lower() in found else m.group(), query)
    return fixed, min(c for _, c in found.values())
