"""TF-IDF retrieval as joins on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import STOPWORDS, let, tokens
from docquarry.operators.evaluation import weight_of
from docquarry.session import broadcast_if_small, materialise


def grams(text: Column, longest: int = 2) -> Column:
    """Tokens without stop words, and the runs of them up to so many."""

    def runs(own: Column) -> Column:
        parts = [own]
        for n in range(2, longest + 1):
            shorter = F.slice(parts[-1], F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(0)))
            parts.append(F.zip_with(shorter, F.slice(own, F.lit(n), F.size(shorter)), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.concat(*parts)

    return let(F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)), runs)


def _counted(own: Column) -> Column:
    """Distinct values of an array with how often each stands there: sorted, then cut where the value changes."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.get(x, i - 1) != F.get(x, i - 2)))
        after = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(x) + 1))
        return let(starts, lambda at: F.zip_with(at, after(at), lambda i, j: F.struct(F.get(x, i - 1).alias("term"), (j - i).cast("long").alias("tf"))))

    return let(F.array_sort(own), lambda x: F.when(F.size(x) > 0, runs(x)))


def term_counts(text: Column, longest: int = 2) -> Column:
    """Array of the distinct terms of a text with how often each stands there; null without terms."""
    return _counted(grams(text, longest))


def counted_terms(docs: DataFrame, doc: str, text: str, longest: int = 2) -> DataFrame:
    """(doc, term, tf) of documents that stand in one row each: counted within the row, nothing is shuffled."""
    return docs.select(F.col(doc), F.explode(term_counts(F.col(text), longest)).alias("c")).select(doc, "c.term", "c.tf")


def idf(counted: DataFrame, doc: str, n_docs: DataFrame, least_df: int = 2) -> DataFrame:
    """(term, idf) = ln((1 + n) / (1 + df)) + 1 for terms in enough documents; n_docs has one row and column n."""
    df = counted.groupBy("term").agg(F.count(doc).alias("df")).where(F.col("df") >= least_df)
    return df.select("term", (F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counted: DataFrame, doc: str, weights: DataFrame) -> DataFrame:
    """(doc, term, w): sublinear counts times idf, each document of length 1."""
    raw = counted.join(weights, "term").select(doc, "term", (weight_of(F.col("tf")) * F.col("idf")).alias("w"))
    lengths = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(lengths, doc).select(doc, "term", (F.col("w") / F.col("length")).alias("w"))


def tfidf_run(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", longest: int = 2, least_df: int = 2) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query, scores above 0.

    Terms are counted once and written: document frequencies, lengths and postings all read that table.
    Weights are broadcast when their counted number allows it, so that lengths need no shuffle of the
    postings; only postings of terms that a query asks for are kept for scoring.
    """
    counted = materialise(counted_terms(docs, doc, text, longest), "counted")
    weights = materialise(idf(counted, doc, docs.agg(F.count(F.lit(1)).alias("n")), least_df), "weights")
    weights = broadcast_if_small(weights, weights.count(), 96)
    asked = materialise(weighted(counted_terms(queries, query, query_text, longest), query, weights).withColumnRenamed("w", "q"), "asked")
    n_asked = asked.count()
    raw = counted.join(weights, "term").select(doc, "term", (weight_of(F.col("tf")) * F.col("idf")).alias("w"))
    lengths = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    met = raw.join(broadcast_if_small(asked, n_asked, 128), "term").groupBy(query, doc).agg(F.sum(F.col("w") * F.col("q")).alias("s"))
    scores = met.join(lengths, doc).select(query, doc, F.round(F.col("s") / F.col("length"), 9).alias("score")).where("score > 0")
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col(doc).cast("string"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinctive_terms(held: DataFrame, groups: DataFrame, doc: str, group: str, n: int) -> DataFrame:
    """(group, term, lift, rank): mean weight in the group less that over all documents."""
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"))
    all_docs = groups.agg(F.count(F.lit(1)).alias("n_all"))
    overall = held.join(groups.select(doc), doc, "left_semi").groupBy("term").agg(F.sum("w").alias("s_all"))
    own = held.join(groups, doc).groupBy(group, "term").agg(F.sum("w").alias("s"))
    lifted = own.join(sizes, group).join(overall, "term").withColumn("n_all", all_docs.scalar())
    lifted = lifted.select(group, "term", F.round(F.col("s") / F.col("n_docs") - F.col("s_all") / F.col("n_all"), 9).alias("lift"))
    return lifted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), "term"))).where(F.col("rank") <= n)
