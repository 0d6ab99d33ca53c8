"""Retrieval metrics, rank collapse, bootstrap tests and classification reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def collapse(scored: DataFrame, query: str, doc: str, score: str) -> DataFrame:
    """(query, doc, score, rank): the best chunk of each document, ranked by score and then by the id as text."""
    best = scored.groupBy(query, doc).agg(F.max(score).alias(score))
    order = Window.partitionBy(query).orderBy(F.desc(score), F.col(doc).cast("string"))
    return best.withColumn("rank", F.row_number().over(order))


def query_metrics(run: DataFrame, qrels: DataFrame, query: str = "query_id", doc: str = "doc_id", cuts: Sequence[int] = CUTS) -> DataFrame:
    """One row per judged query: reciprocal rank, recall and nDCG at each cut; 0 for queries without results. Binary relevance."""
    wanted = qrels.select(query, doc).distinct()
    sizes = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    hits = run.where(F.col("rank") <= max(cuts)).select(query, doc, "rank").join(wanted, [query, doc], "left_semi")
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = hits.groupBy(query).agg((1 / F.min("rank")).alias("rr"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in cuts), *(gain(k).alias(f"dcg_{k}") for k in cuts))
    both = sizes.join(found, query, "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(query, zero(F.col("rr")).alias("rr"), *(zero(F.col(f"hits_{k}") / F.col("n")).alias(f"recall_{k}") for k in cuts), *(zero(F.col(f"dcg_{k}") / ideal(k)).alias(f"ndcg_{k}") for k in cuts))


def mean_metrics(metrics: DataFrame, query: str = "query_id") -> DataFrame:
    """Macro averages over all judged queries."""
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != query))


def paired_bootstrap(differences: DataFrame, query: str, difference: str, rounds: int = 10_000, seed: int = 20260912) -> DataFrame:
    """One row: mean difference, 95 % interval, centred two-sided p, wins, losses and ties.

    Resampling is Poisson: each query counts as often as its own draw says, given by hash of round and
    query, so rounds are sums that need no collecting of queries, and a rerun draws the same.
    """
    cases = differences.select(F.col(query).alias("q"), F.col(difference).cast("double").alias("d"))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "round", "q"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    edges, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        edges.append(total)
        p /= k + 1
    drawn = sum(((uniform > e).cast("int") for e in edges), F.lit(0))
    observed = cases.agg(F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))
    # rounds per query are a fixed number, generated beside each query and summed map-side
    each = cases.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("n", drawn)
    means = each.groupBy("round").agg((F.sum(F.col("n") * F.col("d")) / F.nullif(F.sum("n"), F.lit(0))).alias("m")).where("m is not null")
    joined = means.join(F.broadcast(observed), F.lit(True), "cross")
    return joined.groupBy("mean", "wins", "losses", "ties").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.abs(F.col("m") - F.col("mean")) >= F.abs("mean")).cast("double")).alias("p"))


def deterministic_subset(queries: DataFrame, qrels: DataFrame, docs: DataFrame, n_queries: int, n_distractors: int, seed: int, query: str = "query_id", doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Sampled queries, and all their relevant documents with sampled distractors: the least MD5 of seed and id, so that any engine draws the same."""
    draw = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")))
    some = queries.orderBy(draw(query), query).limit(n_queries)
    needed = qrels.join(some.select(query), query, "left_semi").select(doc).distinct()
    others = docs.join(qrels.select(doc), doc, "left_anti").orderBy(draw(doc), doc).limit(n_distractors)
    return some, docs.join(needed, doc, "left_semi").unionByName(others)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from confusion counts; 0 where undefined."""
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    by_label = matrix.groupBy("label").agg(F.sum("n").alias("support"), right.alias("hit"))
    by_guess = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    both = by_label.join(by_guess, "label", "full").na.fill(0, ["support", "hit", "guessed"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return both.select("label", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def with_averages(report: DataFrame) -> DataFrame:
    """The report with two rows more: the plain mean of all classes, and the mean weighted by support."""
    measures = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = report.agg(F.lit("macro average").alias("label"), total, *(F.avg(c).alias(c) for c in measures))
    weighed = report.agg(F.lit("weighted average").alias("label"), total, *((F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias(c) for c in measures))
    return report.select("label", "support", *measures).unionByName(macro).unionByName(weighed)


def stored_percentiles(df: DataFrame, value: str, **shares: float) -> DataFrame:
    """One row: for each name the value at place floor(n * share) of the order, from 0; null values don't count."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return df.agg(*(F.max(value).alias(name) for name in shares))
    # at a share that falls on a place the interpolated percentile is the value there
    at = {name: min(int(n * share), n - 1) / max(n - 1, 1) for name, share in shares.items()}
    kind = dict(df.dtypes)[value]
    return df.agg(*(F.round(F.percentile(value, share), 9).cast(kind).alias(name) for name, share in at.items()))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): equal bins, closed above, the first closed below too."""
    at = F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins)) - 1
    return df.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def brier_and_log_loss(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    y, p = F.col(correct).cast("double"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(confidence)))
    return df.agg(F.avg((F.col(confidence) - y) ** 2).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information, homogeneity, completeness."""
    table = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    rows, columns = (table.groupBy(x).agg(F.sum("n").alias("n")) for x in "ab")
    total = table.agg(F.sum("n").alias("t"))
    h = lambda d, x: d.join(F.broadcast(total), F.lit(True), "cross").agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(f"h_{x}"), F.sum(pairs(F.col("n"))).alias(f"c_{x}"))
    each = h(table, "ab").join(h(rows, "a"), F.lit(True), "cross").join(h(columns, "b"), F.lit(True), "cross").join(total, F.lit(True), "cross")
    mutual = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    expected = F.col("c_a") * F.col("c_b") / F.nullif(pairs(F.col("t")), F.lit(0.0))
    most = (F.col("c_a") + F.col("c_b")) / 2
    one = lambda x, y: F.when(y > 0, x / y).otherwise(1.0)
    return each.select(F.when(most == expected, 1.0).otherwise((F.col("c_ab") - expected) / (most - expected)).alias("ari"), one(mutual, (F.col("h_a") + F.col("h_b")) / 2).alias("nmi"), one(mutual, F.col("h_a")).alias("homogeneity"), one(mutual, F.col("h_b")).alias("completeness"))


def knee(df: DataFrame, x: str, y: str) -> DataFrame:
    """The row farthest from the chord between the ends of a curve, both axes scaled to [0, 1]; for curves of a bounded number of points."""
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.min_by(y, x).alias("a"), F.max_by(y, x).alias("b"))
    scale = lambda c, low, high: F.when(F.col(high) > F.col(low), (c - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)
    u, v, va, vb = scale(F.col(x), "x0", "x1"), scale(F.col(y), "y0", "y1"), scale(F.col("a"), "y0", "y1"), scale(F.col("b"), "y0", "y1")
    far = F.abs(v - va - u * (vb - va))
    return df.join(F.broadcast(ends), F.lit(True), "cross").select(x, y, far.alias("distance")).orderBy(F.desc("distance"), x).limit(1)


def weight_of(c: Column) -> Column:
    """Sublinear term weight."""
    return 1 + F.log(c)


def curve(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """(share, value): the sorted values at so many equal steps, each the interpolated percentile; a curve of bounded length for knee."""
    shares = [i / points for i in range(points + 1)]
    one = df.agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("v"))
    return one.select(F.posexplode("v").alias("i", "value")).select((F.col("i") / points).alias("share"), "value")
