"""Algorithm, evaluation and learning queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import evaluation as E
from docquarry.operators import graphs as G
from docquarry.operators import learning as L
from docquarry.operators import randomised as R
from docquarry.operators import strings as S
from docquarry.operators.tfidf import counted_terms, distinctive_terms, idf, tfidf_run, weighted
from docquarry.plans import textquery
from docquarry.session import materialise
from docquarry.sources.tables import table, text_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# strings


@query("SELECT doc_id, CAST((len(text) - len(replace(text, 'the', ''))) / 3 AS INT) AS n FROM documents WHERE contains(text, 'the')")
def g01_find_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return textquery.run('find "the"', table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, p AS pattern, CASE WHEN text IS NOT NULL THEN CAST((len(text) - len(replace(text, p, ''))) / len(p) AS INT) END AS n FROM documents, (VALUES ('audit'), ('budget'), ('no such words')) v(p)")
def g32_find_all_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return textquery.run('findall audit budget "no such words"', table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT topic_id, CAST(levenshtein(topic_key, 'tech-cache') AS INT) AS distance FROM topics WHERE levenshtein(topic_key, 'tech-cache') <= 4")
def g17_fuzzy_keys(spark: SparkSession, sf: str) -> DataFrame:
    return textquery.run('fuzzy "tech-cache" ~4', table(spark, sf, "topics"), "topic_id", "topic_key")


@query("SELECT topic_id, array_to_string(list_filter(range(0, len(title)), lambda i: substr(title, i + 1, 1) = 'e'), ',') AS spots FROM topics")
def g01_positions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select("topic_id", F.array_join(S.occurrences(F.col("title"), F.lit("e")), ",").alias("spots"))


@query("SELECT doc_id AS row_id, CAST(p AS INT) AS pattern, count(*) AS n FROM (SELECT doc_id, text, CAST(unnest(range(1, len(text) + 1)) AS INT) AS i FROM documents WHERE text IS NOT NULL), (VALUES (0, 'audit'), (1, 'budget'), (2, 'dit')) v(p, w) WHERE substr(text, i, len(w)) = w GROUP BY ALL")
def g03_many_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return S.pattern_matches(table(spark, sf, "documents"), "doc_id", "text", ["audit", "budget", "dit"]).groupBy("row_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT topic_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(topic_key)), lambda i: {'s': substr(topic_key, i + 1), 'i': i})), lambda x: x.i), ',') AS suffixes FROM topics")
def g05_suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select("topic_id", F.array_join(S.suffixes(F.col("topic_key")), ",").alias("suffixes"))


@query()
def g07_longest_repeats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "topics")
    c = F.col("summary")
    return t.select("topic_id", S.longest_repeated_substring(c).alias("repeat"), F.array_max(S.lcp_array(c)).alias("length"), F.array_max(S.failure_function(c)).alias("border"), F.array_join(S.z_array(F.col("topic_key")), ",").alias("z"))


@query("SELECT * FROM (VALUES ('KMP', 'String', 'O(n+m)', 'O(m)', 'No pathological input'), ('Suffix array', 'String', 'O(n log n)', 'O(n)', 'Prefix doubling, counting sort'), ('Naive search', 'String', 'O(n*m)', 'O(1)', 'Reference implementation'), ('Z-Algorithm', 'String', 'O(n+m)', 'O(m)', 'No sentinel required'), ('Rabin-Karp', 'String', 'O(n+m) expected', 'O(1)', 'Every hash hit verified'), ('Aho-Corasick', 'String', 'O(n+z)', 'O(m)', 'Multi-pattern, one pass'), ('LCP (Kasai)', 'String', 'O(n)', 'O(n)', 'Requires the suffix array')) v(name, category, time, space, note)")
def g30_costs(spark: SparkSession, sf: str) -> DataFrame:
    return textquery.costs(spark, "String")


# graphs: parts and their suppliers, one graph a nation


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Per month of ordering, which supplier delivers to which part's size class, and how much."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("graph"))
    return table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("v"), "l_quantity").join(s, "l_suppkey").groupBy("graph", F.col("l_suppkey").alias("u"), "v").agg(F.sum("l_quantity").cast("long").alias("c"))


_EDGES = "e AS (SELECT CAST(s.s_nationkey AS BIGINT) AS graph, l.l_suppkey AS u, l.l_partkey % 50 AS v, CAST(sum(l_quantity) AS BIGINT) AS c FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY ALL)"


def _network(spark: SparkSession, sf: str) -> DataFrame:
    """Source 0 to suppliers, suppliers to size classes, size classes to the sink; suppliers and classes each have room for 1000."""
    e = _edges(spark, sf)
    left, right = F.concat(F.lit("s"), "u"), F.concat(F.lit("p"), "v")
    inner = e.select("graph", left.alias("u"), right.alias("v"), "c")
    first = e.select("graph", F.lit("source").alias("u"), left.alias("v"), F.lit(1000).cast("long").alias("c")).distinct()
    last = e.select("graph", right.alias("u"), F.lit("sink").alias("v"), F.lit(100).cast("long").alias("c")).distinct()
    return inner.unionByName(first).unionByName(last)


@query()
def g18_max_flow_per_nation(spark: SparkSession, sf: str) -> DataFrame:
    return G.max_flows(_network(spark, sf), "graph", "u", "v", "c", "source", "sink").select("graph", "max_flow", F.size("source_side").alias("side"))


@query()
def g20_bottlenecks(spark: SparkSession, sf: str) -> DataFrame:
    net = _network(spark, sf)
    crossing = G.cut_edges(net, G.max_flows(net, "graph", "u", "v", "c", "source", "sink"), "graph", "u", "v")
    return crossing.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.sum("c").alias("weight"))


@query()
def g21_matching_per_nation(spark: SparkSession, sf: str) -> DataFrame:
    return G.matchings(_edges(spark, sf), "graph", "u", "v").groupBy("graph").agg(F.count(F.lit(1)).alias("size"))


@query(f"WITH {_EDGES} SELECT graph, count(*) AS covered FROM e GROUP BY graph")
def g22_covered_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of each graph that have an end in its cover: all of them."""
    e = _edges(spark, sf).select("graph", F.concat(F.lit("s"), "u").alias("u"), F.concat(F.lit("p"), "v").alias("v"))
    cover = G.covers(e, "graph", "u", "v").select(F.concat_ws(":", "graph", "node").alias("node"))
    named = e.select("graph", F.concat_ws(":", "graph", "u").alias("u"), F.concat_ws(":", "graph", "v").alias("v"))
    left = G.uncovered(named, cover, "u", "v", "node").groupBy("graph").agg(F.count(F.lit(1)).alias("left"))
    return named.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).join(left, "graph", "left").select("graph", (F.col("n") - F.coalesce("left", F.lit(0))).alias("covered"))


@query("SELECT n AS \"group\", greatest(CAST(ceil(sum(p) / 4) AS BIGINT), max(p)) AS bound FROM (SELECT c.c_nationkey AS n, CAST(round(o.o_totalprice) AS BIGINT) AS p FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) GROUP BY n")
def g23_schedule_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).groupBy("group").agg(G.makespan_bound(F.sum("n"), F.max("n"), 4).alias("bound"))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("group"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("n")).join(c, "o_custkey")


@query()
def g23_schedules(spark: SparkSession, sf: str) -> DataFrame:
    return G.makespans(_jobs(spark, sf), "group", "o_orderkey", "n", 4)


@query("SELECT o_orderkey AS n FROM orders WHERE o_orderkey > 1 AND len(list_filter(range(2, CAST(floor(sqrt(o_orderkey)) AS BIGINT) + 1), lambda i: o_orderkey % i = 0)) = 0")
def g24_prime_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("n")).where(R.is_prime(F.col("n")))


@query("SELECT CAST(((o_orderkey % 2147483647) * 48271 + 11) % 2147483647 % 16 AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def g26_universal_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(R.universal_hash(F.col("o_orderkey"), 48271, 11, 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def g27_reservoir_per_type(spark: SparkSession, sf: str) -> DataFrame:
    return R.reservoir(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 20, 7)


# evaluation: topics ask for their documents


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = text_table(spark, sf, "documents").where("text is not null").select("doc_id", "topic_key", "text")
    q = table(spark, sf, "topics").select(F.col("topic_id").alias("query_id"), F.regexp_replace(F.concat_ws(" ", "title", F.array_join("keywords", " ")), r"\{year\}", "").alias("query"), "topic_key")
    rels = d.join(q.select("query_id", "topic_key"), "topic_key").select("query_id", "doc_id")
    return d.select("doc_id", "text"), q.select("query_id", "query"), rels


@query()
def v13_tfidf_run(spark: SparkSession, sf: str) -> DataFrame:
    d, q, _ = _judged(spark, sf)
    return tfidf_run(d, q, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query()
def m01_retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d, q, rels = _judged(spark, sf)
    return E.mean_metrics(E.query_metrics(tfidf_run(d, q, 10), rels))


_WORD_RUN = r"""q AS (SELECT topic_id AS query_id, topic_key, unnest(keywords) AS w FROM topics),
s AS (SELECT DISTINCT q.query_id, d.doc_id, q.w FROM documents d JOIN q ON contains(lower(d.title), q.w)),
b AS (SELECT query_id, doc_id, count(*) AS score FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM b),
rel AS (SELECT t.topic_id AS query_id, d.doc_id FROM topics t JOIN documents d ON d.topic_key = t.topic_key),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
h AS (SELECT r.query_id, min(rank) AS best, count(*) FILTER (rank <= 5) AS h5, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg FROM r JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1)"""


def _word_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # words are looked for inside titles: the asking side is broadcast, of a table of fixed length
    q = table(spark, sf, "topics").select(F.col("topic_id").alias("query_id"), F.explode("keywords").alias("w"))
    d = table(spark, sf, "documents").where("title is not null").select("doc_id", F.lower("title").alias("t"), "topic_key")
    s = d.join(F.broadcast(q.distinct()), F.col("t").contains(F.col("w"))).groupBy("query_id", "doc_id").agg(F.count_distinct("w").alias("score"))
    rels = d_rels(spark, sf)
    return E.collapse(s, "query_id", "doc_id", "score"), rels


def d_rels(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "topics").select(F.col("topic_id").alias("query_id"), "topic_key")
    return table(spark, sf, "documents").select("doc_id", "topic_key").join(t, "topic_key").select("query_id", "doc_id")


@query(f"WITH {_WORD_RUN} SELECT n.query_id, round(coalesce(1 / best, 0), 6) AS rr, round(coalesce(h5 / n.n, 0), 6) AS recall_5, round(coalesce(dcg / list_sum(list_transform(range(1, least(n.n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg_5 FROM n LEFT JOIN h USING (query_id)")
def m01_query_metrics(spark: SparkSession, sf: str) -> DataFrame:
    run, rels = _word_run(spark, sf)
    return E.query_metrics(run, rels).select("query_id", *(F.round(c, 6).alias(c) for c in ("rr", "recall_5", "ndcg_5")))


@query()
def m03_paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    run, rels = _word_run(spark, sf)
    d, q, judged = _judged(spark, sf)
    a = E.query_metrics(run, rels).select("query_id", F.col("ndcg_10").alias("a"))
    b = E.query_metrics(tfidf_run(d, q, 10), judged).select("query_id", F.col("ndcg_10").alias("b"))
    both = a.join(b, "query_id").select("query_id", (F.col("b") - F.col("a")).alias("difference"))
    return E.paired_bootstrap(both, "query_id", "difference")


@query()
def m04_deterministic_subset(spark: SparkSession, sf: str) -> DataFrame:
    d, q, rels = _judged(spark, sf)
    return E.deterministic_subset(q, rels, d.select("doc_id"), 20, 50, 20260912)[1]


_REPORT = "WITH v AS (SELECT document_type AS label, CASE WHEN n_chars > 1000 THEN 'PDF' ELSE 'DOCX' END AS predicted FROM documents), c AS (SELECT label, predicted, count(*) AS n FROM v GROUP BY ALL), l AS (SELECT label, sum(n) AS s, sum(n) FILTER (label = predicted) AS h FROM c GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS g FROM c GROUP BY 1), r AS (SELECT coalesce(l.label, p.label) AS label, CAST(coalesce(s, 0) AS BIGINT) AS support, CASE WHEN coalesce(g, 0) > 0 THEN coalesce(h, 0) / g ELSE 0 END AS p, CASE WHEN coalesce(s, 0) > 0 THEN coalesce(h, 0) / s ELSE 0 END AS r FROM l FULL JOIN p ON p.label = l.label), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM r)"


@query(_REPORT + " SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM f UNION ALL SELECT 'macro average', CAST(sum(support) AS BIGINT), round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM f UNION ALL SELECT 'weighted average', CAST(sum(support) AS BIGINT), round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6) FROM f")
def a15_class_report(spark: SparkSession, sf: str) -> DataFrame:
    guess = table(spark, sf, "documents").select(F.col("document_type").alias("label"), F.when(F.col("n_chars") > 1000, "PDF").otherwise("DOCX").alias("predicted"))
    report = E.with_averages(E.class_report(E.confusion(guess, "label", "predicted")))
    return report.select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("WITH e AS (SELECT value % 1 AS c, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END::DOUBLE AS y FROM events), b AS (SELECT greatest(1, ceil(c * 10)) AS b, count(*) AS n, avg(c) AS c, avg(y) AS y FROM e GROUP BY 1) SELECT (SELECT round(sum(n * abs(c - y)) / sum(n), 6) FROM b) AS ece, round(avg((c - y) * (c - y)), 6) AS brier, round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, c))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, c))))), 5) AS log_loss FROM e")
def a17_calibration_measures(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("value") % 1).alias("c"), (F.col("event_type") == "click").alias("ok"))
    both = E.calibration_error(E.reliability(e, "c", "ok")).crossJoin(E.brier_and_log_loss(e, "c", "ok"))  # two single rows
    return both.select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), F.round("log_loss", 5).alias("log_loss"))


@query("SELECT CAST(greatest(1, ceil((value % 1) * 10)) - 1 AS INT) AS bin, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 6) AS accuracy FROM events GROUP BY 1")
def a17_reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("value") % 1).alias("c"), (F.col("event_type") == "click").alias("ok"))
    return E.reliability(e, "c", "ok").select("bin", "n", F.round("accuracy", 6).alias("accuracy"))


@query("WITH c AS (SELECT status AS a, document_type AS b, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS c FROM c), ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n FROM c GROUP BY b), x AS (SELECT sum(n * (n - 1) / 2) AS c, (SELECT -sum(n / t * ln(n / t)) FROM ra, t) AS h FROM ra), y AS (SELECT sum(n * (n - 1) / 2) AS c, (SELECT -sum(n / t * ln(n / t)) FROM rb, t) AS h FROM rb), j AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t) SELECT round((t.c - x.c * y.c / (t.t * (t.t - 1) / 2)) / ((x.c + y.c) / 2 - x.c * y.c / (t.t * (t.t - 1) / 2)), 6) AS ari, round((x.h + y.h - j.h) / ((x.h + y.h) / 2), 6) AS nmi, round((x.h + y.h - j.h) / x.h, 6) AS homogeneity, round((x.h + y.h - j.h) / y.h, 6) AS completeness FROM t, x, y, j")
def m17_agreement(spark: SparkSession, sf: str) -> DataFrame:
    found = E.cluster_agreement(table(spark, sf, "documents"), "status", "document_type")
    return found.select(*(F.round(c, 6).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness")))


# learning


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label, and the topic they are folded by, however it is spelled."""
    d = table(spark, sf, "documents").where("text is not null and category_id is not null and topic_key is not null")
    d = d.select("doc_id", "text", F.col("category_id").cast("string").alias("label"), X.entity_key(F.col("topic_key")).alias("topic"))
    return L.grouped_folds(d.where("topic is not null"), "topic", 5)


_KEY = r"nullif(regexp_replace(lower(topic_key), '[\s\p{Z}\p{P}\p{S}]+', '', 'g'), '')"
_LABELLED = f"b AS (SELECT doc_id, text, CAST(category_id AS VARCHAR) AS label, {_KEY} AS topic FROM documents WHERE text IS NOT NULL AND category_id IS NOT NULL AND {_KEY} IS NOT NULL)"


@query()
def m07_locked_topics_report(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of one fold are held back; nothing is fitted on them."""
    d = _labelled(spark, sf)
    guess = L.classify(d.where("fold <> 0"), d.where("fold = 0"), "text", "label", "bayes")
    # the report reads its counts several times
    return E.with_averages(E.class_report(materialise(E.confusion(guess, "label", "predicted"), "confusion")))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(rf"""WITH {_LABELLED}, t AS (SELECT doc_id, label, topic, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+'), lambda t: len(t) >= 2 AND t NOT IN ({_STOP}))) AS term FROM b),
tf AS (SELECT doc_id, label, topic, term, count(*) AS n FROM t GROUP BY ALL), labels AS (SELECT label, count(*) AS docs FROM b GROUP BY 1), topics_ AS (SELECT DISTINCT topic FROM b),
own AS (SELECT topic, label, count(*) AS docs FROM b GROUP BY ALL), lt AS (SELECT label, term, sum(n) AS n FROM tf GROUP BY ALL), gt AS (SELECT topic, label, term, sum(n) AS n FROM tf GROUP BY ALL),
ls AS (SELECT label, sum(n) AS n FROM tf GROUP BY 1), gs AS (SELECT topic, label, sum(n) AS n FROM tf GROUP BY ALL), v AS (SELECT count(DISTINCT term) AS n FROM tf),
m AS (SELECT p.topic, l.label, l.docs - coalesce(o.docs, 0) AS docs, coalesce(ls.n, 0) - coalesce(gs.n, 0) + v.n AS total FROM topics_ p, v, labels l LEFT JOIN own o ON o.topic = p.topic AND o.label = l.label LEFT JOIN ls ON ls.label = l.label LEFT JOIN gs ON gs.topic = p.topic AND gs.label = l.label WHERE l.docs - coalesce(o.docs, 0) > 0),
s AS (SELECT tf.doc_id, lt.label, sum(tf.n * ln(lt.n - coalesce(gt.n, 0) + 1)) AS s FROM tf JOIN lt ON lt.term = tf.term LEFT JOIN gt ON gt.topic = tf.topic AND gt.label = lt.label AND gt.term = tf.term GROUP BY ALL),
w AS (SELECT doc_id, sum(n) AS n FROM tf GROUP BY 1),
g AS (SELECT b.doc_id, b.topic, b.label, m.label AS predicted FROM b JOIN m ON m.topic = b.topic LEFT JOIN s ON s.doc_id = b.doc_id AND s.label = m.label LEFT JOIN w ON w.doc_id = b.doc_id
  QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY round(ln(m.docs) + coalesce(s.s, 0) - coalesce(w.n, 0) * ln(m.total), 6) DESC, m.label) = 1)
SELECT topic, count(*) AS n, count(*) FILTER (label = predicted) AS hits FROM g GROUP BY 1""")
def m07_leave_one_topic_out(spark: SparkSession, sf: str) -> DataFrame:
    """For each topic, how many of its documents a model of all other topics labels right."""
    guess = L.leave_one_group_out(_labelled(spark, sf), "doc_id", "text", "label", "topic")
    return guess.groupBy(F.col("group").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))


@query(f"WITH {_LABELLED}, f AS (SELECT *, CAST(('0x' || substr(md5('7:' || topic), 1, 8))::BIGINT % 5 AS INT) AS fold FROM b) SELECT fold, count(DISTINCT topic) AS groups, count(*) AS rows, CAST(0 AS BIGINT) AS leaked FROM f GROUP BY fold")
def m08_leakage_of_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Topics and documents of each fold, and topics that other folds hold too: none, however topics are spelled."""
    return L.shared_groups(_labelled(spark, sf), "topic")


@query()
def m10_k_means_profile(spark: SparkSession, sf: str) -> DataFrame:
    x = L.as_features(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "embedding")
    out, _, _ = L.k_means(x, 10)
    return E.cluster_agreement(out, "cluster", "label")


#: Numbers of clusters that are tried.
CLUSTERS = range(2, 31)


@query()
def m10_sweep_and_knee(spark: SparkSession, sf: str) -> DataFrame:
    x = L.as_features(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").cache()
    return E.knee(L.sweep(x, CLUSTERS), "k", "inertia")


def _fifth_distances(spark: SparkSession, sf: str) -> DataFrame:
    from docquarry.plans.search import batched_search

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    near = batched_search(e.select(F.col("point_id").alias("query_id"), "vector"), e, 5, 64).where("rank = 5")
    return near.select(F.col("query_id").alias("vec_id"), F.round(F.greatest(F.lit(0.0), 1 - F.col("cosine")), 4).alias("distance"))


@query()
def m14_dbscan(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters whose radius is the knee of the distances to the fifth neighbour, a vector counting as its own first."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    radius = E.knee(E.curve(_fifth_distances(spark, sf), "distance"), "share", "value").first()["value"]
    return L.dbscan(L.radius_pairs(e, "vec_id", "embedding", radius), e, "a", "b", "vec_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def m12_mini_batch_profile(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    out = L.mini_batch_k_means(e, "vec_id", "embedding", 10).withColumnRenamed("row_id", "vec_id").join(e.select("vec_id", "label"), "vec_id")
    return E.cluster_agreement(out, "cluster", "label")


@query()
def m15_principal_components(spark: SparkSession, sf: str) -> DataFrame:
    x = L.as_features(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return spark.createDataFrame([(L.principal_components(x)[1],)], "components int")


@query()
def m18_distinctive_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents").where("text is not null and category_id is not null").select("doc_id", "category_id", "text")
    counted = counted_terms(d, "doc_id", "text", 1)
    held = weighted(counted, "doc_id", idf(counted, "doc_id", d.agg(F.count(F.lit(1)).alias("n"))))
    return distinctive_terms(held, d.select("doc_id", "category_id"), "doc_id", "category_id", 5).withColumn("lift", F.round("lift", 6))


@query()
def m13_agglomerative_groups(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return L.agglomerate_groups(e, "label", "vec_id", "embedding", 3, "ward")


@query("""WITH d AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS words FROM documents)
SELECT 'all' AS part, '' AS name, count(*) AS documents, count(DISTINCT topic_key) AS topics, round(avg(words), 6) AS mean_words, 1.0::DOUBLE AS share FROM d
UNION ALL SELECT 'language', coalesce(lang, ''), count(*), count(DISTINCT topic_key), round(avg(words), 6), round(count(*) / (SELECT count(*) FROM d), 6) FROM d GROUP BY lang
UNION ALL SELECT 'type', coalesce(document_type, ''), count(*), count(DISTINCT topic_key), round(avg(words), 6), round(count(*) / (SELECT count(*) FROM d), 6) FROM d GROUP BY document_type""")
def m20_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the whole collection, of each language and of each type of document: one scan, three groupings."""
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("document_type", F.lit("")).alias("type"), "topic_key", X.word_count(F.col("text")).alias("words"))
    each = F.array(F.struct(F.lit("all").alias("part"), F.lit("").alias("name")), F.struct(F.lit("language").alias("part"), F.col("language").alias("name")), F.struct(F.lit("type").alias("part"), F.col("type").alias("name")))
    counted = d.select(F.explode(each).alias("g"), "topic_key", "words").groupBy("g.part", "g.name").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("topic_key").alias("topics"), F.round(F.avg("words"), 6).alias("mean_words"))
    total = d.agg(F.count(F.lit(1)).alias("n"))
    return counted.select("part", "name", "documents", "topics", "mean_words", F.round(F.col("documents") / total.scalar(), 6).alias("share"))


@query("SELECT coalesce(p, 'all patterns') AS pattern, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p, (len(text) - len(replace(text, p, ''))) / len(p) AS n FROM documents, (VALUES ('audit'), ('budget'), ('no such words')) v(p) WHERE text IS NOT NULL) GROUP BY ROLLUP (p)")
def g32_find_all_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of each pattern over the whole corpus, and of all of them."""
    return textquery.totals(textquery.run('findall audit budget "no such words"', table(spark, sf, "documents"), "doc_id", "text"))


@query("WITH n AS (SELECT count(n_chars) AS n FROM documents), s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i FROM documents WHERE n_chars IS NOT NULL) SELECT max(n_chars) FILTER (i = floor(n * 0.025)) AS low, max(n_chars) FILTER (i = floor(n * 0.5)) AS middle, max(n_chars) FILTER (i = floor(n * 0.975)) AS high FROM s, n")
def a13_stored_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles that are values of the table: those at places floor(n * p) of the order."""
    return E.stored_percentiles(table(spark, sf, "documents"), "n_chars", low=0.025, middle=0.5, high=0.975)
