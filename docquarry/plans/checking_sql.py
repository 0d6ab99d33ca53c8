"""SQL for queries whose operators are algorithms: the same results from first principles, by enumeration or recursion."""

from __future__ import annotations

from docquarry.functions.text import STOPWORDS
from docquarry.plans.search_queries import _TOKENS

QUERIES: dict = {}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

# term weights

_GRAMS = "list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def _weights(longest: int, docs: str) -> str:
    """d(doc, term, w) of unit length and idf(term, v), from a table of doc_id and text."""
    own = f"list_filter({_TOKENS.format('text')}, lambda t: len(t) >= 2 AND t NOT IN ({_STOP}))"
    grams = _GRAMS.format(w="w") if longest == 2 else "w"
    return f"""docs AS ({docs}), tk AS (SELECT doc_id, {own} AS w FROM docs), g AS (SELECT doc_id, unnest({grams}) AS term FROM tk),
tf AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS v FROM tf GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT doc_id, term, (1 + ln(n)) * v AS w FROM tf JOIN idf USING (term)),
d AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


_DOCS = "SELECT doc_id, text, topic_key FROM documents WHERE text IS NOT NULL"
_RUN = (
    _weights(2, _DOCS)
    + f""", qs AS (SELECT topic_id, topic_key, regexp_replace(concat_ws(' ', title, array_to_string(keywords, ' ')), '\\{{year\\}}', '', 'g') AS text FROM topics),
qw AS (SELECT topic_id, list_filter({_TOKENS.format("text")}, lambda t: len(t) >= 2 AND t NOT IN ({_STOP})) AS w FROM qs),
qg AS (SELECT topic_id, unnest({_GRAMS.format(w="w")}) AS term FROM qw), qf AS (SELECT topic_id, term, count(*) AS n FROM qg GROUP BY ALL),
qr AS (SELECT topic_id, term, (1 + ln(n)) * v AS w FROM qf JOIN idf USING (term)), q AS (SELECT topic_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic_id)) AS w FROM qr),
scored AS (SELECT q.topic_id AS query_id, d.doc_id, round(sum(q.w * d.w), 9) AS score FROM q JOIN d USING (term) GROUP BY ALL HAVING round(sum(q.w * d.w), 9) > 0),
run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored QUALIFY rank <= 10),
rel AS (SELECT DISTINCT t.topic_id AS query_id, x.doc_id FROM topics t JOIN docs x ON x.topic_key = t.topic_key)"""
)


def _metrics(name: str, run: str, rel: str) -> str:
    """One row of macro averages, in a CTE of that name."""
    cuts = (1, 3, 5, 10)
    found = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in cuts)
    ideal = lambda k: f"list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1)))"
    means = ", ".join([f"round(avg(coalesce(h{k} / n, 0)), 6) AS recall_{k}" for k in cuts] + [f"round(avg(coalesce(g{k} / {ideal(k)}, 0)), 6) AS ndcg_{k}" for k in cuts])
    return f"""{name}_n AS (SELECT query_id, count(*) AS n FROM {rel} GROUP BY 1),
{name}_h AS (SELECT query_id, min(rank) AS best, {found} FROM {run} JOIN {rel} USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
{name} AS (SELECT count(*) AS queries, round(avg(coalesce(1 / best, 0)), 6) AS rr, {means} FROM {name}_n LEFT JOIN {name}_h USING (query_id))"""


_WORDS = """ws AS (SELECT DISTINCT t.topic_id AS query_id, x.doc_id, t.w FROM documents x JOIN (SELECT topic_id, unnest(keywords) AS w FROM topics) t ON contains(lower(x.title), t.w)),
wb AS (SELECT query_id, doc_id, count(*) AS score FROM ws GROUP BY ALL), wrun AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM wb),
wrel AS (SELECT DISTINCT t.topic_id AS query_id, x.doc_id FROM topics t JOIN documents x ON x.topic_key = t.topic_key)"""

# flows: suppliers of a nation are few, so every set of them can be the source's side

_NETWORK = """e AS (SELECT CAST(s.s_nationkey AS BIGINT) AS graph, l.l_suppkey AS u, l.l_partkey % 50 AS v, CAST(sum(l_quantity) AS BIGINT) AS c FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY ALL),
us AS (SELECT graph, u, CAST(row_number() OVER (PARTITION BY graph ORDER BY u) - 1 AS INT) AS i FROM (SELECT DISTINCT graph, u FROM e)),
k AS (SELECT graph, count(*) AS k FROM us GROUP BY 1), vs AS (SELECT DISTINCT graph, v FROM e),
masks AS (SELECT graph, k, unnest(range(0, CAST(pow(2, k) AS BIGINT))) AS mask FROM k),
reach AS (SELECT m.graph, m.mask, e.v, sum(e.c) AS c, count(*) AS n FROM masks m JOIN us ON us.graph = m.graph AND (m.mask >> us.i) & 1 = 1 JOIN e ON e.graph = us.graph AND e.u = us.u GROUP BY ALL),
part AS (SELECT graph, mask, sum(least(c, 100)) AS w, count(*) AS reached, count(*) FILTER (c > 100) AS inside, sum(CASE WHEN c > 100 THEN 1 ELSE n END) AS edges FROM reach GROUP BY ALL),
cut AS (SELECT m.graph, m.mask, (m.k - bit_count(m.mask)) * 1000 + coalesce(w, 0) AS flow, m.k - bit_count(m.mask) + coalesce(edges, 0) AS edges, 1 + bit_count(m.mask) + coalesce(inside, 0) AS side, m.k - bit_count(m.mask) + coalesce(reached, 0) AS met FROM masks m LEFT JOIN part p ON p.graph = m.graph AND p.mask = m.mask),
least_cut AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY graph ORDER BY flow, side) = 1)"""

_JOBS = """WITH RECURSIVE j AS (SELECT c.c_nationkey AS g, o.o_orderkey AS o, CAST(round(o.o_totalprice) AS BIGINT) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
a AS (SELECT g, list(n ORDER BY o) AS listed, list(n ORDER BY n DESC) AS longest, sum(n) AS s, max(n) AS m FROM j GROUP BY g),
step(g, k, x, y) AS (SELECT g, 0, [0::BIGINT, 0, 0, 0], [0::BIGINT, 0, 0, 0] FROM a
  UNION ALL SELECT s.g, k + 1, list_sort(list_append(x[2:], x[1] + listed[k + 1])), list_sort(list_append(y[2:], y[1] + longest[k + 1])) FROM step s JOIN a ON a.g = s.g WHERE k < len(listed))
SELECT a.g AS "group", x[4] AS listed, y[4] AS longest_first, CAST(greatest(ceil(a.s / 4), m) AS BIGINT) AS bound FROM step JOIN a ON a.g = step.g WHERE k = len(listed)"""

# strings: every substring

_REPEAT = """subs AS (SELECT topic_id, substr(summary, i, n) AS x FROM (SELECT topic_id, summary, i, unnest(range(1, len(summary) - i + 2)) AS n FROM (SELECT topic_id, summary, unnest(range(1, len(summary) + 1)) AS i FROM topics))),
twice AS (SELECT topic_id, x FROM subs GROUP BY ALL HAVING count(*) > 1),
best AS (SELECT topic_id, x FROM twice QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY len(x) DESC, x) = 1)"""

_GOLDEN, _M1, _M2, _TWO64 = "11400714819323198485", "13787848793156543929", "10723151780598845931", "18446744073709551616"
_MIX1 = f"CAST((xor(z, z >> 30)::UHUGEINT * {_M1}::UHUGEINT) % {_TWO64}::UHUGEINT AS UBIGINT)"
_MIX2 = f"CAST((xor(z, z >> 27)::UHUGEINT * {_M2}::UHUGEINT) % {_TWO64}::UHUGEINT AS UBIGINT)"

SQL = {
    "v13_tfidf_run": f"WITH {_RUN} SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM run",
    "m01_retrieval_metrics": f"WITH {_RUN}, {_metrics('m', 'run', 'rel')} SELECT * FROM m",
    "m21_runs_compared": f"""WITH {_RUN}, {_WORDS}, {_metrics('b', 'run', 'rel')}, {_metrics('a', 'wrun', 'wrel')}
SELECT metric, words, tfidf, round(tfidf - words, 6) AS gain FROM (SELECT unnest(['rr', 'recall_10', 'ndcg_10']) AS metric, unnest([a.rr, a.recall_10, a.ndcg_10]) AS words, unnest([b.rr, b.recall_10, b.ndcg_10]) AS tfidf FROM a, b)""",
    "m18_distinctive_terms": f"""WITH {_weights(1, "SELECT doc_id, text, category_id FROM documents WHERE text IS NOT NULL AND category_id IS NOT NULL")},
s AS (SELECT category_id, count(*) AS n FROM docs GROUP BY 1), o AS (SELECT term, sum(w) AS w FROM d GROUP BY 1), h AS (SELECT category_id, term, sum(w) AS w FROM d JOIN docs USING (doc_id) GROUP BY ALL),
l AS (SELECT category_id, term, round(h.w / s.n - o.w / (SELECT count(*) FROM docs), 9) AS lift FROM h JOIN s USING (category_id) JOIN o USING (term))
SELECT category_id, term, round(lift, 6) AS lift, CAST(row_number() OVER (PARTITION BY category_id ORDER BY lift DESC, term) AS INT) AS rank FROM l QUALIFY rank <= 5""",
    "m04_deterministic_subset": """WITH d AS (SELECT doc_id, topic_key FROM documents WHERE text IS NOT NULL), q AS (SELECT topic_id, topic_key FROM topics ORDER BY md5('20260912:' || topic_id), topic_id LIMIT 20),
o AS (SELECT doc_id FROM d WHERE topic_key IS NULL OR topic_key NOT IN (SELECT topic_key FROM topics) ORDER BY md5('20260912:' || doc_id), doc_id LIMIT 50)
SELECT doc_id FROM d WHERE topic_key IN (SELECT topic_key FROM q) UNION ALL SELECT doc_id FROM o""",
    "g18_max_flow_per_nation": f"WITH {_NETWORK} SELECT graph, CAST(flow AS BIGINT) AS max_flow, CAST(side AS INT) AS side FROM least_cut",
    "g20_bottlenecks": f"WITH {_NETWORK} SELECT graph, CAST(edges AS BIGINT) AS edges, CAST(flow AS BIGINT) AS weight FROM least_cut",
    "g21_matching_per_nation": f"WITH {_NETWORK} SELECT graph, CAST(min(met) AS BIGINT) AS size FROM cut GROUP BY graph",
    "g23_schedules": _JOBS,
    "g27_reservoir_per_type": f"""WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
s AS (SELECT *, CAST((7::UHUGEINT + CAST(i - 19 AS UHUGEINT) * {_GOLDEN}::UHUGEINT) % {_TWO64}::UHUGEINT AS UBIGINT) AS z FROM n WHERE i >= 20),
a AS (SELECT event_type, event_id, i, {_MIX1} AS z FROM s), b AS (SELECT event_type, event_id, i, {_MIX2} AS z FROM a),
j AS (SELECT event_type, event_id, i, CAST(xor(z, z >> 31) % CAST(i + 1 AS UBIGINT) AS BIGINT) AS slot FROM b),
k AS (SELECT event_type, event_id, i, i AS slot FROM n WHERE i < 20 UNION ALL SELECT event_type, event_id, i, slot FROM j WHERE slot < 20)
SELECT event_type, event_id FROM k QUALIFY row_number() OVER (PARTITION BY event_type, slot ORDER BY i DESC) = 1""",
    "g07_longest_repeats": f"""WITH {_REPEAT},
zs AS (SELECT topic_id, s, i, list_count(list_filter(range(1, len(s) - i + 1), lambda n: substr(s, 1, n) = substr(s, i + 1, n))) AS z FROM (SELECT topic_id, summary AS s, unnest(range(1, len(summary))) AS i FROM topics)),
border AS (SELECT topic_id, max(z) AS b FROM zs GROUP BY 1)
SELECT t.topic_id, CASE WHEN summary IS NOT NULL THEN coalesce(best.x, '') END AS repeat, CASE WHEN len(summary) > 0 THEN coalesce(len(best.x), 0) END AS length, CASE WHEN len(summary) > 0 THEN coalesce(b, 0) END AS border,
  array_to_string(list_transform(range(0, len(topic_key)), lambda i: CASE WHEN i = 0 THEN len(topic_key) ELSE len(list_filter(range(1, len(topic_key) - i + 1), lambda n: substr(topic_key, 1, n) = substr(topic_key, i + 1, n))) END), ',') AS z
FROM topics t LEFT JOIN best ON best.topic_id = t.topic_id LEFT JOIN border ON border.topic_id = t.topic_id""",
    "g33_pattern_report": f"""WITH {_REPEAT}
SELECT t.topic_id, CASE WHEN summary IS NOT NULL THEN coalesce(best.x, '') END AS repeat, coalesce((len(summary) - len(replace(summary, 'on', ''))) // 2 + (len(summary) - len(replace(summary, 'and', ''))) // 3 + (len(summary) - len(replace(summary, 'Texts', ''))) // 5, 0) AS n
FROM topics t LEFT JOIN best ON best.topic_id = t.topic_id""",
    "m14_dbscan": """WITH RECURSIVE v AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT i, x, sqrt(list_dot_product(x, x)) AS n FROM v),
c AS (SELECT a.i AS a, b.i AS b, list_dot_product(a.x, b.x) / (a.n * b.n) AS c FROM n a, n b),
five AS (SELECT a, round(greatest(0, 1 - round(c, 12)), 4) AS d FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) = 5),
curve AS (SELECT p / 200 AS s, list_extract(q, CAST(p + 1 AS INT)) AS d FROM (SELECT unnest(range(0, 201)) AS p), (SELECT quantile_cont(d, list_transform(range(0, 201), lambda i: i / 200)) AS q FROM five)),
ends AS (SELECT min(d) AS y0, max(d) AS y1, arg_min(d, s) AS a, arg_max(d, s) AS b FROM curve),
eps AS (SELECT d AS e FROM curve, ends ORDER BY abs(((d - y0) / (y1 - y0) - (a - y0) / (y1 - y0)) - s * ((b - y0) / (y1 - y0) - (a - y0) / (y1 - y0))) DESC, s LIMIT 1),
l AS (SELECT a, b FROM c, eps WHERE a <> b AND 1 - c <= e),
core AS (SELECT a FROM l GROUP BY a HAVING count(*) + 1 >= 5), inner_l AS (SELECT a, b FROM l WHERE a IN (FROM core) AND b IN (FROM core)),
r(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, inner_l.b FROM r JOIN inner_l ON inner_l.a = r.b), k AS (SELECT a, min(b) AS cluster FROM r GROUP BY a),
edge AS (SELECT a, min(b) AS b FROM l WHERE a NOT IN (FROM core) AND b IN (FROM core) GROUP BY a), every AS (SELECT a, cluster FROM k UNION ALL SELECT edge.a, k.cluster FROM edge JOIN k ON k.a = edge.b)
SELECT coalesce(cluster, -1) AS cluster, count(*) AS n FROM v LEFT JOIN every ON every.a = v.i GROUP BY 1""",
    "s24_seeded_vectors": """SELECT topic_id, CAST(p AS INT) AS place, CAST(('0x' || substr(md5('0:' || topic_id || ':' || p), 1, 6))::BIGINT / 8388608.0::DOUBLE - 1 AS FLOAT) AS value FROM topics, range(0, 64) r(p)""",
}
