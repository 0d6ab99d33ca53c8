"""Search, text and vector queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions.lexical import body_credit, whole_word
from docquarry.functions.vectors import calibrated, cosine, norm
from docquarry.operators.edits import damerau_distance, global_alignment, identity, local_alignment, osa_distance, similarity
from docquarry.operators.vocabulary import fuzzy_matches, prefix_matches, vocabulary
from docquarry.plans.search import SearchSpec, batched_search, best_passages, corrected, filtered_points, merge_ranges, passages, search, snippets, top_points
from docquarry.sources.tables import table, text_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
WORDS, USER = "quarterly budget audit", 1
TYPING = "quartely budgte"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return text_table(spark, sf, "documents"), table(spark, sf, "document_permissions"), table(spark, sf, "categories")


def first_vector(points: DataFrame, dimension: int = 64) -> list[float]:
    """The asking vector of the stored queries: that of the first usable point."""
    ok = points.where(F.size("vector") == dimension).where(F.forall("vector", lambda x: ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    return list(ok.orderBy("point_id").select("vector").first()[0])


_E = r"[^\p{L}\p{Nd}]"


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+')"


def keyword_sql(terms: Sequence[str], fuzzy: bool, source: str = "documents", credit: str = "1.0") -> str:
    """Scored documents for terms given as SQL expressions: phrase, coverage, gate; with fuzzy also begun and misspelt words."""
    n, phrase = len(terms), " || ' ' || ".join(terms)
    need = n if n <= 2 else -(-6 * n // 10)
    edge = f"({_E}|^)", f"({_E}|$)"
    allowed = lambda t: f"(CASE WHEN len({t}) <= 3 THEN 0 WHEN len({t}) <= 5 THEN 1 ELSE 2 END)"
    edits = lambda t: f"damerau_levenshtein(regexp_replace(x, '[^\\x00-\\x7F]', '?', 'g'), {t})"

    def fits(c: str, weight: str, partial: bool) -> tuple[str, str]:
        exact = f"regexp_matches({c}_low, '{edge[0]}' || {phrase} || '{edge[1]}')"
        begun = f"(NOT {exact} AND len({terms[-1]}) >= 3 AND regexp_matches({c}_low, '{edge[0]}' || {phrase}))" if partial else "false"
        return f"CASE WHEN {exact} THEN {weight}::DOUBLE WHEN {begun} THEN {weight}::DOUBLE * 0.85::DOUBLE ELSE 0 END", begun

    def field(c: str, t: str) -> str:
        if not fuzzy:
            return f"CAST(list_contains({c}_words, {t}) AS DOUBLE)"
        begun = f"CASE WHEN len({t}) >= 3 THEN 0.5 + 0.5 * len({t}) / list_min(list_transform(list_filter({c}_words, lambda x: starts_with(x, {t}) AND len(x) > len({t})), lambda x: len(x))) END"
        near = f"list_max(list_transform(list_filter({c}_words, lambda x: {allowed(t)} > 0 AND abs(len(x) - len({t})) <= {allowed(t)} AND {edits(t)} <= {allowed(t)}), lambda x: 1 - {edits(t)} / greatest(len(x), len({t}))))"
        return f"CASE WHEN list_contains({c}_words, {t}) THEN 1.0::DOUBLE ELSE greatest(coalesce({begun}, 0), coalesce({near}, 0))::DOUBLE END"

    def body(t: str) -> str:
        start = f"WHEN len({t}) >= 3 AND regexp_matches(text_low, '{edge[0]}' || {t}) THEN 0.8" if fuzzy else ""
        return f"0.9::DOUBLE * CASE WHEN list_contains(text_words, {t}) THEN 1.0 {start} ELSE 0.0 END::DOUBLE"

    (title, title_begun), (described, described_begun), (bodied, _) = fits("title", "1.0", fuzzy), fits("description", "0.95", fuzzy), fits("text", "0.9", False)
    credits = ", ".join(f"{field('title', t)} AS a{i}, 0.95::DOUBLE * {field('description', t)} AS b{i}, {body(t)} AS c{i}" for i, t in enumerate(terms))
    best = [f"greatest(a{i}, b{i}, c{i})" for i in range(n)]
    loose = [f"({best[i]} > 0 AND CASE WHEN c{i} > greatest(a{i}, b{i}) THEN c{i} < 0.9::DOUBLE WHEN b{i} > a{i} THEN b{i} < 0.95::DOUBLE ELSE a{i} < 1 END)" for i in range(n)]
    words = ", ".join(f"lower(coalesce({c}, '')) AS {c}_low, {_TOKENS.format(f'coalesce({c}, {chr(39) * 2})')} AS {c}_words" for c in ("title", "description", "text"))
    return f"""SELECT *, {credit} * raw AS score, fuzzy OR {credit} < 1 AS is_fuzzy FROM (SELECT doc_id, title, category_id, status, owner_id,
    CASE WHEN by_phrase THEN phrase ELSE coverage END AS raw, CASE WHEN by_phrase THEN {n} ELSE found END AS matched,
    CASE WHEN by_phrase THEN phrase > 0 AND phrase > p3 AND CASE WHEN p1 >= p2 THEN g1 ELSE g2 END ELSE loose END AS fuzzy
  FROM (SELECT *, greatest(p1, p2, p3) AS phrase, 0.95::DOUBLE * (({' + '.join(best)}) / {n}) AS coverage, {' + '.join(f'CAST({b} > 0 AS INT)' for b in best)} AS found, {' OR '.join(loose)} AS loose,
      greatest(p1, p2, p3) = 1 OR greatest(p1, p2, p3) >= 0.95::DOUBLE * (({' + '.join(best)}) / {n}) AS by_phrase
    FROM (SELECT *, {title} AS p1, {title_begun} AS g1, {described} AS p2, {described_begun} AS g2, {bodied} AS p3, {credits}
      FROM (SELECT *, {words} FROM {source} WHERE deleted_at IS NULL)))) WHERE raw > 0 AND matched >= {need}"""


def _quoted(words: str) -> list[str]:
    return [f"'{w}'" for w in words.split()]


_KEYWORD, _FUZZY = keyword_sql(_quoted(WORDS), False), keyword_sql(_quoted(WORDS), True)


_READ = f"(owner_id = {USER} OR doc_id IN (SELECT document_id FROM document_permissions WHERE user_id = {USER} AND upper(permission_type) = 'READ' AND document_id IS NOT NULL))"


@query(f"SELECT doc_id, title, round(score, 6) AS score FROM ({_KEYWORD})")
def s01_keyword_search_all(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    return search(SearchSpec(WORDS, mode="KEYWORD", admin=True), d, g, c, paged=False).select("doc_id", "title", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_KEYWORD}) WHERE {_READ} AND status = 'INDEXED' ORDER BY score DESC, doc_id LIMIT 10")
def s02_keyword_page_of_user(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    return search(SearchSpec(WORDS, mode="KEYWORD", user=USER, status="INDEXED"), d, g, c).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score, concat_ws(',', 'KEYWORD', CASE WHEN is_fuzzy THEN 'FUZZY' END) AS matched_by FROM ({keyword_sql(_quoted(TYPING), True)})")
def s03_fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    return search(SearchSpec(TYPING, mode="FUZZY", admin=True), d, g, c, paged=False).select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched_by", ",").alias("matched_by"))


_VOCABULARY = "SELECT w AS word, count(*) AS n_docs FROM (SELECT unnest(list_distinct(list_filter(list_concat(list_concat(" + ", ".join(_TOKENS.format(f"coalesce({c}, '')") for c in ("title", "description")) + "), " + _TOKENS.format("coalesce(text, '')") + "), lambda t: len(t) >= 4))) AS w FROM documents) GROUP BY w"
_EDITS = "damerau_levenshtein(regexp_replace(word, '[^\\x00-\\x7F]', '?', 'g'), term)"
_ALLOWED = "CASE WHEN len(term) <= 3 THEN 0 WHEN len(term) <= 5 THEN 1 ELSE 2 END"
_FIXED = f"""v AS ({_VOCABULARY}), t AS (SELECT * FROM (VALUES (1, '{TYPING.split()[0]}'), (2, '{TYPING.split()[1]}')) t(i, term)),
m AS (SELECT i, term, word, n_docs, 1 - {_EDITS} / greatest(len(term), len(word)) AS credit FROM t JOIN v ON abs(len(term) - len(word)) <= {_ALLOWED} AND {_EDITS} <= {_ALLOWED}
  WHERE NOT EXISTS (SELECT 1 FROM v k WHERE starts_with(k.word, term)) QUALIFY row_number() OVER (PARTITION BY i ORDER BY 1 - {_EDITS} / greatest(len(term), len(word)) DESC, n_docs DESC, word) = 1),
x AS (SELECT max(coalesce(word, t.term)) FILTER (t.i = 1) AS t1, max(coalesce(word, t.term)) FILTER (t.i = 2) AS t2, coalesce(min(credit), 1.0) AS credit FROM t LEFT JOIN m ON m.i = t.i),
f AS (SELECT d.*, x.t1, x.t2, x.credit FROM documents d, x)"""


@query(f"WITH {_FIXED} SELECT k.doc_id, round(k.score, 6) AS score, x.t1 || ' ' || x.t2 AS asked FROM ({keyword_sql(['t1', 't2'], True, 'f', 'credit').replace('SELECT doc_id, title, category_id, status, owner_id,', 'SELECT doc_id, title, category_id, status, owner_id, credit,')}) k, x")
def s04_corrected_search(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    spec = corrected(SearchSpec(TYPING, mode="FUZZY", admin=True), vocabulary(d, "title", "description", "text"))
    return search(spec, d, g, c, paged=False).select("doc_id", F.round("score", 6).alias("score"), F.lit(spec.query).alias("asked"))


_USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_POINTS = f"""WITH u AS (SELECT * FROM chunk_vectors WHERE {_USABLE}), q AS (SELECT CAST(vector AS DOUBLE[]) AS v FROM u ORDER BY point_id LIMIT 1),
s AS (SELECT u.*, list_dot_product(CAST(u.vector AS DOUBLE[]), q.v) / (sqrt(list_dot_product(CAST(u.vector AS DOUBLE[]), CAST(u.vector AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v))) AS c FROM u, q) """


@query(_POINTS + "SELECT point_id, round(c, 6) AS cosine FROM s ORDER BY c DESC, point_id LIMIT 20")
def v01_nearest_points(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors")
    return top_points(v, first_vector(v), 20, 64).select("point_id", F.round("cosine", 6).alias("cosine"))


@query(_POINTS + "SELECT point_id, round(c, 6) AS cosine FROM s WHERE department = 'Legal' AND processing_status = 'INDEXED' ORDER BY c DESC, point_id LIMIT 20")
def v02_filtered_nearest_points(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors")
    return top_points(filtered_points(v, department="Legal", processing_status="INDEXED"), first_vector(v), 20, 64).select("point_id", F.round("cosine", 6).alias("cosine"))


@query(_POINTS + "SELECT postgres_document_id AS doc_id, chunk_id, round(c, 6) AS cosine FROM s WHERE postgres_document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY postgres_document_id ORDER BY c DESC, point_id) = 1")
def a08_best_chunk_per_document(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors")
    from docquarry.functions.vectors import cosine_to

    scored = v.where("postgres_document_id is not null").select(F.col("postgres_document_id").alias("doc_id"), "chunk_id", "point_id", cosine_to(F.col("vector"), first_vector(v)).alias("c")).where("c is not null and not isnan(c)")
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("chunk_id", "c"), F.struct("c", -F.col("point_id"))).alias("b"))
    return best.select("doc_id", "b.chunk_id", F.round("b.c", 6).alias("cosine"))


@query(_POINTS + f"""SELECT point_id, doc_id FROM (SELECT s.point_id, s.c, d.doc_id, d.owner_id FROM (SELECT * FROM s ORDER BY c DESC, point_id LIMIT 200) s JOIN documents d ON d.doc_id = s.postgres_document_id) WHERE {_READ}""")
def j19_rights_after_nearest(spark: SparkSession, sf: str) -> DataFrame:
    from docquarry.operators.access import readable

    v = table(spark, sf, "chunk_vectors")
    near = top_points(v, first_vector(v), 200).select("point_id", F.col("postgres_document_id").cast("long").alias("doc_id"))
    d, g, _ = _tables(spark, sf)
    return near.join(readable(d, g, USER).select("doc_id"), "doc_id").select("point_id", "doc_id")


@query(_POINTS + f""", k AS ({_FUZZY}), top AS (SELECT * FROM s ORDER BY c DESC, point_id LIMIT 200),
n AS (SELECT CAST(postgres_document_id AS BIGINT) AS doc_id, max(c) AS c FROM top WHERE postgres_document_id IS NOT NULL GROUP BY 1),
f AS (SELECT coalesce(k.doc_id, n.doc_id) AS doc_id, k.score AS ks, k.is_fuzzy, CASE WHEN n.c IS NOT NULL THEN greatest(0, least(1, (n.c + 1) / 2)) END AS vs FROM k FULL JOIN n ON n.doc_id = k.doc_id)
SELECT f.doc_id, round(greatest(coalesce(ks, vs), coalesce(vs, ks)) + 0.5 * least(coalesce(ks, 0), coalesce(vs, 0)) * (1 - greatest(coalesce(ks, vs), coalesce(vs, ks))), 6) AS score,
  concat_ws(',', CASE WHEN ks IS NOT NULL THEN 'KEYWORD' END, CASE WHEN is_fuzzy THEN 'FUZZY' END, CASE WHEN vs IS NOT NULL THEN 'VECTOR' END) AS matched_by
FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE d.deleted_at IS NULL""")
def s05_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    v = table(spark, sf, "chunk_vectors")
    found = search(SearchSpec(WORDS, first_vector(v), admin=True), d, g, c, v, paged=False)
    return found.select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched_by", ",").alias("matched_by"))


@query(_POINTS + """, top AS (SELECT * FROM s ORDER BY c DESC, point_id LIMIT 200), n AS (SELECT postgres_document_id AS id, max(c) AS c FROM top WHERE postgres_document_id IS NOT NULL GROUP BY 1),
j AS (SELECT d.doc_id, n.c FROM n JOIN documents d ON d.doc_id = n.id WHERE d.deleted_at IS NULL)
SELECT doc_id, round(greatest(0, least(0.95, (c - 0.10::DOUBLE) / 0.60::DOUBLE)), 6) AS score FROM j WHERE c >= greatest(0.20, (SELECT max(c) FROM j) - 0.15)""")
def s06_semantic_search_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    v = table(spark, sf, "chunk_vectors")
    return search(SearchSpec("", first_vector(v), mode="SEMANTIC", admin=True, server_made=True), d, g, c, v, paged=False).select("doc_id", F.round("score", 6).alias("score"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").where("postgres_document_id is not null and chunks is not null")
    return k.select(F.col("postgres_document_id").cast("long").alias("doc_id"), "kd_id", "chunks")


_HITS = _POINTS + f""", k AS ({_FUZZY}), top AS (SELECT * FROM s ORDER BY c DESC, point_id LIMIT 200),
n AS (SELECT CAST(postgres_document_id AS BIGINT) AS doc_id, max(c) AS c, arg_max(chunk_id, c) AS chunk_id FROM top WHERE postgres_document_id IS NOT NULL GROUP BY 1),
f AS (SELECT coalesce(k.doc_id, n.doc_id) AS doc_id, k.score AS ks, n.chunk_id, CASE WHEN n.c IS NOT NULL THEN greatest(0, least(1, (n.c + 1) / 2)) END AS vs FROM k FULL JOIN n ON n.doc_id = k.doc_id),
h AS (SELECT f.doc_id, f.chunk_id, d.title, d.description, d.category_id, greatest(coalesce(ks, vs), coalesce(vs, ks)) + 0.5 * least(coalesce(ks, 0), coalesce(vs, 0)) * (1 - greatest(coalesce(ks, vs), coalesce(vs, ks))) AS score
  FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE d.deleted_at IS NULL ORDER BY score DESC, f.doc_id LIMIT 20),
r AS (SELECT CAST(postgres_document_id AS BIGINT) AS doc_id, arg_min(chunks, kd_id) FILTER (true) AS chunks FROM knowledge_documents WHERE postgres_document_id IS NOT NULL AND chunks IS NOT NULL GROUP BY 1),
c AS (SELECT doc_id, unnest(chunks) AS c FROM r),
w AS (SELECT doc_id, c."text" AS t, coalesce(c."position", 0) AS p, {' + '.join(f"CAST(regexp_matches(lower(c.{chr(34)}text{chr(34)}), '({_E}|^){t}') AS INT)" for t in WORDS.split())}
  + CASE WHEN regexp_matches(lower(c."text"), '({_E}|^){WORDS.replace(' ', chr(92) + 's+')}({_E}|$)') THEN 3 ELSE 0 END AS s FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, t) AS early FROM w WHERE s > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, p, t) AS place FROM e WHERE early <= 8)"""


@query(_HITS + """ SELECT h.doc_id, coalesce((SELECT t FROM o WHERE o.doc_id = h.doc_id AND place = 1), (SELECT min(c.c."text") FROM c WHERE c.doc_id = h.doc_id AND c.c.chunk_id = h.chunk_id)) AS best FROM h""")
def s07_chunks_for_snippets(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    v = table(spark, sf, "chunk_vectors")
    page = search(SearchSpec(WORDS, first_vector(v), admin=True, size=20), d, g, c, v)
    return best_passages(page, _stored(spark, sf), WORDS).select("doc_id", "best")


@query()
def s07_page_with_snippets(spark: SparkSession, sf: str) -> DataFrame:
    d, g, c = _tables(spark, sf)
    v = table(spark, sf, "chunk_vectors")
    page = search(SearchSpec(WORDS, first_vector(v), admin=True, size=20), d, g, c, v)
    return snippets(best_passages(page, _stored(spark, sf), WORDS), "best", WORDS).select("doc_id", "snippet", "marks")


@query(_HITS + """, five AS (SELECT * FROM h ORDER BY score DESC, doc_id LIMIT 5), part AS (
  SELECT five.doc_id, o.place AS i, trim(o.t) AS t FROM five JOIN o ON o.doc_id = five.doc_id AND o.place <= 2
  UNION ALL SELECT five.doc_id, 3, trim(c.c."text") FROM five JOIN c ON c.doc_id = five.doc_id AND c.c.chunk_id = five.chunk_id),
once AS (SELECT doc_id, t, min(i) AS i FROM part WHERE t <> '' GROUP BY doc_id, t),
p AS (SELECT five.doc_id, score, title, category_id, coalesce((SELECT string_agg(t, chr(10) || '…' || chr(10) ORDER BY i) FROM once WHERE once.doc_id = five.doc_id), description) AS passage FROM five)
SELECT p.doc_id, '[' || row_number() OVER (ORDER BY score DESC, p.doc_id) || '] ' || coalesce(title, '') || coalesce(' (' || g.name || ')', '') || chr(10) || CASE WHEN len(passage) > 2400 THEN substr(passage, 1, 2400) || '…' ELSE passage END AS prompt
FROM p LEFT JOIN categories g ON g.id = p.category_id WHERE trim(passage) <> ''""")
def s08_passages_for_an_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The best five documents with their keyword chunks and the chunk the vectors found, numbered, cut to what a prompt holds."""
    d, g, c = _tables(spark, sf)
    v = table(spark, sf, "chunk_vectors")
    page = search(SearchSpec(WORDS, first_vector(v), admin=True, size=5), d, g, c, v).join(d.select("doc_id", "description"), "doc_id")
    # five rows at most are numbered
    numbered = passages(page, _stored(spark, sf), WORDS).withColumn("number", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    head = F.concat(F.format_string("[%d] ", "number"), F.coalesce("title", F.lit("")), F.coalesce(F.concat(F.lit(" ("), "category", F.lit(")")), F.lit("")))
    return numbered.select("doc_id", F.concat(head, F.lit("\n"), "passage").alias("prompt"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])))), 12) AS c FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0)
SELECT query_id, point_id, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, point_id) <= 5""")
def v12_batched_exact_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    asked = e.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector")
    return batched_search(asked, e, 5, 64).select("query_id", "point_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT point_id, round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 5) AS norm FROM chunk_vectors WHERE {_USABLE}")
def v04_norms_of_usable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return table(spark, sf, "chunk_vectors").where(ok).select("point_id", F.round(norm(F.col("vector")), 5).alias("norm"))


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def v07_cosine_to_first(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first = F.array(*(F.lit(float(x)) for x in e.orderBy("vec_id").select("embedding").first()[0]))
    return e.select("vec_id", F.round(cosine(F.col("embedding"), first), 6).alias("cosine"))


@query("SELECT vec_id, round(greatest(0, least(0.95, (CAST(embedding[1] AS DOUBLE) - 0.10::DOUBLE) / 0.60::DOUBLE)), 6) AS server, round(greatest(0, least(1, (CAST(embedding[1] AS DOUBLE) + 1) / 2)), 6) AS caller FROM embeddings")
def v07_calibrated_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("embedding")[0].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(calibrated(c, True), 6).alias("server"), F.round(calibrated(c, False), 6).alias("caller"))


# text




@query(f"SELECT doc_id, len({_TOKENS.format('title')}) AS n, array_to_string({_TOKENS.format('title')}, ' ') AS tokens FROM documents WHERE title IS NOT NULL")
def x02_tokens_of_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = X.tokens(F.col("title"))
    return table(spark, sf, "documents").where("title is not null").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(f"SELECT topic_id, array_to_string(list_sort(list_distinct(list_filter({_TOKENS.format('title')}, lambda t: len(t) >= 2 AND t NOT IN ({_STOP})))), ' ') AS terms FROM topics")
def x03_terms_of_topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select("topic_id", F.array_join(F.sort_array(X.terms(F.col("title"))), " ").alias("terms"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 40) / 140.0) AS INT)) END AS k FROM w),
c AS (SELECT doc_id, w, CAST(unnest(range(0, k)) AS INT) AS position FROM n)
SELECT doc_id, position, CAST(len(w[position * 140 + 1 : position * 140 + 180]) AS INT) AS token_count, array_to_string(w[position * 140 + 1 : position * 140 + 180], ' ') AS text FROM c""")
def x05_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = text_table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("position", "text"))
    return c.select("doc_id", "position", X.word_count(F.col("text")).alias("token_count"), "text")


@query("SELECT doc_id, CAST(len(text) AS INT) AS chars, 'doc' || doc_id || '-chunk1' AS first_chunk FROM documents WHERE text IS NOT NULL")
def x08_counts_and_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"), X.chunk_id(F.col("doc_id"), F.lit(0)).alias("first_chunk"))


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|{_E})audit($|{_E})') THEN 1.0 WHEN regexp_matches(lower(coalesce(text, '')), '(^|{_E})audit') THEN 0.8 ELSE 0.0 END::DOUBLE AS credit FROM documents")
def x11_body_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", body_credit(F.col("text"), "audit").alias("credit"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(coalesce(title, ''), '\s*\([A-Z]\)\s*$', '') || '. ' || coalesce(description, '') || chr(10) || coalesce(text, ''), '[0-9]', '0', 'g') AS text FROM documents")
def x12_feature_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.feature_text(F.col("title"), F.col("description"), F.col("text")).alias("text"))


@query(r"SELECT kd_id, lower(regexp_extract(regexp_extract(source.filename, '([^/\\]*)$', 1), '\.([^.]*)$', 1)) AS extension, regexp_replace(regexp_extract(source.filename, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem FROM knowledge_documents WHERE source.filename IS NOT NULL")
def x13_file_names(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").where("source.filename is not null")
    return k.select("kd_id", X.extension(F.col("source.filename")).alias("extension"), X.stem(F.col("source.filename"), 100_000).alias("stem"))


@query()
def x04_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.clean(F.col("text")).alias("text"))


@query("SELECT id, upper(array_to_string(list_transform(list_filter(regexp_split_to_array(full_name, '\\s+'), lambda x: x <> '')[1:2], lambda w: w[1]), '')) AS initials FROM users WHERE full_name IS NOT NULL")
def x14_initials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "users").where("full_name is not null").select("id", X.initials(F.col("full_name")).alias("initials"))


# vocabulary and edits




@query(_VOCABULARY)
def a07_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(text_table(spark, sf, "documents"), "title", "description", "text")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select(F.explode(X.terms(F.col("title"))).alias("term")).distinct()


_TERM_SQL = f"t AS (SELECT DISTINCT unnest(list_filter({_TOKENS.format('title')}, lambda t: len(t) >= 2 AND t NOT IN ({_STOP}))) AS term FROM topics)"


@query(f"WITH v AS ({_VOCABULARY}), {_TERM_SQL} SELECT term, word, n_docs, CAST({_EDITS} AS INT) AS distance, round(1 - {_EDITS} / greatest(len(term), len(word)), 6) AS credit FROM t JOIN v ON {_ALLOWED} > 0 AND abs(len(term) - len(word)) <= {_ALLOWED} AND {_EDITS} <= {_ALLOWED}")
def j25_fuzzy_vocabulary_join(spark: SparkSession, sf: str) -> DataFrame:
    v = vocabulary(text_table(spark, sf, "documents"), "title", "description", "text")
    return fuzzy_matches(_terms(spark, sf), v).select("term", "word", "n_docs", "distance", F.round("credit", 6).alias("credit"))


@query(f"WITH v AS ({_VOCABULARY}), {_TERM_SQL} SELECT term, word, n_docs, round(0.5 + 0.5 * len(term) / len(word), 6) AS credit FROM t JOIN v ON starts_with(word, term) AND len(word) > len(term) WHERE len(term) >= 3")
def j26_prefix_vocabulary_join(spark: SparkSession, sf: str) -> DataFrame:
    v = vocabulary(text_table(spark, sf, "documents"), "title", "description", "text")
    return prefix_matches(_terms(spark, sf), v).withColumn("credit", F.round("credit", 6))


_PAIRS = "(SELECT a.topic_key AS a, coalesce(a.former_key, a.title) AS b FROM topics a)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select(F.col("topic_key").alias("a"), F.coalesce("former_key", "title").alias("b"))


@query(f"SELECT a, b, CAST(levenshtein(a, b) AS INT) AS distance, round(1 - levenshtein(a, b) / greatest(len(a), len(b)), 6) AS similarity, CAST(damerau_levenshtein(a, b) AS INT) AS damerau FROM {_PAIRS}")
def g09_edit_distances(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf).select("a", "b", F.levenshtein(a, b).alias("distance"), F.round(similarity(a, b), 6).alias("similarity"), damerau_distance(a, b).alias("damerau"))


@query()
def g34_similarity_report(spark: SparkSession, sf: str) -> DataFrame:
    """All distances and alignments of a pair in one row."""
    a, b = F.col("a"), F.col("b")
    both = _pairs(spark, sf).withColumn("whole", global_alignment(a, b)).withColumn("part", local_alignment(a, b))
    return both.select("a", "b", F.levenshtein(a, b).alias("levenshtein"), osa_distance(a, b).alias("osa"), damerau_distance(a, b).alias("damerau"), F.round(similarity(a, b), 6).alias("similarity"), F.col("whole.score").alias("global_score"), F.round(identity(F.col("whole")), 6).alias("identity"), F.col("part.score").alias("local_score"))


@query("""WITH r AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS low, CAST(epoch_us(ts) // 1000000 AS BIGINT) + 21600 AS high FROM events),
m AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(low) AS low, max(high) AS high FROM i GROUP BY user_id, i""")
def w10_merged_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The six hours after each event of a user, overlapping ones as one."""
    low = F.unix_seconds(F.col("ts").cast("timestamp"))
    return merge_ranges(table(spark, sf, "events").select("user_id", low.alias("low"), (low + 21600).alias("high")), "user_id", "low", "high")


@query(rf"SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(title, '')), '(^|{_E})register($|{_E})')")
def x15_whole_word_in_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(whole_word(F.col("title"), "register")).select("doc_id")
