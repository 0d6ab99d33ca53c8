"""Further queries: activity, passages, single documents, features, model comparison."""

from __future__ import annotations

import functools

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions.answers import citations, prefixed, tidy_answer
from docquarry.functions.lexical import whole_word, word_start
from docquarry.functions.registered import register
from docquarry.functions.vectors import cosine_to, hashed_embedding, norm
from docquarry.operators import evaluation as E
from docquarry.operators import learning as L
from docquarry.operators import strings as S
from docquarry.operators.quality import cascaded, edited_everywhere
from docquarry.operators.randomised import MERSENNE_31, universal_text_hash
from docquarry.operators.tfidf import tfidf_run
from docquarry.plans.analysis_queries import CLUSTERS, _fifth_distances, _judged, _labelled, _word_run
from docquarry.plans.relational_queries import _role_permissions, _user_roles
from docquarry.plans.search_queries import first_vector
from docquarry.plans.search import batched_search
from docquarry.session import materialise
from docquarry.sources.tables import table, text_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_E = r"[^\p{L}\p{Nd}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# scans and activity


@query("SELECT doc_id, title FROM documents WHERE doc_id IN (SELECT postgres_document_id FROM chunk_vectors WHERE processing_status = 'FAILED')")
def s02_scan_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "chunk_vectors").where("processing_status = 'FAILED'").select(F.col("postgres_document_id").cast("long").alias("doc_id"))
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "title")


@query("SELECT kd_id, content.raw_text AS raw_text FROM knowledge_documents WHERE content.raw_text IS NOT NULL")
def s03_projected_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge_documents").select("kd_id", F.col("content.raw_text").alias("raw_text")).where("raw_text is not null")


_RECENT = "TIMESTAMPTZ '2023-06-01 00:00:00+00'"


@query(f"""WITH g AS (SELECT p.id, p.user_id, d.doc_id, d.title, u.username AS owner, p.granted_at, d.updated_at, d.created_at FROM document_permissions p JOIN documents d ON d.doc_id = p.document_id LEFT JOIN users u ON u.id = d.owner_id WHERE upper(p.permission_type) = 'READ'),
n AS (SELECT 'SHARED' AS kind, id, user_id, doc_id, title, owner, granted_at AS at_time FROM g WHERE granted_at >= {_RECENT} UNION ALL
      SELECT 'UPDATED', id, user_id, doc_id, title, owner, updated_at FROM g WHERE updated_at >= {_RECENT} AND updated_at > granted_at AND updated_at > created_at + INTERVAL 60 SECOND)
SELECT kind, user_id, doc_id, title, owner, epoch_us(at_time) AS at_us FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_time DESC, kind, id) <= 20""")
def t10_newest_notifications(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the 20 newest: documents shared since, and shared documents changed since, but for the change that an upload itself makes."""
    since = F.lit("2023-06-01 00:00:00").cast("timestamp")
    u = table(spark, sf, "users").select(F.col("id").alias("owner_id"), F.col("username").alias("owner"))
    d = table(spark, sf, "documents").select("doc_id", "title", "owner_id", "updated_at", "created_at")
    g = table(spark, sf, "document_permissions").where(F.upper("permission_type") == "READ").select("id", "user_id", F.col("document_id").cast("long").alias("doc_id"), "granted_at").join(d, "doc_id")
    edited = (F.col("updated_at") >= since) & (F.col("updated_at") > F.col("granted_at")) & (F.unix_micros("updated_at") > F.unix_micros("created_at") + 60_000_000)
    # both kinds from one scan: a grant may give either, or both
    kinds = F.array_compact(F.array(F.when(F.col("granted_at") >= since, F.struct(F.lit("SHARED").alias("kind"), F.col("granted_at").alias("at"))), F.when(edited, F.struct(F.lit("UPDATED").alias("kind"), F.col("updated_at").alias("at")))))
    n = g.select("id", "user_id", "doc_id", "title", "owner_id", F.explode(kinds).alias("n")).select("id", "user_id", "doc_id", "title", "owner_id", "n.*")
    newest = n.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "kind", "id"))).where("r <= 20")
    return newest.join(u, "owner_id", "left").select("kind", "user_id", "doc_id", "title", "owner", F.unix_micros("at").alias("at_us"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE deleted_at IS NOT NULL)
SELECT 'chunk_vectors' AS store, point_id AS id FROM chunk_vectors WHERE postgres_document_id IS NULL OR postgres_document_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'knowledge_documents', kd_id FROM knowledge_documents WHERE postgres_document_id IS NULL OR postgres_document_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'document_permissions', id FROM document_permissions WHERE document_id IS NULL OR document_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'documents', doc_id FROM documents WHERE deleted_at IS NULL""")
def c09_left_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What stays in every store when the deleted documents go, with all that belongs to them, children before parents."""
    documents = table(spark, sf, "documents")
    children = {n: (table(spark, sf, n), key, row) for n, key, row in (("chunk_vectors", "postgres_document_id", "point_id"), ("knowledge_documents", "postgres_document_id", "kd_id"), ("document_permissions", "document_id", "id"))}
    left = cascaded(documents.where("deleted_at is not null"), "doc_id", {n: (df, key) for n, (df, key, _) in children.items()})
    parts = [left[n].select(F.lit(n).alias("store"), F.col(row).cast("long").alias("id")) for n, (_, _, row) in children.items()]
    parts.append(documents.where("deleted_at is null").select(F.lit("documents").alias("store"), F.col("doc_id").alias("id")))
    return functools.reduce(DataFrame.unionByName, parts)


@query("""WITH e AS (SELECT doc_id FROM documents WHERE title IS NULL)
SELECT 'documents' AS store, doc_id AS id, coalesce(title, 'Untitled ' || doc_id) AS title FROM documents
UNION ALL SELECT 'knowledge_documents', kd_id, CASE WHEN postgres_document_id IN (SELECT doc_id FROM e) THEN 'Untitled ' || postgres_document_id ELSE title END FROM knowledge_documents
UNION ALL SELECT 'chunk_vectors', point_id, CASE WHEN postgres_document_id IN (SELECT doc_id FROM e) THEN 'Untitled ' || postgres_document_id ELSE title END FROM chunk_vectors""")
def c08_titles_after_edit(spark: SparkSession, sf: str) -> DataFrame:
    """An edit of documents carried to the other stores."""
    d = table(spark, sf, "documents")
    edits = d.where("title is null").select("doc_id", F.concat(F.lit("Untitled "), F.col("doc_id").cast("string")).alias("title"))
    stores = (("documents", "doc_id", "doc_id"), ("knowledge_documents", "postgres_document_id", "kd_id"), ("chunk_vectors", "postgres_document_id", "point_id"))
    parts = [edited_everywhere(table(spark, sf, n), key, edits, "doc_id", "title").select(F.lit(n).alias("store"), F.col(row).cast("long").alias("id"), "title") for n, key, row in stores]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"""WITH r AS (SELECT id AS user_id, CASE id % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MANAGER' ELSE 'EMPLOYEE' END AS role FROM users)
SELECT r.user_id, count(*) AS n FROM r JOIN documents d ON r.role = 'MANAGER' AND d.owner_id = r.user_id GROUP BY 1 UNION ALL SELECT user_id, (SELECT count(*) FROM documents) FROM r WHERE role = 'ADMIN'""")
def acc2_editable_documents_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each user may edit: administrators all, others their own where a role lets them update."""
    d = table(spark, sf, "documents").select("doc_id", F.col("owner_id").cast("long").alias("user_id"))
    r = _user_roles(spark, sf).select(F.col("user_id").cast("long").alias("user_id"), "role")
    may = r.join(_role_permissions(spark).where("permission = 'DOCUMENT_UPDATE'"), "role").where("role <> 'ADMIN'").select("user_id")
    own = d.join(may, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(r.where("role = 'ADMIN'").select("user_id", d.agg(F.count(F.lit(1))).scalar().alias("n")))


@query("SELECT u.username, coalesce(p.permission_type, '') AS permission_type, p.id FROM document_permissions p JOIN users u ON u.id = p.user_id WHERE p.document_id = (SELECT document_id FROM document_permissions WHERE document_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def t12_grants_of_most_shared(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "document_permissions")
    top = p.where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "document_id").limit(1)
    mine = p.join(F.broadcast(top.select("document_id")), "document_id", "left_semi")
    u = table(spark, sf, "users").select(F.col("id").alias("user_id"), "username")
    return mine.join(u, "user_id").select("username", F.coalesce("permission_type", F.lit("")).alias("permission_type"), "id").orderBy("username", "permission_type", "id")


# body evidence


@query(rf"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '(^|{_E})working\s+days($|{_E})') AS phrase, regexp_matches(lower(coalesce(text, '')), '(^|{_E})working($|{_E})') AS whole_1, regexp_matches(lower(coalesce(text, '')), '(^|{_E})day') AS start_2 FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(^|{_E})(working|day)')")
def f08_evidence_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents").where(F.col("text").rlike(X.term_regex("working", True)) | F.col("text").rlike(X.term_regex("day", True)))
    c = F.col("text")
    return d.select("doc_id", c.rlike(X.phrase_regex("working days")).alias("phrase"), whole_word(c, "working").alias("whole_1"), word_start(c, "day").alias("start_2"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(concat_ws('. ', nullif(trim(title), ''), nullif(trim(text), '')), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 40) / 140.0) AS INT)) END AS k FROM w), c AS (SELECT doc_id, w, CAST(unnest(range(0, k)) AS INT) AS position FROM n)
SELECT doc_id, position, md5(array_to_string(w[position * 140 + 1 : position * 140 + 180], ' ')) AS digest FROM c""")
def x06_titled_chunks(spark: SparkSession, sf: str) -> DataFrame:
    whole = X.titled_body(F.col("title"), F.col("text"))
    return text_table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(whole)).alias("position", "t")).select("doc_id", "position", F.md5("t").alias("digest"))


@query(r"""WITH a AS (SELECT topic_id, '- **see** 【' || topic_id % 7 || '†x】, [3] and [12]' AS a FROM topics)
SELECT topic_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(a, '【(\d+)†[^】]*】', 1), regexp_extract_all(a, '\[(\d+)\]', 1)), lambda x: CAST(x AS INT)))), ',') AS sources FROM a""")
def v16_citations(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat(F.lit("- **see** 【"), (F.col("topic_id") % 7).cast("string"), F.lit("†x】, [3] and [12]"))
    return table(spark, sf, "topics").select("topic_id", F.array_join(citations(tidy_answer(answer)), ",").alias("sources"))


# vectors of one document, encoders


_USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


@query(f"""WITH u AS (SELECT * FROM chunk_vectors WHERE {_USABLE}), q AS (SELECT CAST(vector AS DOUBLE[]) AS v FROM u ORDER BY point_id LIMIT 1), m AS (SELECT postgres_document_id AS d FROM u WHERE postgres_document_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT point_id, round(list_dot_product(CAST(u.vector AS DOUBLE[]), q.v) / (sqrt(list_dot_product(CAST(u.vector AS DOUBLE[]), CAST(u.vector AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v))), 6) AS cosine FROM u, q, m WHERE u.postgres_document_id = m.d ORDER BY cosine DESC, point_id LIMIT 5""")
def v03_nearest_inside_document(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors")
    scored = v.withColumn("cosine", cosine_to(F.col("vector"), first_vector(v))).where("cosine is not null and not isnan(cosine)")
    most = scored.where("postgres_document_id is not null").groupBy("postgres_document_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "postgres_document_id").limit(1)
    own = scored.join(F.broadcast(most.select("postgres_document_id")), "postgres_document_id", "left_semi")
    return own.select("point_id", F.round("cosine", 6).alias("cosine")).orderBy(F.desc("cosine"), "point_id").limit(5)


@query()
def v05_hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "topics")
    return t.select("topic_id", hashed_embedding(X.tokens(prefixed(F.col("summary"), "query: ")), 64).alias("vector"))


# algorithms


@query("SELECT topic_id, CAST(levenshtein(topic_key, title) AS INT) <= 12 AS near FROM topics")
def g11_within(spark: SparkSession, sf: str) -> DataFrame:
    from docquarry.operators.edits import within

    return table(spark, sf, "topics").select("topic_id", within(F.col("topic_key"), F.col("title"), 12).alias("near"))


@query("SELECT CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, len(topic_key) + 1), lambda i: CAST(ascii(substr(topic_key, i, 1)) AS HUGEINT))), lambda h, x: (h * 31 + x) % 2147483647) % 16 AS BIGINT) AS bucket, count(*) AS n FROM topics GROUP BY 1")
def g26_universal_text_hash(spark: SparkSession, sf: str) -> DataFrame:
    assert MERSENNE_31 == 2147483647
    return table(spark, sf, "topics").groupBy(universal_text_hash(F.col("topic_key"), 31, 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def g33_pattern_report(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of several patterns per topic summary, with its longest repeat."""
    t = table(spark, sf, "topics")
    found = S.pattern_matches(t, "topic_id", "summary", ["on", "and", "Texts"]).groupBy(F.col("row_id").alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("topic_id", S.longest_repeated_substring(F.col("summary")).alias("repeat")).join(found, "topic_id", "left").select("topic_id", "repeat", F.coalesce("n", F.lit(0)).alias("n"))


# evaluation and learning


@query("SELECT a.vec_id, round(greatest(0, 1 - d[5]), 4) AS distance FROM (SELECT x.vec_id, list_sort(list(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))))), 'DESC') AS d FROM embeddings x, embeddings y GROUP BY x.vec_id) a")
def w08_fifth_neighbour_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The curve whose knee sets the radius of density clusters; a vector counts as its own first neighbour."""
    return _fifth_distances(spark, sf)


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\s+'), lambda x: x <> '')) AS w FROM documents),
n AS (SELECT doc_id, CAST(sum(greatest(0, len(w)) + greatest(0, len(w) - 1) + greatest(0, len(w) - 2)) AS INT) AS n FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS length FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def m05_character_features(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed and weighted character n-grams of titles: how many each title has, and the length of its vector."""
    d = table(spark, sf, "documents").select("doc_id", L.character_grams(F.col("title")).alias("grams"))
    squares = F.aggregate(vector_to_array("x"), F.lit(0.0), lambda s, x: s + x * x)
    return L.text_features("hashed", 1 << 12).fit(d).transform(d).select("doc_id", F.size("grams").alias("n"), F.round(F.sqrt(squares), 6).alias("length"))


def _document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, embedding): the mean of a document's usable chunk vectors, each of length 1."""
    ok = (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = table(spark, sf, "chunk_vectors").where(ok & F.col("postgres_document_id").isNotNull()).select(F.col("postgres_document_id").cast("long").alias("doc_id"), "vector")
    unit = v.select("doc_id", F.transform("vector", lambda x: x / norm(F.col("vector"))).alias("v"))
    return unit.groupBy("doc_id").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(64))).alias("embedding"))


@query()
def m06_models_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and macro F1 of each kind of model on topics that none of them was fitted on: four on words and word pairs, neighbours on latent vectors, and a line on latent vectors with embeddings."""
    d = _labelled(spark, sf)
    train, test = d.where("fold <> 0"), d.where("fold = 0")
    guesses = L.classify_all(d.withColumn("part", (F.col("fold") == 0).cast("int")), "part", "text", "label", ("bayes", "logistic", "svm", "forest"))
    known, asked = (materialise(x, "latent") for x in L.lsa(train.drop("topic"), test.drop("topic"), text="text"))
    near = batched_search(asked.select(F.col("doc_id").alias("query_id"), F.col("latent").alias("vector")), known.select(F.col("doc_id").alias("point_id"), F.col("latent").alias("vector")), 5, 50)
    voted = L.nearest_labels(near.select(F.col("query_id").alias("doc_id"), F.col("point_id").alias("neighbour"), "cosine"), known, "doc_id", "label")
    # accuracy and report both read it
    guesses["neighbours"] = materialise(asked.select("doc_id", "label").join(voted, "doc_id", "left"), "voted")
    vectors = _document_vectors(spark, sf)
    combined = [x.join(vectors, "doc_id", "left").withColumn("x", array_to_vector(F.concat("latent", F.coalesce("embedding", F.array_repeat(F.lit(0.0), 64))))) for x in (known, asked)]
    guesses["combined"] = L.classify_features(*combined, "label", "logistic")
    reports = [E.with_averages(E.class_report(E.confusion(g, "label", "predicted"))).where("label = 'macro average'").select(F.lit(m).alias("model"), F.round("f1", 6).alias("macro_f1")) for m, g in guesses.items()]
    hits = [g.agg(F.lit(m).alias("model"), F.round(F.avg(F.coalesce((F.col("label") == F.col("predicted")).cast("double"), F.lit(0.0))), 6).alias("accuracy")) for m, g in guesses.items()]
    return functools.reduce(DataFrame.unionByName, hits).join(functools.reduce(DataFrame.unionByName, reports), "model")


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of a linear machine: fitted on three folds, its curve on a fourth, applied to the fifth."""
    d = _labelled(spark, sf).withColumn("part", F.when(F.col("fold") > 1, 0).otherwise(2 - F.col("fold")))
    fitted, held = L.margins(d, "part", 2, "text", "label")
    return L.platt(fitted, "margin", "ok")(held).select("confidence", "ok")


@query()
def m09_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of confidence against accuracy of a machine whose margins go through a logistic curve."""
    return E.reliability(_calibrated(spark, sf), "confidence", "ok")


@query()
def m09_calibration_measures(spark: SparkSession, sf: str) -> DataFrame:
    c = materialise(_calibrated(spark, sf), "calibrated")
    return E.calibration_error(E.reliability(c, "confidence", "ok")).crossJoin(E.brier_and_log_loss(c, "confidence", "ok"))  # two single rows


#: Starts that are compared.
SEEDS = range(20)


@query()
def m11_starts_compared(spark: SparkSession, sf: str) -> DataFrame:
    x = L.as_features(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").cache()
    # six categories, and the number of clusters with the best silhouette
    best = L.sweep(x, CLUSTERS).orderBy(F.desc("silhouette"), "k").first()["k"]
    rows = [(k, mode, seed, L.k_means(x, k, seed, mode)[1]) for k in sorted({6, best}) for mode in ("random", "k-means||") for seed in SEEDS]
    x.unpersist()
    return spark.createDataFrame(rows, "k int, start string, seed int, inertia double").groupBy("k", "start").agg(F.round(F.avg("inertia"), 6).alias("mean"), F.round(F.stddev("inertia"), 6).alias("spread"))


@query("WITH t AS (SELECT topic_id, lower(trim(category)) AS category, list_distinct(keywords) AS k FROM topics), p AS (SELECT a.category IS NOT DISTINCT FROM b.category AS same, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS j FROM t a JOIN t b ON a.topic_id < b.topic_id WHERE len(a.k) + len(b.k) > 0) SELECT same, count(*) AS pairs, round(avg(j), 6) AS mean FROM p GROUP BY same")
def m19_overlap_within_and_across(spark: SparkSession, sf: str) -> DataFrame:
    # topics are a table of fixed length: all their pairs are meant
    t = table(spark, sf, "topics").select("topic_id", F.lower(F.trim("category")).alias("c"), F.array_distinct("keywords").alias("k"))
    a, b = (t.select(F.col("topic_id").alias(x), F.col("c").alias(f"c_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).where(F.size("k_a") + F.size("k_b") > 0)
    jaccard = F.size(F.array_intersect("k_a", "k_b")) / F.size(F.array_union("k_a", "k_b"))
    return pairs.groupBy(F.col("c_a").eqNullSafe(F.col("c_b")).alias("same")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(jaccard), 6).alias("mean"))


@query()
def m21_runs_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics of two ways to retrieve, and what the second gains."""
    run, rels = _word_run(spark, sf)
    d, q, judged = _judged(spark, sf)
    cuts = ("rr", "recall_10", "ndcg_10")
    one, two = (E.mean_metrics(E.query_metrics(r, j)) for r, j in ((run, rels), (tfidf_run(d, q, 10), judged)))
    both = one.select(F.lit(1).alias("i"), *(F.col(c).alias(f"{c}_a") for c in cuts)).join(two.select(F.lit(1).alias("i"), *(F.col(c).alias(f"{c}_b") for c in cuts)), "i")
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"{c}_a").alias("words"), F.col(f"{c}_b").alias("tfidf"), F.round(F.col(f"{c}_b") - F.col(f"{c}_a"), 6).alias("gain")) for c in cuts))
    return both.select(F.explode(rows).alias("r")).select("r.*")


@query("SELECT event_id, user_id, substr(props, 1, 500) AS query_text FROM events WHERE trim(props) <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 1")
def acc3_last_search_of_each_user(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.trim("props") != "")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("r", last).where("r = 1").select("event_id", "user_id", F.substring("props", 1, 500).alias("query_text"))


# functions called from SQL


@query("SELECT topic_id, CAST(damerau_levenshtein(topic_key, title) AS INT) AS damerau, round(1 - levenshtein(topic_key, title) / greatest(len(topic_key), len(title)), 6) AS similarity, topic_id > 1 AND len(list_filter(range(2, CAST(floor(sqrt(topic_id)) AS BIGINT) + 1), lambda i: topic_id % i = 0)) = 0 AS prime FROM topics")
def udf_distances_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT topic_id, damerau_distance(topic_key, title) AS damerau, round(similarity(topic_key, title), 6) AS similarity, is_prime(topic_id) AS prime FROM {t}", t=table(spark, sf, "topics"))


@query("SELECT doc_id, CAST(p AS INT) AS pattern, CAST(i - 1 AS INT) AS start, CAST(i - 1 + len(w) AS INT) AS \"end\" FROM (SELECT doc_id, text, CAST(unnest(range(1, len(text) + 1)) AS INT) AS i FROM documents WHERE text IS NOT NULL), (VALUES (0, 'audit'), (1, 'budget'), (2, 'dit')) v(p, w) WHERE substr(text, i, len(w)) = w")
def udf_pattern_matches_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT d.doc_id, m.pattern, m.start, m.end FROM {d} d, LATERAL pattern_matches(d.text, array('audit', 'budget', 'dit')) m", d=table(spark, sf, "documents"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(description, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 4) / 8.0) AS INT)) END AS k FROM w), c AS (SELECT doc_id, w, CAST(unnest(range(0, k)) AS INT) AS position FROM n)
SELECT doc_id, position, array_to_string(w[position * 8 + 1 : position * 8 + 12], ' ') AS text FROM c""")
def udf_chunks_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT d.doc_id, c.position, c.text FROM {d} d, LATERAL chunks(d.description, 12, 4) c", d=table(spark, sf, "documents"))
