"""Catalogue, access, activity and report queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.access import access_reasons, grants_only_read, readable, readable_pairs
from docquarry.operators.quality import domain_violations, missing_parents, null_violations, unique_violations
from docquarry.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Parameters of the stored queries: the user that asks, and what is asked for.
USER, CATEGORY, STATUS, KEYWORD, SINCE = 1, "Finance", "INDEXED", "budget", "2024-01-01"

# The roles and what each may do.
ROLES = {
    "ADMIN": ("DOCUMENT_CREATE", "DOCUMENT_DELETE", "DOCUMENT_READ", "DOCUMENT_UPDATE", "ROLE_MANAGE", "USER_MANAGE"),
    "MANAGER": ("DOCUMENT_CREATE", "DOCUMENT_READ", "DOCUMENT_UPDATE"),
    "EMPLOYEE": ("DOCUMENT_READ",),
}
ROLE_NAMES = tuple(ROLES)
_GRANTS = ", ".join(f"('{r}', '{p}')" for r, ps in ROLES.items() for p in ps)
_ROLE_SQL = f"""WITH role_permissions(role, permission) AS (VALUES {_GRANTS}),
user_roles AS (SELECT id AS user_id, CASE id % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MANAGER' ELSE 'EMPLOYEE' END AS role FROM users) """


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")


def _user_roles(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ROLE_NAMES)), (F.col("id") % 3 + 1).cast("int"))
    return table(spark, sf, "users").select(F.col("id").alias("user_id"), name.alias("role"))


# joins


@query("SELECT d.doc_id, d.title, c.name AS category, u.username AS owner FROM documents d LEFT JOIN categories c ON c.id = d.category_id LEFT JOIN users u ON u.id = d.owner_id")
def j01_documents_with_category_and_owner(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    u = table(spark, sf, "users").select(F.col("id").alias("owner_id"), F.col("username").alias("owner"))
    d = table(spark, sf, "documents").select("doc_id", "title", "category_id", "owner_id")
    return d.join(c, "category_id", "left").join(u, "owner_id", "left").select("doc_id", "title", "category", "owner")


@query(f"SELECT d.doc_id, d.title FROM documents d JOIN categories c ON c.id = d.category_id WHERE c.name = '{CATEGORY}'")
def j02_documents_of_category(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "categories").where(F.col("name") == CATEGORY).select(F.col("id").alias("category_id"))
    return table(spark, sf, "documents").join(c, "category_id", "left_semi").select("doc_id", "title")


@query("SELECT d.doc_id, t.tag FROM documents d JOIN (SELECT DISTINCT postgres_document_id AS doc, unnest(metadata.keywords) AS tag FROM knowledge_documents) t ON t.doc = d.doc_id")
def j03_documents_with_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "knowledge_documents").select(F.col("postgres_document_id").cast("long").alias("doc_id"), F.explode("metadata.keywords").alias("tag")).distinct()
    return table(spark, sf, "documents").select("doc_id").join(tags, "doc_id")


@query(_ROLE_SQL + "SELECT u.username, r.role FROM users u JOIN user_roles r ON r.user_id = u.id")
def j04_roles_of_users(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "users").select(F.col("id").alias("user_id"), "username")
    return u.join(_user_roles(spark, sf), "user_id").select("username", "role")


@query(_ROLE_SQL + "SELECT DISTINCT u.username, p.permission FROM users u JOIN user_roles r ON r.user_id = u.id JOIN role_permissions p ON p.role = r.role")
def j05_permissions_of_users(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "users").select(F.col("id").alias("user_id"), "username")
    return u.join(_user_roles(spark, sf), "user_id").join(_role_permissions(spark), "role").select("username", "permission").distinct()


@query("SELECT k.kd_id, k.version.number AS number, u.full_name FROM knowledge_documents k JOIN users u ON u.username = k.metadata.uploaded_by")
def j06_versions_with_uploader(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").select("kd_id", F.col("version.number").alias("number"), F.col("metadata.uploaded_by").alias("username"))
    return k.join(table(spark, sf, "users").select("username", "full_name"), "username").select("kd_id", "number", "full_name")


@query("SELECT d.doc_id, u.username, 'OWNER' AS reason FROM documents d JOIN users u ON u.id = d.owner_id UNION SELECT p.document_id, u.username, upper(p.permission_type) FROM document_permissions p JOIN users u ON u.id = p.user_id WHERE p.document_id IS NOT NULL")
def j07_access_list(spark: SparkSession, sf: str) -> DataFrame:
    return access_reasons(table(spark, sf, "documents"), table(spark, sf, "document_permissions"), table(spark, sf, "users"))


@query("SELECT event_id, event_type FROM events WHERE user_id = (SELECT id FROM users WHERE username = (SELECT min(username) FROM users))")
def j08_history_of_first_user(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "users")
    first = u.agg(F.min("username").alias("username"))
    return table(spark, sf, "events").join(u.join(first, "username").select(F.col("id").cast("long").alias("user_id")), "user_id", "left_semi").select("event_id", "event_type")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n FROM (SELECT owner_id AS user_id, doc_id FROM documents WHERE owner_id IS NOT NULL UNION SELECT p.user_id, p.document_id FROM document_permissions p JOIN documents d ON d.doc_id = p.document_id WHERE upper(p.permission_type) = 'READ') GROUP BY user_id")
def j09_readable_documents_per_user(spark: SparkSession, sf: str) -> DataFrame:
    pairs = readable_pairs(table(spark, sf, "documents"), table(spark, sf, "document_permissions"))
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_READABLE = f"(d.owner_id = {USER} OR EXISTS (SELECT 1 FROM document_permissions p WHERE p.document_id = d.doc_id AND p.user_id = {USER} AND upper(p.permission_type) = 'READ'))"


@query(f"SELECT d.doc_id, d.title, c.name AS category FROM documents d LEFT JOIN categories c ON c.id = d.category_id WHERE {_READABLE} AND d.status = '{STATUS}' ORDER BY d.updated_at DESC, d.doc_id DESC LIMIT 20")
def j10_readable_page(spark: SparkSession, sf: str) -> DataFrame:
    d = readable(table(spark, sf, "documents"), table(spark, sf, "document_permissions"), USER).where(F.col("status") == STATUS)
    page = d.select("doc_id", "title", "category_id", "updated_at").orderBy(F.desc_nulls_last("updated_at"), F.desc("doc_id")).limit(20)
    # names are looked up for the page only
    c = table(spark, sf, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return page.join(c, "category_id", "left").select("doc_id", "title", "category")


@query(f"SELECT count(*) AS total FROM documents d WHERE {_READABLE} AND d.status = '{STATUS}'")
def a10_readable_total(spark: SparkSession, sf: str) -> DataFrame:
    return readable(table(spark, sf, "documents"), table(spark, sf, "document_permissions"), USER).where(F.col("status") == STATUS).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT d.doc_id, d.title, c.name AS category FROM documents d LEFT JOIN categories c ON c.id = d.category_id WHERE d.deleted_at IS NULL")
def j11_scan_keeps_uncategorised(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return table(spark, sf, "documents").where("deleted_at is null").join(c, "category_id", "left").select("doc_id", "title", "category")


@query("SELECT d.doc_id, c.name AS category FROM documents d JOIN categories c ON c.id = d.category_id WHERE d.deleted_at IS NULL")
def j12_scan_drops_uncategorised(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return table(spark, sf, "documents").where("deleted_at is null").join(c, "category_id").select("doc_id", "category")


@query("SELECT c.name AS category, s.status, count(d.doc_id) AS n FROM categories c CROSS JOIN (SELECT DISTINCT status FROM documents WHERE status IS NOT NULL) s LEFT JOIN documents d ON d.category_id = c.id AND d.status = s.status GROUP BY 1, 2")
def j13_every_category_and_status(spark: SparkSession, sf: str) -> DataFrame:
    # both sides are lists of fixed length: names of categories and of states
    d = table(spark, sf, "documents").select("doc_id", "category_id", "status")
    names = table(spark, sf, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    counted = d.groupBy("category_id", "status").agg(F.count("doc_id").alias("n"))
    every = names.crossJoin(d.select("status").where("status is not null").distinct())
    return every.join(counted, ["category_id", "status"], "left").groupBy("category", "status").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT c.name AS category, count(d.doc_id) AS n FROM categories c LEFT JOIN documents d ON d.category_id = c.id GROUP BY c.name")
def a01_documents_per_category(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "documents").groupBy("category_id").agg(F.count("doc_id").alias("n"))
    c = table(spark, sf, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return c.join(counted, "category_id", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT d.doc_id, k.kd_id, k.content.word_count AS words FROM documents d JOIN knowledge_documents k ON k.postgres_document_id = d.doc_id")
def j17_both_stores(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").select(F.col("postgres_document_id").cast("long").alias("doc_id"), "kd_id", F.col("content.word_count").alias("words"))
    return table(spark, sf, "documents").select("doc_id").join(k, "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM knowledge_documents k WHERE k.postgres_document_id = d.doc_id)")
def j17_without_content(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").select(F.col("postgres_document_id").cast("long").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(k, "doc_id", "left_anti")


@query("SELECT v.point_id, d.doc_id, d.title FROM chunk_vectors v JOIN documents d ON d.doc_id = v.postgres_document_id WHERE EXISTS (SELECT 1 FROM knowledge_documents k WHERE k.postgres_document_id = d.doc_id)")
def j18_points_in_both_stores(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").select("point_id", F.col("postgres_document_id").cast("long").alias("doc_id"))
    k = table(spark, sf, "knowledge_documents").select(F.col("postgres_document_id").cast("long").alias("doc_id"))
    return v.join(table(spark, sf, "documents").select("doc_id", "title"), "doc_id").join(k, "doc_id", "left_semi").select("point_id", "doc_id", "title")


@query("SELECT p.id, d.title, u.username AS owner FROM document_permissions p JOIN documents d ON d.doc_id = p.document_id LEFT JOIN users u ON u.id = d.owner_id")
def j20_grants_with_document_and_owner(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "users").select(F.col("id").alias("owner_id"), F.col("username").alias("owner"))
    d = table(spark, sf, "documents").select("doc_id", "title", "owner_id").join(u, "owner_id", "left")
    return table(spark, sf, "document_permissions").select("id", F.col("document_id").cast("long").alias("doc_id")).join(d, "doc_id").select("id", "title", "owner")


@query("SELECT a.topic_id AS a, b.topic_id AS b, round(len(list_intersect(a.keywords, b.keywords)) / len(list_distinct(list_concat(a.keywords, b.keywords))), 6) AS jaccard FROM topics a JOIN topics b ON a.topic_id < b.topic_id WHERE len(list_intersect(a.keywords, b.keywords)) > 0")
def j24_topics_sharing_keywords(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "topics").select("topic_id", F.array_distinct("keywords").alias("k"))
    word = t.select("topic_id", "k", F.explode("k").alias("w"))
    a, b = (word.select("w", F.col("topic_id").alias(x), F.col("k").alias(f"k_{x}")) for x in "ab")
    # a shared word brings two topics together: no pair without one is looked at
    met = a.join(b, "w").where("a < b").dropDuplicates(["a", "b"])
    return met.select("a", "b", F.round(F.size(F.array_intersect("k_a", "k_b")) / F.size(F.array_union("k_a", "k_b")), 6).alias("jaccard"))


# filters and projections


@query(f"SELECT doc_id, title FROM documents WHERE status = '{STATUS}' AND document_type = 'PDF'")
def f01_equality_filters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.col("status") == STATUS) & (F.col("document_type") == "PDF")).select("doc_id", "title")


@query(f"SELECT kd_id FROM knowledge_documents WHERE list_contains(metadata.keywords, '{KEYWORD}')")
def f01_keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge_documents").where(F.array_contains("metadata.keywords", KEYWORD)).select("kd_id")


def optional_filter(df: DataFrame, **wanted: str) -> DataFrame:
    """Equality on each named column whose value isn't empty."""
    for column, value in wanted.items():
        if value != "":
            df = df.where(F.col(column) == value)
    return df


@query("SELECT doc_id FROM documents WHERE ('' = '' OR status = '') AND ('DOCX' = '' OR document_type = 'DOCX')")
def f02_optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    return optional_filter(table(spark, sf, "documents"), status="", document_type="DOCX").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(title) LIKE '%memo%' OR lower(description) LIKE '%memo%'")
def f03_substring_of_title_or_description(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.lower("title").like("%memo%") | F.lower("description").like("%memo%")).select("doc_id")


@query(r"SELECT kd_id FROM knowledge_documents WHERE regexp_matches(lower(content.raw_text), '(^|[^\p{L}\p{Nd}])working\s+days($|[^\p{L}\p{Nd}])')")
def f04_phrase_in_body(spark: SparkSession, sf: str) -> DataFrame:
    from docquarry.functions.text import phrase_regex

    return table(spark, sf, "knowledge_documents").where(F.col("content.raw_text").rlike(phrase_regex("working days"))).select("kd_id")


@query("SELECT point_id, chunk_id FROM chunk_vectors WHERE category = 'Legal' AND department = 'Legal' AND processing_status = 'INDEXED' ORDER BY point_id LIMIT 10")
def f06_payload_filter_before_limit(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").where((F.col("category") == "Legal") & (F.col("department") == "Legal") & (F.col("processing_status") == "INDEXED"))
    return v.orderBy("point_id").limit(10).select("point_id", "chunk_id")


@query("SELECT kd_id, title, content.word_count AS word_count FROM knowledge_documents")
def f07_nested_projection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge_documents").select("kd_id", "title", F.col("content.word_count").alias("word_count"))


@query(f"SELECT id FROM document_permissions WHERE granted_at >= TIMESTAMPTZ '{SINCE} 00:00:00+00'")
def f12_recent_grants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_permissions").where(F.col("granted_at") >= F.lit(f"{SINCE} 00:00:00").cast("timestamp")).select("id")


# aggregations


@query("SELECT status, count(*) AS n FROM documents GROUP BY status")
def a02_documents_per_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS query_text, count(*) AS searches, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS results FROM events GROUP BY event_type ORDER BY searches DESC, query_text LIMIT 10")
def a03_top_searches(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("query_text")).agg(F.count(F.lit(1)).alias("searches"), F.sum(F.floor("value")).alias("results"))
    return e.orderBy(F.desc("searches"), "query_text").limit(10)


def _count_by(name: str, column: str):
    @query(f"SELECT {column} AS value, count(*) AS n FROM knowledge_documents GROUP BY 1")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "knowledge_documents").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _name, _column in (("a04_per_department", "metadata.department"), ("a04_per_processing_status", "processing.status"), ("a04_per_language", "content.language"), ("a04_per_mime_type", "source.mime_type")):
    _count_by(_name, _column)


@query("SELECT k AS keyword, count(*) AS n FROM (SELECT unnest(metadata.keywords) AS k FROM knowledge_documents) GROUP BY k ORDER BY n DESC, keyword LIMIT 10")
def a05_common_keywords(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").select(F.explode("metadata.keywords").alias("keyword"))
    return k.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(10)


@query("SELECT round(avg(len(chunks)), 6) AS mean_chunks FROM knowledge_documents")
def a06_mean_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("chunks").isNotNull(), F.size("chunks"))
    return table(spark, sf, "knowledge_documents").agg(F.round(F.avg(n), 6).alias("mean_chunks"))


@query("SELECT count(*) AS total, count(DISTINCT category_id) AS categories, count(*) FILTER (status = 'INDEXED') AS indexed FROM documents")
def a11_dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("category_id").alias("categories"), F.count_if(F.col("status") == "INDEXED").alias("indexed"))


@query("SELECT round(quantile_cont(n_chars, 0.025), 6) AS low, round(quantile_cont(n_chars, 0.5), 6) AS middle, round(quantile_cont(n_chars, 0.975), 6) AS high FROM documents")
def a13_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(*(F.round(F.percentile("n_chars", p), 6).alias(n) for p, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))))


@query("WITH t AS (SELECT topic_key, document_type, count(*) AS n FROM documents WHERE topic_key IS NOT NULL GROUP BY ALL) SELECT topic_key, CAST(sum(n) AS BIGINT) AS size, first(document_type ORDER BY n DESC, document_type) AS dominant, round(max(n) / sum(n), 6) AS purity FROM t GROUP BY topic_key")
def a16_group_profile(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "documents").where("topic_key is not null").groupBy("topic_key", "document_type").agg(F.count(F.lit(1)).alias("n"))
    # the most frequent, of several the first by name
    best = F.min_by("document_type", F.struct(-F.col("n"), "document_type"))
    return counted.groupBy("topic_key").agg(F.sum("n").alias("size"), best.alias("dominant"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


@query("SELECT lang, count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))), 6) AS mean_words FROM documents GROUP BY lang")
def a18_mean_words_per_language(spark: SparkSession, sf: str) -> DataFrame:
    from docquarry.functions.text import word_count

    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(word_count(F.col("text"))), 6).alias("mean_words"))


@query("WITH c AS (SELECT topic_key, status, count(*) AS n FROM documents WHERE topic_key IS NOT NULL AND status IS NOT NULL GROUP BY ALL) SELECT topic_key, status FROM c QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY n DESC, status) = 1")
def a19_mode_per_topic(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "documents").where("topic_key is not null and status is not null").groupBy("topic_key", "status").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("topic_key").orderBy(F.desc("n"), "status")))
    return best.where("r = 1").select("topic_key", "status")


@query(_ROLE_SQL + "SELECT role, string_agg(permission, ',' ORDER BY permission) AS permissions FROM role_permissions GROUP BY role")
def a20_roles_with_permissions(spark: SparkSession, sf: str) -> DataFrame:
    return _role_permissions(spark).groupBy("role").agg(F.array_join(F.sort_array(F.collect_list("permission")), ",").alias("permissions"))


# windows, orders, pages


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, lower(props) ORDER BY n) AS m FROM r WHERE n <= 50), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS p FROM k WHERE m = 1) SELECT user_id, event_id FROM l WHERE p <= 8")
def w01_recent_searches(spark: SparkSession, sf: str) -> DataFrame:
    mine = Window.partitionBy("user_id")
    r = table(spark, sf, "events").withColumn("n", F.row_number().over(mine.orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 50")
    k = r.withColumn("m", F.row_number().over(Window.partitionBy("user_id", "event_type", F.lower("props")).orderBy("n"))).where("m = 1")
    return k.withColumn("p", F.row_number().over(mine.orderBy("n"))).where("p <= 8").select("user_id", "event_id")


@query("SELECT postgres_document_id AS doc_id, max(version.number) AS number FROM knowledge_documents WHERE postgres_document_id IS NOT NULL GROUP BY 1")
def w09_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge_documents").where("postgres_document_id is not null").groupBy(F.col("postgres_document_id").alias("doc_id")).agg(F.max("version.number").alias("number"))


@query("SELECT doc_id, title FROM documents ORDER BY created_at DESC NULLS LAST, doc_id DESC LIMIT 5")
def t01_recent_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc_nulls_last("created_at"), F.desc("doc_id")).limit(5).select("doc_id", "title")


@query("SELECT doc_id FROM documents ORDER BY updated_at DESC NULLS LAST, doc_id DESC LIMIT 20 OFFSET 40")
def t04_third_page(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc_nulls_last("updated_at"), F.desc("doc_id")).offset(40).limit(20).select("doc_id")


@query("SELECT doc_id, CASE WHEN epoch_us(updated_at) - epoch_us(created_at) > 1000000 THEN 'updated' ELSE 'added' END AS action FROM documents ORDER BY greatest(created_at, updated_at) DESC NULLS LAST, doc_id LIMIT 10")
def t11_recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(F.unix_micros("updated_at") - F.unix_micros("created_at") > 1_000_000, "updated").otherwise("added")
    d = table(spark, sf, "documents").orderBy(F.desc_nulls_last(F.greatest("created_at", "updated_at")), "doc_id").limit(10)
    return d.select("doc_id", action.alias("action"))


@query("SELECT kd_id, array_to_string(list_transform(list_sort(list_transform(chunks, lambda c: {'p': coalesce(c.position, 0), 'i': c.chunk_id})), lambda x: x.i), ',') AS ids FROM knowledge_documents WHERE chunks IS NOT NULL")
def t13_chunks_in_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.array_sort(F.transform("chunks", lambda c: F.struct(F.coalesce(c["position"], F.lit(0)).alias("p"), c["chunk_id"].alias("i"))))
    return table(spark, sf, "knowledge_documents").where("chunks is not null").select("kd_id", F.array_join(F.transform(ordered, lambda x: x["i"]), ",").alias("ids"))


# sets


@query("SELECT doc_id FROM documents WHERE topic_key IS NOT NULL INTERSECT SELECT CAST(postgres_document_id AS BIGINT) FROM chunk_vectors")
def u02_intersection(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").select(F.col("postgres_document_id").cast("long").alias("doc_id"))
    return table(spark, sf, "documents").where("topic_key is not null").select("doc_id").join(v, "doc_id", "left_semi").distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT CAST(postgres_document_id AS BIGINT) FROM chunk_vectors")
def u03_difference(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").select(F.col("postgres_document_id").cast("long").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(v, "doc_id", "left_anti").distinct()


@query("SELECT doc_id FROM documents WHERE status = 'FAILED' UNION SELECT doc_id FROM documents WHERE deleted_at IS NOT NULL")
def u04_union(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where("status = 'FAILED'").select("doc_id").unionByName(d.where("deleted_at is not null").select("doc_id")).distinct()


# constraints


@query("SELECT CAST(document_id AS BIGINT) AS document_id, CAST(user_id AS BIGINT) AS user_id, permission_type, count(*) AS n FROM document_permissions GROUP BY ALL HAVING count(*) > 1")
def c01_repeated_grants(spark: SparkSession, sf: str) -> DataFrame:
    return unique_violations(table(spark, sf, "document_permissions").select(F.col("document_id").cast("long"), F.col("user_id").cast("long"), "permission_type"), "document_id", "user_id", "permission_type")


@query("SELECT id, permission_type FROM document_permissions WHERE permission_type NOT IN ('READ', 'WRITE', 'DELETE')")
def c02_unknown_permission_types(spark: SparkSession, sf: str) -> DataFrame:
    return domain_violations(table(spark, sf, "document_permissions"), "permission_type", ("READ", "WRITE", "DELETE")).select("id", "permission_type")


@query("SELECT v.point_id FROM chunk_vectors v WHERE postgres_document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = v.postgres_document_id)")
def c03_vectors_without_document(spark: SparkSession, sf: str) -> DataFrame:
    return missing_parents(table(spark, sf, "chunk_vectors"), "postgres_document_id", table(spark, sf, "documents"), "doc_id").select("point_id")


@query("SELECT doc_id, owner_id, CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.id = d.owner_id AND u.is_active) THEN owner_id END AS kept FROM documents d")
def c04_owner_set_null(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "users").where("is_active").select(F.col("id").alias("kept"))
    d = table(spark, sf, "documents").select("doc_id", "owner_id")
    return d.join(u, d.owner_id == u.kept, "left").select("doc_id", "owner_id", "kept")


@query("SELECT kd_id, r.rule FROM knowledge_documents k, LATERAL (VALUES ('title', k.title IS NULL), ('raw_text', k.content.raw_text IS NULL), ('metadata', k.metadata IS NULL), ('created_at', k.created_at IS NULL)) r(rule, bad) WHERE r.bad")
def c05_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge_documents").select("kd_id", "title", F.col("content.raw_text").alias("raw_text"), "metadata", "created_at")
    return null_violations(k, "kd_id", "title", "raw_text", "metadata", "created_at")


@query("SELECT coalesce(d.doc_id, k.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no record' WHEN k.doc_id IS NULL THEN 'no content' ELSE 'title' END AS mismatch FROM documents d FULL JOIN (SELECT CAST(postgres_document_id AS BIGINT) AS doc_id, max(title) AS title FROM knowledge_documents WHERE postgres_document_id IS NOT NULL GROUP BY 1) k ON k.doc_id = d.doc_id WHERE d.doc_id IS NULL OR k.doc_id IS NULL OR d.title IS DISTINCT FROM k.title")
def c06_stores_disagree(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), F.col("title").alias("td"))
    k = table(spark, sf, "knowledge_documents").where("postgres_document_id is not null").groupBy(F.col("postgres_document_id").cast("long").alias("k")).agg(F.max("title").alias("tk"))
    both = d.join(k, F.col("d") == F.col("k"), "full")
    kind = F.when(F.col("d").isNull(), "no record").when(F.col("k").isNull(), "no content").when(~F.col("td").eqNullSafe(F.col("tk")), "title")
    return both.select(F.coalesce("d", "k").alias("doc_id"), kind.alias("mismatch")).where("mismatch is not null")


@query("SELECT user_id, count(*) AS n FROM document_permissions WHERE upper(permission_type) IN ('WRITE', 'DELETE') AND document_id IS NOT NULL AND (user_id, document_id) NOT IN (SELECT user_id, document_id FROM document_permissions WHERE upper(permission_type) = 'READ' AND document_id IS NOT NULL AND user_id IS NOT NULL) GROUP BY user_id")
def acc1_write_without_read(spark: SparkSession, sf: str) -> DataFrame:
    return grants_only_read(table(spark, sf, "document_permissions")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
