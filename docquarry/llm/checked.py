"""What must hold of whole results, worked out from the results by Spark and from the tables by SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.cohesion import piece_rows
from docquarry.llm.confusables import LOOKALIKES
from docquarry.llm.mixing import source_name
from docquarry.llm.tokens import token_count
from docquarry.session import materialise
from docquarry.sources.tables import table

_BLANK = r"[ \t\r\n]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def pieces_checked(pieces: DataFrame, texts: DataFrame, row_id: str, text: str, limit: int = 180, overlap: int = 40) -> DataFrame:
    """(row_id, n_words, digest, n_long, n_unopened, n_unnatural): each text put together again from its pieces.

    n_words and digest are of the words that the pieces give without their overlaps; n_long counts pieces
    over the limit, n_unopened those that don't open with the last overlap words before, n_unnatural those
    but the last that end at no sentence end and no blank line although one lies in reach.
    """
    order = Window.partitionBy("row_id").orderBy("position")
    w = pieces.select("row_id", "position", _words(F.col("text")).alias("w")).withColumn("before", F.lag("w").over(order))
    shared = F.least(F.lit(overlap), F.coalesce(F.size("before"), F.lit(0)))
    w = w.withColumn("shared", F.when(F.col("before").isNull(), 0).otherwise(shared))
    w = w.withColumn("fresh", F.slice("w", F.col("shared") + 1, F.greatest(F.size("w") - F.col("shared"), F.lit(0))))
    w = w.withColumn("opens", (F.col("shared") == 0) | (F.slice("w", F.lit(1), F.col("shared")) == F.slice("before", F.size("before") - F.col("shared") + 1, F.col("shared"))))
    w = w.withColumn("end", F.sum(F.size("fresh")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    # the pieces of one text are bounded by its length
    whole = w.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "fresh", F.size("fresh").alias("n"), "shared", "end"))).alias("p"),
        F.count_if(F.size("w") > limit).alias("n_long"),
        F.count_if(~F.col("opens")).alias("n_unopened"),
    )
    # a blank line leaves a mark on the word before
    marked = F.regexp_replace(F.col(text), r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*", "\u0001 ")
    own = texts.select(F.col(row_id).alias("row_id"), _words(marked).alias("own"))
    natural = lambda own, i: F.element_at(own, i).rlike("[.!?…。！？؟][\"'”’»)\\]}]*\u0001?$|\u0001$")
    unnatural = lambda x: ~natural(F.col("own"), x["end"]) & F.exists(F.sequence(x["end"] - x["n"] + 1, F.least(x["end"] - x["n"] - x["shared"] + limit, F.size("own") - 1)), lambda i: natural(F.col("own"), i))
    joined = whole.join(own, "row_id")
    rebuilt = F.flatten(F.transform("p", lambda x: x["fresh"]))
    inner = F.filter("p", lambda x: (x["end"] < F.size("own")) & (x["n"] > 0))
    return joined.select("row_id", F.size(rebuilt).alias("n_words"), F.md5(F.array_join(rebuilt, " ")).alias("digest"), F.col("n_long").cast("int").alias("n_long"), F.col("n_unopened").cast("int").alias("n_unopened"), F.size(F.filter(inner, unnatural)).alias("n_unnatural"))


def p1_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "knowledge_documents")
    return pieces_checked(piece_rows(k, "kd_id", "content.raw_text", "chunks"), k, "kd_id", "content.raw_text").withColumnRenamed("row_id", "kd_id")


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, documents, splits): a topic's documents, renamed or not, and over how many splits they lie: one."""
    from docquarry.llm.queries import p2_found, p2_splits

    return p2_found(spark, sf_dir).join(p2_splits(spark, sf_dir), "doc_id").groupBy("topic_id").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("split").alias("splits"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, documents, overfull, torn, uncovered, empty_numbers) of the packing; the last four are 0.

    overfull: containers over the capacity; torn: texts within the capacity in several pieces; uncovered:
    texts whose pieces aren't their tokens from first to last; empty_numbers: container numbers not in use.
    """
    from docquarry.llm.queries import p6_packing

    packed = materialise(p6_packing(spark, sf_dir), "packed")
    specs = table(spark, sf_dir, "container_specs").select("spec_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    size = F.col("token_end") - F.col("token_start")
    full = packed.where("container is not null").groupBy("spec_id", "container").agg(F.sum(size).alias("n")).join(F.broadcast(specs), "spec_id")
    full = full.groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"), (F.max("container") + 1 - F.count(F.lit(1))).alias("empty_numbers"))
    n = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n"))
    texts = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(size).alias("held"), F.min("token_start").alias("low"), F.max("token_end").alias("high"))
    texts = texts.join(n, "doc_id").join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("n") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("torn"),
        F.count_if((F.col("held") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n"))).alias("uncovered"),
    )
    return texts.join(full, "spec_id", "left").select("spec_id", "documents", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overfull", "torn", "uncovered", "empty_numbers")))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, overused): documents of each source, and how many are used more often than its target allows, which is 0."""
    from docquarry.llm.queries import p7_uses

    targets = table(spark, sf_dir, "mix_targets").select(source_name(F.col("source")).alias("source"), "max_repeats")
    uses = p7_uses(spark, sf_dir).join(F.broadcast(targets), "source", "left")
    return uses.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > F.coalesce("max_repeats", F.lit(0))).alias("overused"))


QUERIES = {f.__name__: f for f in (p1_checked, p2_checked, p6_checked, p7_checked)}

_P1 = r"""
WITH w AS (SELECT kd_id, list_filter(regexp_split_to_array(coalesce(content.raw_text, ''), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM knowledge_documents)
SELECT kd_id, CAST(len(w) AS INT) AS n_words, md5(array_to_string(w, ' ')) AS digest, CAST(0 AS INT) AS n_long, CAST(0 AS INT) AS n_unopened, CAST(0 AS INT) AS n_unnatural FROM w WHERE len(w) > 0
"""

_P6 = "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS empty_numbers FROM container_specs WHERE capacity_tokens > 0"

_P7 = r"SELECT nullif(regexp_replace(trim(lower(regexp_replace(source, '[\s\p{Z}]+', ' ', 'g'))), '[ _-]+', '-', 'g'), '') AS source, count(*) AS documents, CAST(0 AS BIGINT) AS overused FROM documents GROUP BY 1"

# problem 4: all pairs by their shared shingles

_P4_SETS = r"""
WITH RECURSIVE r AS (SELECT kd_id AS id, regexp_extract_all(lower(coalesce(content.raw_text, '')), '[\p{L}\p{N}]+') AS w FROM knowledge_documents),
t AS (SELECT doc_id AS id, array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+'), ' ') AS s FROM documents),
s AS (SELECT 'raw_text' AS f, id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS x FROM r
      UNION ALL SELECT 'title', id, unnest(list_distinct(list_transform(range(1, len(s) - 1), lambda i: substr(s, i, 3)))) FROM t),
n AS (SELECT f, id, count(*) AS n, bit_xor(hash(x)) AS h1, sum(hash(x)::HUGEINT) AS h2 FROM s GROUP BY f, id),
m AS (SELECT f, id, n, min(id) OVER (PARTITION BY f, n, h1, h2) AS class FROM n),
"""

_P4 = (
    _P4_SETS
    + """
p AS (SELECT a.f, a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.f = b.f AND a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT p.f AS field_name, p.a AS id_a, p.b AS id_b FROM p JOIN n x ON x.f = p.f AND x.id = p.a JOIN n y ON y.f = p.f AND y.id = p.b
WHERE k / (x.n + y.n - k) >= CASE p.f WHEN 'raw_text' THEN 0.6 ELSE 0.7 END
"""
)

_P4_GROUPS = (
    _P4_SETS
    + """
c AS (SELECT s.f, s.id, s.x FROM s JOIN m ON m.f = s.f AND m.id = s.id AND m.class = m.id),
p AS (SELECT a.f, a.id AS a, b.id AS b, count(*) AS k FROM c a JOIN c b ON a.f = b.f AND a.x = b.x AND a.id < b.id GROUP BY ALL),
l AS (SELECT p.f, p.a, p.b FROM p JOIN n x ON x.f = p.f AND x.id = p.a JOIN n y ON y.f = p.f AND y.id = p.b WHERE k / (x.n + y.n - k) >= CASE p.f WHEN 'raw_text' THEN 0.6 ELSE 0.7 END),
e AS (SELECT f, a, b FROM l UNION ALL SELECT f, b, a FROM l),
g(f, a, b) AS (SELECT f, a, b FROM e UNION SELECT g.f, g.a, e.b FROM g JOIN e ON e.f = g.f AND e.a = g.b),
o AS (SELECT f, a AS class, least(a, min(b)) AS "group" FROM g GROUP BY f, a),
d AS (SELECT f, a AS class, count(*) AS n_links FROM e GROUP BY f, a)
SELECT m.f AS field_name, m.id, m.class, coalesce(o."group", m.class) AS "group", coalesce(d.n_links, 0) AS n_links
FROM m LEFT JOIN o ON o.f = m.f AND o.class = m.class LEFT JOIN d ON d.f = m.f AND d.class = m.class
"""
)

_P5 = """
WITH u AS (SELECT point_id AS id, CAST(vector AS DOUBLE[]) AS v FROM chunk_vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
l AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM u),
c AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS c FROM l a JOIN l b ON a.id <> b.id),
k AS (SELECT a, b FROM c WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS point_id_a, greatest(a, b) AS point_id_b FROM k
"""


def _look_sql(column: str) -> str:
    """The texts' looks: characters without width gone, wide forms, blanks and letters translated, accents composed."""
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {c: " " for c in "               　"}
    for letters in LOOKALIKES.values():
        pairs |= letters
        for c, latin in letters.items():
            for mark in "̀́̆̈͂̈́":
                whole = unicodedata.normalize("NFC", c + mark)
                if len(whole) == 1:
                    pairs[whole] = unicodedata.normalize("NFC", latin + mark)
    out = f"regexp_replace({column}, '[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]', '', 'g')"
    for c, plain in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", **{c: x for c, x in pairs.items() if len(x) > 1}}.items():
        out = f"replace({out}, '{c}', '{plain}')"
    single = {c: x for c, x in pairs.items() if len(x) == 1}
    quoted = lambda s: "".join(s).replace("'", "''")
    return f"nfc_normalize(translate({out}, '{quoted(single)}', '{quoted(single.values())}'))"


_P8 = f"""
WITH f AS (SELECT doc_id, text, {_look_sql("text")} AS form FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
"""

SQL = {"p1_checked": _P1, "p4_found": _P4, "p4_groups": _P4_GROUPS, "p5_found": _P5, "p6_checked": _P6, "p7_checked": _P7, "p8_found": _P8}
