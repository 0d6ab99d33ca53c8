"""The queries of this folder's problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checked
from docquarry.llm.cohesion import piece_rows, recut
from docquarry.llm.confusables import lookalike_pairs, one_form
from docquarry.llm.mixing import mix_sources
from docquarry.llm.neardup import Covering, duplicate_groups, duplicate_pairs, near_duplicates
from docquarry.llm.neighbours import nearest_vectors
from docquarry.llm.packing import fill_report, pack
from docquarry.llm.splits import entity_components, entity_name, grouped_splits, records_with_component
from docquarry.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = recut(table(spark, sf_dir, "knowledge_documents"), "kd_id", "content.raw_text", "chunks")
    return judged.select(F.col("row_id").alias("kd_id"), F.explode(F.col("bad").cast("array<bigint>")).alias("chunk_position"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rows(table(spark, sf_dir, "knowledge_documents"), "kd_id", "content.raw_text", "chunks").withColumnRenamed("row_id", "kd_id")


def _topic_records(spark: SparkSession, sf_dir: str, former: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their topic's component, and topics with theirs; former: also documents under a former key that no topic has."""
    topics = table(spark, sf_dir, "topics")
    components = entity_components(topics, "topic_key", "former_key")
    known = topics.select("topic_id", F.trim(F.lower("category")).alias("category"), entity_name(F.col("topic_key")).alias("entity")).join(components, "entity")
    # a former key that no topic has ties topics together but is itself no topic
    named = components if former else components.join(known.select("entity").distinct(), "entity", "left_semi")
    return records_with_component(table(spark, sf_dir, "documents"), "doc_id", "topic_key", named), known


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = _topic_records(spark, sf_dir)
    least = known.groupBy("component").agg(F.min("topic_id").alias("topic_id"))
    return records.join(least, "component").select(F.col("row_id").alias("doc_id"), F.col("topic_id").cast("long").alias("topic_id"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = _topic_records(spark, sf_dir, former=True)
    kinds = known.select("entity", "category").distinct()
    asked = records.join(kinds, "entity", "left").withColumn("tie", F.coalesce("component", "entity"))
    return grouped_splits(asked, "row_id", "tie", "category").withColumnRenamed("row_id", "doc_id")


#: Field, kind and size of shingles, limit, and masks that lose a pair at the limit with a chance of 4e-4 and 6e-4.
NEAR = (
    ("raw_text", "knowledge_documents", "kd_id", "content.raw_text", "words", 3, 0.6, Covering(15, (2, 2, 1))),
    ("title", "documents", "doc_id", "title", "letters", 3, 0.7, Covering(18, (3, 3, 2))),
)


def _near(spark: SparkSession, sf_dir: str, result) -> DataFrame:
    out = None
    for field, name, row, text, *how in NEAR:
        part = result(*near_duplicates(table(spark, sf_dir, name), row, text, *how))
        part = part.select(F.lit(field).alias("field_name"), *(F.col(c).cast("long").alias(c) for c in part.columns))
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, duplicate_pairs)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, duplicate_groups)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_vectors(table(spark, sf_dir, "chunk_vectors"), "point_id", "vector", least=0.85)
    return near.select(F.least("id", "neighbour").alias("point_id_a"), F.greatest("id", "neighbour").alias("point_id_b")).distinct()


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "chunk_vectors"), "point_id", "vector").withColumnRenamed("id", "point_id")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "container_specs"), "spec_id", "capacity_tokens").withColumnRenamed("row_id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_packing(spark, sf_dir), table(spark, sf_dir, "container_specs"), "spec_id", "capacity_tokens")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"), "source", "target_share", "max_repeats")


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].withColumnRenamed("row_id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", one_form(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_splits, p4_found, p4_groups, p5_found, p5_nearest, p6_packing, p6_fill, p7_uses, p7_shares, p8_found, p8_text)} | checked.QUERIES

_P1 = """
WITH p AS (
  SELECT kd_id, c."position" AS pos, list_filter(regexp_split_to_array(coalesce(c."text", ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w,
         ' ' || array_to_string(list_filter(regexp_split_to_array(coalesce(raw, ''), '[ \\t\\r\\n]+'), lambda x: x <> ''), ' ') || ' ' AS whole
  FROM (SELECT kd_id, content.raw_text AS raw, unnest(chunks) AS c FROM knowledge_documents)
  WHERE c IS NOT NULL AND c."position" IS NOT NULL),
o AS (SELECT *, lag(w) OVER (PARTITION BY kd_id ORDER BY pos) AS b FROM p)
SELECT DISTINCT kd_id, CAST(pos AS BIGINT) AS chunk_position FROM o
WHERE len(w) > 180
   OR (b IS NOT NULL AND w[1:least(40, len(b))] <> b[greatest(1, len(b) - 39):len(b)])
   OR (len(w) > 0 AND NOT contains(whole, ' ' || array_to_string(w, ' ') || ' '))
"""

_P2 = """
WITH RECURSIVE t AS (
  SELECT topic_id, nullif(regexp_replace(lower(topic_key), '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g'), '') AS k,
         nullif(regexp_replace(lower(former_key), '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g'), '') AS f FROM topics),
e AS (SELECT k AS a, f AS b FROM t WHERE f IS NOT NULL UNION SELECT f, k FROM t WHERE f IS NOT NULL UNION SELECT k, k FROM t),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS k, min(t.topic_id) AS topic_id FROM r JOIN t ON t.k = r.b GROUP BY r.a)
SELECT d.doc_id, CAST(m.topic_id AS BIGINT) AS topic_id FROM documents d
JOIN t ON t.k = regexp_replace(lower(d.topic_key), '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g') JOIN m ON m.k = t.k
"""

SQL = {"p1_found": _P1, "p2_found": _P2, "p2_checked": f"SELECT topic_id, count(*) AS documents, CAST(1 AS BIGINT) AS splits FROM ({_P2}) GROUP BY topic_id"} | checked.SQL
