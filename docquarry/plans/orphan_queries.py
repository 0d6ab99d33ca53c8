"""Queries of problem 3 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.orphans import orphan_references, orphan_report
from docquarry.sources.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    kinds = (("knowledge_documents", "postgres_document_id", "created_at", "kd_id"), ("document_permissions", "document_id", "granted_at", "id"))
    parts = [orphan_references(table(spark, sf_dir, name), key, time, row, documents, "doc_id", "created_at", "deleted_at").select(F.lit(name).alias("ref_table"), F.col("row_id").cast("long").alias("row_id"), "at", "reason") for name, key, time, row in kinds]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "row_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_REFS = """
WITH refs AS (
  SELECT 'knowledge_documents' AS ref_table, kd_id AS row_id, CAST(postgres_document_id AS BIGINT) AS k, created_at AS at_time FROM knowledge_documents
  UNION ALL
  SELECT 'document_permissions', CAST(id AS BIGINT), CAST(document_id AS BIGINT), granted_at FROM document_permissions),
judged AS (
  SELECT r.*, CASE WHEN d.doc_id IS NULL OR d.deleted_at IS NOT NULL THEN 'absent' WHEN d.created_at > r.at_time THEN 'later' END AS reason
  FROM refs r LEFT JOIN documents d ON d.doc_id = r.k WHERE r.k IS NOT NULL)
"""

SQL = {
    "p3_found": _REFS + "SELECT ref_table, row_id FROM judged WHERE reason IS NOT NULL",
    "p3_report": _REFS + "SELECT ref_table, strftime(at_time AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n_orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
