"""Source, sink and streaming queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.randomised import seeded_vectors
from docquarry.session import shared_dir
from docquarry.sources.files import append_keyed, appended, insert_statements, named_uuid, updated, upsert, without
from docquarry.sources.tables import table
from docquarry.streaming.ingest import chunked, event_counts, ingest, stream_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS points, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (len(vector) = 64) AS fitting FROM chunk_vectors")
def s06_collection_info(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("chunk_id").alias("chunks"), F.count_if(F.size("vector") == 64).alias("fitting"))


@query("SELECT u.id, u.full_name FROM users u WHERE id % 7 <> 0 UNION ALL SELECT id, 'renamed' FROM users WHERE id % 7 = 0")
def s18_upsert_users(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "users").select("id", "full_name")
    return upsert(u, u.where("id % 7 = 0").select("id", F.lit("renamed").alias("full_name")), "id")


@query("WITH h AS (SELECT chunk_id, md5('engine:' || chunk_id) AS h FROM chunk_vectors WHERE chunk_id IS NOT NULL) SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS key FROM h")
def s18_named_keys(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").where("chunk_id is not null")
    return v.select("chunk_id", named_uuid(F.concat(F.lit("engine:"), "chunk_id")).alias("key"))


@query("SELECT point_id, CASE WHEN department = 'Legal' THEN 'Law' ELSE category END AS category FROM chunk_vectors")
def s19_payload_update(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").select("point_id", "department", "category")
    return updated(v, F.col("department") == "Legal", category=F.lit("Law")).select("point_id", "category")


@query("SELECT point_id FROM chunk_vectors WHERE NOT coalesce(processing_status = 'FAILED', false)")
def s20_delete_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    return without(table(spark, sf, "chunk_vectors"), F.col("processing_status") == "FAILED").select("point_id")


@query("SELECT topic_id, array_to_string(CASE WHEN category IS NULL THEN list_append(coalesce(keywords, []), 'unsorted') ELSE keywords END, ',') AS keywords FROM topics")
def s21_push_keyword(spark: SparkSession, sf: str) -> DataFrame:
    t = appended(table(spark, sf, "topics"), "keywords", F.lit("unsorted"), F.col("category").isNull())
    return t.select("topic_id", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT 'INSERT INTO categories (id, name) VALUES (' || id || ', ''' || replace(name, '''', '''''') || ''');' AS sql FROM categories")
def s22_insert_statements(spark: SparkSession, sf: str) -> DataFrame:
    return insert_statements(table(spark, sf, "categories").select("id", "name"), "categories")


@query()
def s24_seeded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "topics")
    return t.select("topic_id", F.posexplode(seeded_vectors(t, "topic_id", 64)).alias("place", "value"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 40) / 140.0) AS INT)) END AS k FROM w),
c AS (SELECT doc_id, w, CAST(unnest(range(0, k)) AS INT) AS position FROM n)
SELECT 'doc' || doc_id || '-chunk' || (position + 1) AS chunk_id, doc_id, position, md5(array_to_string(w[position * 140 + 1 : position * 140 + 180], ' ')) AS digest FROM c""")
def s17_keyed_append(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks appended in two runs that overlap: every key stands once."""
    out = os.path.join(shared_dir(spark), f"appended-{uuid.uuid4().hex}")
    d = table(spark, sf, "documents")
    append_keyed(chunked(d.where("lang is not null or owner_id is null")), out, "point_key")
    append_keyed(chunked(d), out, "point_key")
    return spark.read.parquet(out).select("chunk_id", "doc_id", "position", F.md5("text").alias("digest"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS day FROM events GROUP BY event_type, day")
def ext1_daily_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = event_counts(table(spark, sf, "events"))
    return counted.select("event_type", "n", F.round("total", 4).alias("total"), F.unix_date(F.col("start").cast("date")).alias("day"))


@query(r"SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil((n - 40) / 140.0)) END AS BIGINT) AS n_chunks FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents) WHERE n > 0")
def ext2_streamed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files, chunked batch by batch."""
    schema = table(spark, sf, "documents").select("doc_id", "text").schema
    out = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    path = os.path.join(sf, "documents.parquet")
    ingest(stream_table(spark, path if os.path.isdir(path) else os.path.join(sf, "document[s].parquet"), schema), out, out + "-state").awaitTermination()
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
