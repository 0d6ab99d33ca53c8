"""Documents and events as streams: incremental chunking into a keyed table, windowed counts, one-pass samples."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.functions.text import chunk_id, chunks, word_count
from docquarry.operators.randomised import SplitMix
from docquarry.sources.files import named_uuid


def chunked(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(point_key, doc_id, chunk_id, position, text, token_count): one row a passage, keyed by name so that a rerun writes the same rows."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.posexplode(chunks(F.col(text))).alias("position", "text"))
    named = rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("position")))
    return named.select(named_uuid(F.col("chunk_id")).alias("point_key"), "doc_id", "chunk_id", "position", "text", word_count(F.col("text")).alias("token_count"))


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's chunks under a folder of its number: a batch that is repeated after a failure replaces its own rows."""

    def publish(batch: DataFrame, number: int) -> None:
        chunked(batch).write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their summed value per window and type; rows later than the watermark are dropped by the stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def streaming_reservoir(events: DataFrame, group: str, value: str, k: int, seed: int = 0) -> DataFrame:
    """(group, seen, sample): a reservoir of k values per group, kept as state over batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, spot, kept = state.get if state.exists else (0, seed, "")
        values = [int(x) for x in kept.split(",") if x]
        draw = SplitMix(spot)
        for part in parts:
            for x in part[value].tolist():
                seen += 1
                if len(values) < k:
                    values.append(x)
                else:
                    j = draw.below(seen)
                    if j < k:
                        values[j] = x
        # the state is signed in Spark
        spot = draw.state - (1 << 64) if draw.state >= 1 << 63 else draw.state
        state.update((seen, spot, ",".join(map(str, values))))
        yield pd.DataFrame({"group": [key[0]], "seen": [seen], "sample": [values]})

    return events.groupBy(group).applyInPandasWithState(step, "group string, seen bigint, sample array<bigint>", "seen bigint, spot bigint, kept string", "update", GroupStateTimeout.NoTimeout)
