"""The tables of a data directory, one Parquet file or folder each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; Catalyst prunes its columns and pushes filters down."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: A scan of at most so many bytes is spread over idle cores.
SPREAD_BYTES = 256 << 20


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on: a small scan of fewer partitions than there are cores is spread over them.

    Only a table of at most SPREAD_BYTES of files is shuffled, however many cores there are.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df
