"""Things every operator shares: the shared folder, written intermediates, checked broadcasts, hot keys."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when rows times row width stays under this.
BROADCAST_BYTES = 32 << 20

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        _local_dir[app] = "file://" + tempfile.mkdtemp(prefix="docquarry-")
    return _local_dir[app]


_written: dict[str, list[str]] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning.

    It is deleted by drop_materialised or release, else when the driver ends: results are lazy and read it until they are used.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def reused(path: str, rows: int, build: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The Parquet folder at path where it holds so many rows, else build() written there: a cache that is dropped when the number of its rows is wrong."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        held = spark.read.parquet(path)
        if held.count() == rows:
            return held
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a frame that materialise returned and nothing reads any more."""
    path = df._written_to
    _delete(df.sparkSession, path)
    _written[df.sparkSession.sparkContext.applicationId].remove(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that nothing reads any more: Spark does so only when the driver collects its garbage.

    What the first collection frees holds the shuffles that the second finds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def release(spark: SparkSession) -> None:
    """Delete every intermediate that this application has written: for use when its results have been written or collected."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast when its counted rows fit the limit, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def lookup_salted(left: DataFrame, right: DataFrame, key: str, spread: Column, hot_rows: int = 1_000_000, salts: int = 64) -> DataFrame:
    """Left outer join on key where single keys may hold a third of left; right holds each key once.

    Keys with at least hot_rows rows are found by a map-side combined count (at most rows / hot_rows
    of them, which bounds the broadcast) and their rows spread over salts by the given column; only
    their right rows are repeated. Null keys match nothing and are spread too.
    """
    hot = left.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= hot_rows) & F.col("_hot_key").isNotNull()).select("_hot_key", F.lit(True).alias("_is_hot"))
    salt = F.when(F.col("_is_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")
    a = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", salt).drop("_hot_key", "_is_hot")
    b = right.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    b = b.withColumn("_salt", F.explode(F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot_key", "_is_hot")
    return a.join(b, [key, "_salt"], "left").drop("_salt")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application, wherever it was imported from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="docquarry-"), "docquarry.zip")
    with zipfile.ZipFile(out, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("docquarry", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(out)
