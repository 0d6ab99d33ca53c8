"""Constraints as queries for the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, with their number; nulls count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def domain_violations(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the domain; null is allowed."""
    return df.where(~F.col(column).isin(*domain))


def missing_parents(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent; null refers to nothing."""
    return df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def null_violations(df: DataFrame, row_id: str, *required: str) -> DataFrame:
    """(row_id, rule) for each required column that is null."""
    rules = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required)))
    return df.select(row_id, F.explode(rules).alias("rule"))


def cascaded(gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What stays of each child table (frame, reference) when the parents in gone go; null references stay. In the given order: children before what they refer to."""
    lost = gone.select(F.col(key).cast("long").alias("_gone"))
    return {name: df.join(lost, F.col(reference).cast("long") == F.col("_gone"), "left_anti") for name, (df, reference) in children.items()}


def edited_everywhere(store: DataFrame, reference: str, edits: DataFrame, key: str, *columns: str) -> DataFrame:
    """store with the columns of the edits (one row a key) at the rows that refer to them; other rows, and null references, stay."""
    new = edits.select(F.col(key).cast("long").alias("_key"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = store.join(new, F.col(reference).cast("long") == F.col("_key"), "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*store.columns)
