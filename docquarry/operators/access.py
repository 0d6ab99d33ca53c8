"""Who may read what, as joins that run before anything is counted or ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _reads(grants: DataFrame) -> DataFrame:
    """Grants that let read; others don't. Types may be in lower case."""
    return grants.where(F.upper("permission_type") == "READ").select(F.col("user_id").cast("long").alias("user_id"), F.col("document_id").cast("long").alias("doc_id"))


def readable(documents: DataFrame, grants: DataFrame, user: int | None, admin: bool = False) -> DataFrame:
    """The documents a user may read: all for an administrator, none for nobody, else owned or granted ones."""
    if admin:
        return documents
    if user is None:
        return documents.where("false")
    granted = _reads(grants).where(F.col("user_id") == user).select("doc_id")
    owned = documents.where(F.col("owner_id") == user).select("doc_id")
    return documents.join(granted.unionByName(owned), "doc_id", "left_semi")


def readable_pairs(documents: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, doc_id), once each, for all users at once."""
    owned = documents.where("owner_id is not null").select(F.col("owner_id").cast("long").alias("user_id"), "doc_id")
    granted = _reads(grants).where("doc_id is not null").distinct().join(documents.select("doc_id"), "doc_id", "left_semi").select("user_id", "doc_id")
    return owned.unionByName(granted).distinct()


def access_reasons(documents: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """(doc_id, username, reason): owners and grants, once each. Users are few and broadcast by their statistics."""
    names = users.select(F.col("id").cast("long").alias("user_id"), "username")
    owners = documents.select("doc_id", F.col("owner_id").cast("long").alias("user_id")).join(names, "user_id").select("doc_id", "username", F.lit("OWNER").alias("reason"))
    granted = grants.where("document_id is not null").select(F.col("document_id").cast("long").alias("doc_id"), F.col("user_id").cast("long").alias("user_id"), F.upper("permission_type").alias("reason")).join(names, "user_id")
    return owners.unionByName(granted.select("doc_id", "username", "reason")).distinct()


def grants_only_read(grants: DataFrame) -> DataFrame:
    """Write and delete grants of users that can't read the document by a grant."""
    other = grants.where(F.upper("permission_type").isin("WRITE", "DELETE") & F.col("document_id").isNotNull())
    read = grants.where(F.upper("permission_type") == "READ").select("user_id", "document_id")
    return other.join(read, ["user_id", "document_id"], "left_anti")
