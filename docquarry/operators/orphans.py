"""References to records that do not exist, are deleted, or came later (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import lookup_salted

#: Largest Bloom filter in bits (8 MiB). Beyond it the filter only proves less; results stay exact.
MAX_BITS = 1 << 26
BITS_PER_KEY = 10
HASHES = 5


def filter_bits(keys: int, max_bits: int = MAX_BITS) -> int:
    """A power of two with room for BITS_PER_KEY bits a key, within max_bits."""
    return min(max_bits, 1 << max(10, (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def _positions(key: Column, bits: int) -> Column:
    return F.array(*(F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)))


def bloom_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row, one column words: the filter as 64-bit words. Words are OR-ed map-side; the row is at most MAX_BITS long."""
    at = keys.where(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key).cast("long"), bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = keys.sparkSession.range(0, bits // 64, 1, 1).join(words, F.col("id") == F.col("word"), "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("words"))


def _may_hold(words: Column, key: Column, bits: int) -> Column:
    test = F.lit(True)
    for i in range(HASHES):
        at = F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1))
        test = test & (F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return test


def orphan_references(refs: DataFrame, ref_key: str, ref_time: str, row_id: str, parents: DataFrame, parent_key: str, parent_time: str, deleted: str | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """The references of refs that can't be followed: (row_id, ref_time, reason).

    reason is 'absent' (no live parent has the key) or 'later' (every live parent of that key was
    created after the reference). Null references are no case; a null time of either side is never
    earlier or later; equal times are no case; repeated parents count as one whose time is the
    earliest (a null time wins); repeated references are each reported. Empty tables give none, or
    all references, as absent. Other columns of either table aren't read.

    A Bloom filter of the live keys, broadcast as one row of at most max_bits, proves definite
    orphans; only the references it lets pass are verified by an exact join.
    """
    live = parents if deleted is None else parents.where(F.col(deleted).isNull())
    live = live.select(F.col(parent_key).cast("long").alias("k"), F.col(parent_time).alias("born")).where("k is not null")
    bits = filter_bits(live.count(), max_bits)
    words = F.broadcast(bloom_words(live, "k", bits))
    asked = refs.select(F.col(row_id).alias("row_id"), F.col(ref_key).cast("long").alias("k"), F.col(ref_time).alias("at")).where("k is not null")
    # the filter is one row: this broadcast join adds a column and multiplies nothing
    tested = asked.join(words, F.lit(True), "cross").select("row_id", "k", "at", _may_hold(F.col("words"), F.col("k"), bits).alias("may"))
    absent = tested.where("not may").select("row_id", "at", F.lit("absent").alias("reason"))
    first = live.groupBy("k").agg(F.when(F.count("born") < F.count(F.lit(1)), F.lit(None)).otherwise(F.min("born")).alias("born"), F.lit(True).alias("found"))
    held = lookup_salted(tested.where("may").drop("may"), first, "k", F.col("row_id"))
    verified = held.select("row_id", "at", F.when(F.col("found").isNull(), "absent").when(F.col("born") > F.col("at"), "later").alias("reason")).where("reason is not null")
    return absent.unionByName(verified)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, month of the reference in UTC and reason; a null month stands for references without a time."""
    utc = F.to_utc_timestamp("at", F.current_timezone())
    return orphans.groupBy("ref_table", F.date_format(utc, "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
