"""Vectors as Column expressions, in double."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is null, of another length, or zero."""
    whole = F.when(F.size(a) == F.size(b), norm(a) * norm(b))
    return F.when(whole > 0, dot(a, b) / whole)


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """Cosine to a vector known to the plan; null where a doesn't fit it."""
    fixed = F.array(*(F.lit(float(x)) for x in vector))
    length = math.sqrt(sum(float(x) ** 2 for x in vector))
    own = norm(a)
    return F.when((F.size(a) == len(vector)) & (own > 0) & ~F.isnan(own), dot(a, fixed) / (own * length))


def calibrated(c: Column, server_made: bool) -> Column:
    """A cosine as a score: stretched for vectors made here, only shifted for a caller's own."""
    if server_made:
        return F.greatest(F.lit(0.0), F.least(F.lit(0.95), (c - 0.10) / 0.60))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2))


def combined(a: Column, b: Column) -> Column:
    """The stronger leg, and half of the weaker in what is left to 1; a leg alone counts itself."""
    strong, weak = F.greatest(a, b), F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    return strong + 0.5 * weak * (1 - strong)


def hashed_embedding(words: Column, dimension: int = 384, seed: int = 42) -> Column:
    """A vector of hashed word counts of length 1: the stand-in where no model is at hand."""
    slot = F.transform(words, lambda w: F.pmod(F.xxhash64(F.lit(seed), w), F.lit(dimension)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(counts, lambda x: (x / length).cast("float"))).otherwise(F.transform(counts, lambda x: x.cast("float")))
