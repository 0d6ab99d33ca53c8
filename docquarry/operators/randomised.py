"""Primality, hashing, sampling and a replayable generator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
# Bases that make the test exact for 64 bits, and the modulus of the hash family.
BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
MERSENNE_31 = (1 << 31) - 1
#: Largest number that is_prime takes.
MOST = ((1 << 63) - 1) // 2


def _passes(n: int, base: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    x = pow(base, d, n)
    if x in (1, n - 1):
        return True
    return any((x := x * x % n) == n - 1 for _ in range(s - 1))


def prime(n: int) -> bool:
    """Exact Miller-Rabin."""
    if not 0 <= n <= MOST:
        raise ValueError(f"the number must be within 0 and {MOST}")
    if n < 2:
        return False
    return all(n == p or (n % p and _passes(n, p)) for p in BASES)


def probably_prime(n: int, rounds: int, seed: int) -> bool:
    """Miller-Rabin with random bases."""
    if n < 4:
        return n in (2, 3)
    draw = SplitMix(seed)
    return n % 2 == 1 and all(_passes(n, 2 + draw.below(n - 3)) for _ in range(rounds))


@F.pandas_udf(T.BooleanType())
def _prime(c: pd.Series) -> pd.Series:
    return c.map(lambda n: prime(int(n)), na_action="ignore")


def is_prime(c: Column) -> Column:
    return _prime(c)


class SplitMix:
    """A 64-bit generator whose stream is given by its seed alone. Bounded draws reject and take the remainder; other libraries may draw otherwise from the same stream."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    def below(self, n: int) -> int:
        """Uniform below n; draws that would favour small values are thrown away."""
        if n <= 0:
            raise ValueError("the bound must be positive")
        edge = (1 << 64) // n * n
        while (x := self.next()) >= edge:
            pass
        return x % n


def universal_hash(key: Column, a: int, b: int, buckets: int) -> Column:
    """((a key + b) mod p) mod buckets, p being 2^31 - 1; the key as an unsigned 32-bit number."""
    unsigned = F.pmod(key.cast("long"), F.lit(1 << 32)) % MERSENNE_31
    return (unsigned * a + b) % MERSENNE_31 % buckets


def universal_text_hash(text: Column, base: int, buckets: int) -> Column:
    """Polynomial hash of the code points, modulo 2^31 - 1, into buckets."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda h, x: (h * base + x) % MERSENNE_31, lambda h: h % buckets)


def uniform_sample(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows, every set equally likely, the same for the same seed: least hashes, kept with a bounded heap per task."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(k)


def reservoir(df: DataFrame, group: str, order: str, k: int, seed: int = 0) -> DataFrame:
    """One-pass reservoir of k rows per group, in the given order, replayable from the seed."""
    schema = df.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        draw, kept = SplitMix(seed), list(range(min(k, len(rows))))
        for i in range(k, len(rows)):
            j = draw.below(i + 1)
            if j < k:
                kept[j] = i
        return rows.iloc[kept]

    return df.groupBy(group).applyInPandas(run, schema)


def seeded_vectors(df: DataFrame, key: str, dimension: int, seed: int = 0) -> Column:
    """Uniform values in [-1, 1) of 24 bits, given by key and place alone: from the MD5 of seed, key and place, so that any engine makes the same."""
    name = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.conv(F.substring(name(i), 1, 6), 16, 10).cast("long") / F.lit((1 << 23) * 1.0) - 1).cast("float"))


def stream(seed: int, n: int) -> Iterator[int]:
    draw = SplitMix(seed)
    return (draw.next() for _ in range(n))


def spread(values: np.ndarray, buckets: int) -> float:
    """Chi-square of bucket counts against equal ones."""
    seen = np.bincount(values % buckets, minlength=buckets)
    want = values.size / buckets
    return float(((seen - want) ** 2 / want).sum())
