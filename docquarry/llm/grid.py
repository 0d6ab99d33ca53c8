"""Vectorised tokenising and hashing of many texts at once; used inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled in one numpy pass: bounds a worker's memory whatever the batch holds. Longer texts are one pass of their own.
SLICE_CHARS = 1 << 19

_P = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def nonblank_table() -> np.ndarray:
    """For each code point, whether it is anything but blank, tab, carriage return and line feed."""
    table = np.ones(0x110000, dtype=bool)
    table[[0x20, 0x09, 0x0D, 0x0A]] = False
    return table


@lru_cache(maxsize=8)
def _powers(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most limit characters, or of one longer text."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows of at most limit bytes, or of one longer text: only they are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(column):
        yield start, column.slice(start).to_pylist()


def tokenise(texts: Sequence[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of characters of the table: their text's index, start, end (in that text) and 64-bit hash of their characters."""
    plain = [t or "" for t in texts]
    c = codes("\n".join(plain))
    lengths = np.fromiter((len(t) for t in plain), dtype=np.int64, count=len(plain))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(plain) else np.zeros(0, np.int64)
    if not c.size:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = table[c]
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = 1 << (int(c.size) + 1).bit_length()
    total = np.zeros(c.size + 1, dtype=np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers(_P, size)[: c.size], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _powers(_P_INVERSE, size)[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(offsets, starts, side="right") - 1
    return at, starts - offsets[at], ends - offsets[at], hashes


def distinct(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted by text and value."""
    order = np.lexsort((values, at))
    at, values = at[order], values[order]
    keep = np.ones(at.size, dtype=bool)
    keep[1:] = (at[1:] != at[:-1]) | (values[1:] != values[:-1])
    return at[keep], values[keep]
