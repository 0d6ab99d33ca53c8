"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary was built with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def shipped(path: str) -> str:
    """Send the vocabulary file to every executor, once per application, where the driver has it; its name among the sent files."""
    spark = SparkSession.getActiveSession()
    key = (spark.sparkContext.applicationId, path) if spark is not None else None
    if key is not None and key not in _sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _sent.add(key)
    return os.path.basename(path)


_sent: set[tuple[str, str]] = set()


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker: from the files sent to it, else from where it lies."""
    import tiktoken

    try:
        sent = SparkFiles.get(os.path.basename(path))
    except Exception:  # noqa: BLE001 - outside of a session nothing is sent
        sent = ""
    with open(sent if os.path.exists(sent) else path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for null and empty."""
    shipped(path)

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path)
        for texts in parts:
            yield texts.map(lambda t: len(own.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
