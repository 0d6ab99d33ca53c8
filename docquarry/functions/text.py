"""Text as Column expressions: normalising, tokens, terms, passages, counts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and decimal digits make a token; anything else, underscores too, splits.
TOKEN = r"[\p{L}\p{Nd}]+"

# Words that carry no search term.
STOPWORDS = (
    "a an and are as at be by can do does for from how i if in into is it its me my of on or our should so that the "
    "their then there these this to was we what when where which who why will with you your"
).split()

MIN_TERM_LENGTH = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(c: Column) -> Column:
    """Lower case, outer blanks gone, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Maximal runs of letters and digits, in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def terms(c: Column) -> Column:
    """Distinct tokens in order that are long enough and no stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= MIN_TERM_LENGTH) & ~t.isin(STOPWORDS)))


def words(c: Column) -> Column:
    """White-space separated words; empty for null and blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """Windows needed for n words: the last one ends at the last word."""
    step = size - overlap
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step)))).cast("int")


def chunks(c: Column, size: int = 180, overlap: int = 40) -> Column:
    """Array of passages of size words that share overlap words with the one before; empty for blank text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the size")

    def cut(w: Column) -> Column:
        n = chunk_count(F.size(w), size, overlap)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * (size - overlap) + 1, size), " "))

    return let(words(c), cut)


def chunk_id(doc: Column, position: Column) -> Column:
    """Name of a passage: positions count from 0, names from 1."""
    return F.format_string("doc%d-chunk%d", doc, position + 1)


def titled_body(title: Column, body: Column) -> Column:
    """What a passage for retrieval starts from: the title, then the body."""
    return F.concat_ws(". ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(body), F.lit("")))


def feature_text(title: Column, description: Column, body: Column) -> Column:
    """Text for features: a trailing variant mark dropped, digits as 0."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*\([A-Z]\)\s*$", "")
    return F.regexp_replace(F.concat(bare, F.lit(". "), F.coalesce(description, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))), "[0-9]", "0")


@F.pandas_udf(T.StringType())
def compatibility_form(c: pd.Series) -> pd.Series:
    """NFKC, which has no built-in expression."""
    return c.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def clean(c: Column) -> Column:
    """NFKC, control characters as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(compatibility_form(c), r"\p{Cc}", " "), r"\s+", " "))


def entity_key(c: Column) -> Column:
    """A name without letter case, blanks and punctuation, so that its spellings are one; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{P}\p{S}]+", ""), F.lit(""))


def escape_regex(text: str) -> str:
    return "".join("\\" + x if not (x.isalnum() or x.isspace() or x == "_") else x for x in text)


def term_regex(term: str, prefix: bool, least: int = 3) -> str:
    """A whole word, or a word's start where allowed and long enough; boundaries are between letters or digits and others."""
    edge = r"[^\p{L}\p{Nd}]"
    return rf"(?i)(^|{edge}){escape_regex(term)}" + ("" if prefix and len(term) >= least else rf"($|{edge})")


def phrase_regex(phrase: str) -> str:
    """The words of a phrase with any white space between, at word boundaries."""
    edge = r"[^\p{L}\p{Nd}]"
    return rf"(?i)(^|{edge})" + r"\s+".join(escape_regex(w) for w in phrase.split()) + rf"($|{edge})"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def stem(path: Column, limit: int = 255) -> Column:
    """File name without folders and extension, as a title."""
    return F.substring(F.regexp_replace(basename(path), r"\.[^.]*$", ""), 1, limit)


def initials(name: Column) -> Column:
    """First letters of the first two words, upper case."""
    return F.upper(F.array_join(F.transform(F.slice(words(name), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, in words."""
    seconds = (F.unix_micros(now) - F.unix_micros(at)) / 1e6
    minutes, hours, days = (F.floor(seconds / n).cast("string") for n in (60, 3600, 86400))
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(minutes, F.lit("m ago"))).when(seconds < 86400, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(days, F.lit("d ago")))
