"""Lexical scores as Column expressions: phrases, terms, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import STOPWORDS, TOKEN, escape_regex, let, tokens

# What a match in each field counts.
TITLE, DESCRIPTION, BODY = 1.0, 0.95, 0.9
PARTIAL_FACTOR = 0.85
CEILING = 0.95
MIN_COVERAGE = 0.6
BODY_PREFIX = 0.8
MIN_PREFIX = 3

EDGE = r"[^\p{L}\p{Nd}]"


def query_terms(query: str) -> list[str]:
    """The driver's form of functions.text.terms, for a query that is known when the plan is made."""
    import regex

    found = dict.fromkeys(t for t in regex.findall(TOKEN, query.lower()) if len(t) >= 2 and t not in STOPWORDS)
    return list(found)


def edits_allowed(length: Column) -> Column:
    """0 for up to 3 letters, 1 for up to 5, else 2."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def typo_credit(distance: Column, a: Column, b: Column) -> Column:
    return 1.0 - distance / F.greatest(F.length(a), F.length(b))


def prefix_credit(typed: Column, word: Column) -> Column:
    return 0.5 + 0.5 * F.length(typed) / F.length(word)


def covers_enough(score: Column, matched: Column, total: Column) -> Column:
    """All of one or two terms, else three fifths of them, and a positive score."""
    return (score > 0) & (matched >= F.when(total <= 2, total).otherwise(F.ceil(F.lit(MIN_COVERAGE) * total)))


def phrase_fit(text: Column, phrase: str, partial: bool) -> tuple[Column, Column]:
    """(exact, partial): the phrase at word boundaries; or only begun in its last word, of three letters at least."""
    low = F.lower(F.coalesce(text, F.lit("")))
    body = escape_regex(phrase)
    # a plain search first: the pattern runs only where the phrase stands at all
    exact = low.contains(phrase) & low.rlike(rf"(^|{EDGE}){body}($|{EDGE})")
    import regex

    last = regex.findall(TOKEN, phrase)
    begun = partial and bool(last) and len(last[-1]) >= MIN_PREFIX
    return exact, (~exact & low.contains(phrase) & low.rlike(rf"(^|{EDGE}){body}")) if begun else F.lit(False)


def _phrase(text: Column, phrase: str, weight: float, partial: bool) -> tuple[Column, Column]:
    exact, begun = phrase_fit(text, phrase, partial)
    return F.when(exact, weight).when(begun, weight * PARTIAL_FACTOR).otherwise(0.0), begun


def whole_word(text: Column, term: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains(term) & low.rlike(rf"(^|{EDGE}){escape_regex(term)}($|{EDGE})")


def word_start(text: Column, term: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains(term) & low.rlike(rf"(^|{EDGE}){escape_regex(term)}")


def body_credit(body: Column, term: str, prefix: bool = True) -> Column:
    """Evidence in the body: 1 for a whole word, 0.8 for a word's start."""
    start = word_start(body, term) if prefix and len(term) >= MIN_PREFIX else F.lit(False)
    return F.when(whole_word(body, term), 1.0).when(start, BODY_PREFIX).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def _best_typo(candidates: pd.Series, term: pd.Series) -> pd.Series:
    from docquarry.operators.edits import swaps_adjacent

    def best(words, own: str) -> float:
        allowed = 0 if len(own) <= 3 else 1 if len(own) <= 5 else 2
        found = [1.0 - d / max(len(w), len(own)) for w in words if (d := swaps_adjacent(own, w)) <= allowed]
        return max(found, default=0.0)

    return pd.Series([0.0 if c is None or not len(c) else best(c, t) for c, t in zip(candidates, term, strict=True)])


def field_credit(text: Column, term: str, fuzzy: bool) -> Column:
    """Credit of one term in one field: 1 for the whole word, else the best of words it begins and words it misspells.

    Words go to Python only where a built-in distance bound leaves a candidate.
    """
    whole = whole_word(text, term)
    if not fuzzy:
        return F.when(whole, 1.0).otherwise(0.0)
    allowed = 0 if len(term) <= 3 else 1 if len(term) <= 5 else 2
    best = F.lit(0.0)
    if len(term) >= MIN_PREFIX:
        begun = F.filter(tokens(text), lambda t: t.startswith(term) & (F.length(t) > len(term)))
        best = F.coalesce(0.5 + 0.5 * len(term) / F.array_min(F.transform(begun, lambda t: F.length(t))), F.lit(0.0))
    if allowed:
        near = F.filter(tokens(text), lambda t: (F.abs(F.length(t) - len(term)) <= allowed) & (F.levenshtein(t, F.lit(term)) <= 2 * allowed))
        best = F.greatest(best, _best_typo(F.when(~whole, near), F.lit(term)))
    return F.when(whole, 1.0).otherwise(best)


def lexical_match(query: str, title: Column, description: Column, body: Column | None = None, fuzzy: bool = False) -> Column:
    """struct(score, fuzzy, matched, total) of a document for one query.

    The best phrase score stands when it is the title's exact one, when there are no terms, or when it
    is at least the coverage score. A field takes a term over only with strictly more credit.
    """
    phrase = " ".join(query.lower().split())
    wanted = query_terms(phrase)
    n = F.lit(len(wanted))
    if not phrase:
        return F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("fuzzy"), F.lit(0).alias("matched"), F.lit(0).alias("total"))
    in_title, title_begun = _phrase(title, phrase, TITLE, fuzzy)
    in_description, description_begun = _phrase(description, phrase, DESCRIPTION, fuzzy)
    in_body = F.when(phrase_fit(body, phrase, False)[0], BODY).otherwise(0.0) if body is not None else F.lit(0.0)
    if not wanted:
        return let(F.greatest(in_title, in_description, in_body), lambda p: F.struct(p.alias("score"), F.lit(False).alias("fuzzy"), F.lit(0).alias("matched"), F.lit(0).alias("total")))
    credits = []
    for term in wanted:
        c = BODY * body_credit(body, term, fuzzy) if body is not None else F.lit(0.0)
        credits.append(F.struct(field_credit(title, term, fuzzy).alias("a"), (DESCRIPTION * field_credit(description, term, fuzzy)).alias("b"), c.alias("c")))
    # every pattern is worked out once, however often the rules below name it
    evidence = F.struct(in_title.alias("title"), title_begun.alias("title_begun"), in_description.alias("description"), description_begun.alias("description_begun"), in_body.alias("body"), F.array(*credits).alias("credits"))
    return let(evidence, lambda e: _judged(e, n))


def _judged(e: Column, n: Column) -> Column:
    def winner(x: Column) -> Column:
        top = F.greatest(x["a"], x["b"])
        best = F.greatest(top, x["c"])
        loose = F.when(x["c"] > top, x["c"] < BODY).when(x["b"] > x["a"], x["b"] < DESCRIPTION).otherwise(x["a"] < TITLE)
        return F.struct(best.alias("best"), loose.alias("loose"))

    def decided(p: Column) -> Column:
        found = F.filter(p["terms"], lambda t: t["best"] > 0)
        coverage = CEILING * (F.aggregate(p["terms"], F.lit(0.0), lambda s, t: s + t["best"]) / n)
        inexact = (p["phrase"] > 0) & (p["phrase"] > e["body"]) & F.when(e["title"] >= e["description"], e["title_begun"]).otherwise(e["description_begun"])
        by_phrase = (p["phrase"] == TITLE) | (p["phrase"] >= coverage)
        return F.struct(F.when(by_phrase, p["phrase"]).otherwise(coverage).alias("score"), F.when(by_phrase, inexact).otherwise(F.exists(found, lambda t: t["loose"])).alias("fuzzy"), F.when(by_phrase, n).otherwise(F.size(found)).alias("matched"), n.alias("total"))

    return let(F.struct(F.greatest(e["title"], e["description"], e["body"]).alias("phrase"), F.transform(e["credits"], winner).alias("terms")), decided)
