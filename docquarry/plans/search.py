"""Keyword, fuzzy, vector and hybrid search as one lazy plan."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.lexical import MIN_PREFIX, covers_enough, lexical_match, query_terms, whole_word
from docquarry.functions.text import phrase_regex, term_regex
from docquarry.functions.vectors import calibrated, combined, cosine_to
from docquarry.operators.access import readable
from docquarry.operators.vocabulary import correct_query

MODES = ("HYBRID", "KEYWORD", "FUZZY", "SEMANTIC")
#: Chunks that the vector leg brings in before rights are applied.
CHUNK_LIMIT = 200
# Least cosine of a hit that only the vectors found, and how far under the best one it may lie.
FLOOR, BELOW_BEST = 0.20, 0.15


@dataclass(frozen=True)
class SearchSpec:
    query: str = ""
    vector: Sequence[float] | None = None
    mode: str = "HYBRID"
    user: int | None = None
    admin: bool = False
    category: str = ""
    department: str = ""
    status: str = ""
    page: int = 0
    size: int = 10
    server_made: bool = False
    credit: float = 1.0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}; expected one of {', '.join(MODES)}")
        if self.page < 0 or not 1 <= self.size <= 100:
            raise ValueError("page must be at least 0 and size within 1 and 100")
        if self.mode == "SEMANTIC" and self.vector is None:
            raise ValueError("semantic search needs a vector")


def keyword_leg(documents: DataFrame, spec: SearchSpec) -> DataFrame:
    """(doc_id, keyword_score, is_fuzzy) of the documents that cover enough of the query. One scan of title, description and text."""
    fuzzy = spec.mode != "KEYWORD"
    match = lexical_match(spec.query, F.col("title"), F.col("description"), F.col("text"), fuzzy)
    # a generator keeps the gate where the match is worked out: as a filter it would be pushed below and the match done twice
    passed = F.filter(F.array(match), lambda m: covers_enough(m["score"], m["matched"], m["total"]) | ((m["total"] == 0) & (m["score"] > 0)))
    kept = documents.select("doc_id", F.explode(passed).alias("m")).select("doc_id", "m.*")
    return kept.select("doc_id", (F.col("score") * spec.credit).alias("keyword_score"), (F.col("fuzzy") | F.lit(spec.credit < 1)).alias("is_fuzzy"))


def filtered_points(points: DataFrame, **payload) -> DataFrame:
    """Payload equality before any ranking; empty values filter nothing."""
    for name, value in payload.items():
        if value not in ("", None):
            points = points.where(F.col(name) == value)
    return points


def top_points(points: DataFrame, vector: Sequence[float], k: int, dimension: int | None = None) -> DataFrame:
    """The k points of highest cosine, ties by id: a bounded heap per task. Points without a usable vector don't take part."""
    if k <= 0:
        raise ValueError("k must be positive")
    if dimension is not None and len(vector) != dimension:
        raise ValueError(f"the vector has {len(vector)} values; {dimension} expected")
    scored = points.withColumn("cosine", cosine_to(F.col("vector"), vector)).where(F.col("cosine").isNotNull() & ~F.isnan("cosine"))
    return scored.orderBy(F.desc("cosine"), "point_id").limit(k)


def vector_leg(points: DataFrame, spec: SearchSpec) -> DataFrame:
    """(doc_id, vector_score, cosine, chunk_id): the best of the nearest chunks per document."""
    near = top_points(filtered_points(points, category=spec.category, department=spec.department), spec.vector, CHUNK_LIMIT)
    best = near.where("postgres_document_id is not null").groupBy(F.col("postgres_document_id").cast("long").alias("doc_id"))
    best = best.agg(F.max_by(F.struct("cosine", "chunk_id"), F.struct("cosine", -F.col("point_id"))).alias("b"))
    return best.select("doc_id", calibrated(F.col("b.cosine"), spec.server_made).alias("vector_score"), F.col("b.cosine").alias("cosine"), F.col("b.chunk_id").alias("chunk_id"))


def corrected(spec: SearchSpec, words: DataFrame) -> SearchSpec:
    """spec with words that the vocabulary (word, n_docs) doesn't hold replaced by the nearest, and the credit that leaves.

    Keyword search promises exact terms and isn't corrected. A vocabulary that can't be read leaves the
    words as typed.
    """
    if spec.mode == "KEYWORD" or not spec.query.strip():
        return spec
    try:
        found = correct_query(spec.query, words)
    except Exception as error:  # noqa: BLE001 - search goes on without
        logging.getLogger(__name__).warning("no correction, searching for the words as typed: %s", error)
        return spec
    return spec if found is None else replace(spec, query=found[0], credit=spec.credit * found[1])


def search(spec: SearchSpec, documents: DataFrame, grants: DataFrame, categories: DataFrame, points: DataFrame | None = None, paged: bool = True, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, category, score, keyword_score, vector_score, matched_by, chunk_id), best first.

    Correction where a vocabulary is given, legs, fusion, rights, hydration, status, floor, order: rights
    come before anything is counted or ranked. A missing vector store leaves the keyword leg.
    """
    if words is not None:
        spec = corrected(spec, words)
    alive = documents.where("deleted_at is null") if "deleted_at" in documents.columns else documents
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    alive = alive.join(named, "category_id", "left")
    leg = None
    if spec.mode != "SEMANTIC" and spec.query.strip():
        leg = keyword_leg(alive if not spec.category else alive.where(F.col("category") == spec.category), spec)
    near = None
    if spec.mode in ("HYBRID", "SEMANTIC") and spec.vector is not None and points is not None:
        near = vector_leg(points, spec)
    if leg is None and near is None:
        raise ValueError("neither words nor vectors to search by")
    if near is None:
        hits = leg.select("*", F.lit(None).cast("double").alias("vector_score"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("string").alias("chunk_id"))
    elif leg is None:
        hits = near.select("*", F.lit(None).cast("double").alias("keyword_score"), F.lit(False).alias("is_fuzzy"))
    else:
        hits = leg.join(near, "doc_id", "full")
    allowed = readable(alive, grants, spec.user, spec.admin)
    seen = hits.join(allowed.select("doc_id", "title", "category", "status"), "doc_id")
    if spec.status:
        seen = seen.where(F.col("status") == spec.status)
    if spec.server_made:
        best = F.max("cosine").over(Window.partitionBy())  # at most CHUNK_LIMIT documents have a cosine
        only = seen.where("keyword_score is null").withColumn("best", best).where(F.col("cosine") >= F.greatest(F.lit(FLOOR), F.col("best") - BELOW_BEST)).drop("best")
        seen = seen.where("keyword_score is not null").unionByName(only)
    marks = F.array_compact(F.array(F.when(F.col("keyword_score").isNotNull(), "KEYWORD"), F.when(F.coalesce("is_fuzzy", F.lit(False)), "FUZZY"), F.when(F.col("vector_score").isNotNull(), "VECTOR")))
    scored = seen.select("doc_id", "title", "category", combined(F.col("keyword_score"), F.col("vector_score")).alias("score"), "keyword_score", "vector_score", marks.alias("matched_by"), "chunk_id")
    if not paged:
        return scored
    return scored.orderBy(F.desc("score"), "doc_id").offset(spec.page * spec.size).limit(spec.size)


# snippets and passages


def ranked_chunks(query: str, chunks, first: int = 8):
    """Chunks that hold a term, in position order, at most the first ones; then by terms found and a bonus for the phrase."""
    wanted = query_terms(query)
    held = F.slice(F.filter(F.array_sort(F.transform(chunks, lambda c: F.struct(F.coalesce(c["position"], F.lit(0)).alias("position"), c["text"].alias("text")))), lambda c: c["text"].rlike("|".join(term_regex(t, True) for t in wanted) or "(?!)")), 1, first)

    def score(c):
        n = sum((c["text"].rlike(term_regex(t, True)).cast("int") for t in wanted), F.lit(0))
        bonus = F.when(c["text"].rlike(phrase_regex(query)), len(wanted)).otherwise(0) if len(wanted) > 1 else F.lit(0)
        return n + bonus

    keyed = F.transform(held, lambda c: F.struct((-score(c)).alias("s"), c["position"].alias("p"), c["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda c: c["text"])


def chunk_text(chunks, chunk_id):
    """The text of the chunk of an id; null where there is none."""
    return F.get(F.filter(chunks, lambda c: c["chunk_id"] == chunk_id), F.lit(0))["text"]


#: Keyword chunks of a passage, and most characters of it.
KEYWORD_CHUNKS, PASSAGE = 2, 2400


def passages(hits: DataFrame, stored: DataFrame, query: str) -> DataFrame:
    """hits with passage: the best keyword chunks and the chunk the vectors ranked best, each once; else the description; without either the hit is left out.

    hits has doc_id, chunk_id and description; stored has doc_id, kd_id and chunks, of several records of
    a document the least kd_id counts. Only the hits' records are looked at.
    """
    few = stored.join(hits.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("chunks", "kd_id").alias("chunks"))
    joined = hits.join(few, "doc_id", "left")
    parts = F.transform(F.concat(F.coalesce(F.slice(ranked_chunks(query, F.col("chunks")), 1, KEYWORD_CHUNKS), F.array().cast("array<string>")), F.array(chunk_text(F.col("chunks"), F.col("chunk_id")))), lambda t: F.trim(t))
    text = F.array_join(F.array_distinct(F.filter(parts, lambda t: t.isNotNull() & (t != ""))), "\n…\n")
    whole = F.coalesce(F.nullif(text, F.lit("")), F.col("description"))
    cut = F.when(F.length(whole) > PASSAGE, F.concat(F.substring(whole, 1, PASSAGE), F.lit("…"))).otherwise(whole)
    return joined.withColumn("passage", cut).where(F.trim("passage") != "").drop("chunks")


def best_passages(hits: DataFrame, stored: DataFrame, query: str) -> DataFrame:
    """hits with best: the chunk that a snippet is cut from, that of most terms, else the one the vectors ranked best."""
    few = stored.join(hits.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("chunks", "kd_id").alias("chunks"))
    chunk = F.coalesce(F.get(ranked_chunks(query, F.col("chunks")), F.lit(0)), chunk_text(F.col("chunks"), F.col("chunk_id")))
    return hits.join(few, "doc_id", "left").withColumn("best", F.when(F.trim(chunk) != "", chunk)).drop("chunks")


def merge_ranges(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Overlapping or touching ranges of a group as one."""
    order = Window.partitionBy(group).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(low) <= before, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


WINDOW, LEAD = 260, 70


def snippet_of(text: str | None, query: str, prefix: bool = True) -> tuple[str | None, list[tuple[int, int]]]:
    """A window that starts at a word a little before the phrase, else the earliest term, with the ranges of the words to mark."""
    import regex

    if text is None or not text.strip():
        return None, []
    word, wanted = r"[\p{L}\p{N}]", query_terms(query)
    terms = [regex.compile(rf"(?i)(?<!{word}){regex.escape(t)}" + (f"{word}*" if prefix and len(t) >= MIN_PREFIX else f"(?!{word})")) for t in wanted]
    spots = [m.start() for p in terms if (m := p.search(text))]
    whole = regex.search(rf"(?i)(?<!{word})" + r"\s+".join(map(regex.escape, query.lower().split())) + f"(?!{word})", text) if len(wanted) > 1 else None
    anchor = whole.start() if whole else min(spots, default=0)
    start = max(0, anchor - LEAD)
    if start:
        blank = text.find(" ", start, anchor)
        start = blank + 1 if blank >= 0 else anchor
    end = min(len(text), start + WINDOW)
    if end < len(text):
        blank = text.rfind(" ", start, end + 1)
        end = blank if blank > start + WINDOW // 2 else end
    shown = ("…" if start else "") + text[start:end].strip() + ("…" if end < len(text) else "")
    merged: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for p in terms for m in p.finditer(shown)):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return shown, merged


def snippets(hits: DataFrame, text: str, query: str) -> DataFrame:
    """Adds snippet and marks to a page of hits; runs after the limit, on the page only."""

    @F.pandas_udf("snippet string, marks array<array<int>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(s, [list(r) for r in m]) for s, m in (snippet_of(t, query) for t in texts)], columns=["snippet", "marks"])

    return hits.withColumn("_s", cut(F.col(text))).select(*hits.columns, "_s.snippet", "_s.marks")


# exact batched vector search

#: Values of the asking vectors held by a task at once; more of them are asked in several passes.
QUERY_VALUES = 4 << 20


def batched_search(queries: DataFrame, points: DataFrame, k: int, dimension: int) -> DataFrame:
    """(query_id, point_id, cosine, rank): the exact k nearest points of every asking vector, in blocks.

    Each pass holds at most QUERY_VALUES asking values and reads all points once; every task keeps k
    candidates an asking vector, so what is shuffled is k rows a task and question.
    """
    from docquarry.session import materialise

    asked = materialise(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>").alias("vector")).where((F.size("vector") == dimension)), "questions")
    per_pass = max(1, QUERY_VALUES // dimension)
    passes = max(1, -(-asked.count() // per_pass))
    out = None
    for i in range(passes):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()
        ids = block.column("query_id").to_numpy()
        q = np.asarray(block.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dimension)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def scan(parts, ids=ids, q=q):
            at, names, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.full(ids.size, -np.inf)  # the cosine of each question's k-th candidate so far
            for part in parts:
                usable = part["vector"].map(lambda v: v is not None and len(v) == dimension and np.isfinite(v).all() and np.any(v))
                part = part[usable.astype(bool)]
                for low in range(0, len(part), 2048):
                    x = np.stack(part["vector"].iloc[low : low + 2048]).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    own = part["point_id"].iloc[low : low + 2048].to_numpy()
                    met = [(at, names, best)]
                    for first in range(0, ids.size, 1024):
                        c = q[first : first + 1024] @ x.T
                        bar = least[first : first + 1024]
                        if own.size > k:
                            bar = np.maximum(bar, np.partition(c, own.size - k, axis=1)[:, own.size - k] if np.isneginf(bar).any() else bar)
                        i, j = np.nonzero(c >= bar[:, None] - 1e-11)
                        met.append((i + first, own[j], np.round(c[i, j], 12)))
                    at, names, best = (np.concatenate(m) for m in zip(*met))
                    order = np.lexsort((names, -best, at))
                    at, names, best = at[order], names[order], best[order]
                    place = np.arange(at.size) - np.searchsorted(at, at)
                    at, names, best = at[place < k], names[place < k], best[place < k]
                    full = place[place < k] == k - 1
                    least[at[full]] = best[full]
            if at.size:
                yield pd.DataFrame({"query_id": ids[at], "point_id": names, "cosine": best})

        found = points.select(F.col("point_id").cast("long"), "vector").mapInPandas(scan, "query_id bigint, point_id bigint, cosine double")
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "point_id")))
    return ranked.where(F.col("rank") <= k)


def title_has(df: DataFrame, term: str) -> DataFrame:
    return df.where(whole_word(F.col("title"), term))
