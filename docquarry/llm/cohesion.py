"""Splitting long texts at natural boundaries by lexical cohesion (problem 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.grid import codes, nonblank_table, slices, tokenise

#: Words of a block on either side of a boundary, and the shortest word that counts for cohesion.
BLOCK = 40
LEAST_LETTERS = 4
_BLANKS = re.compile(r"[ \t\r\n]+")
_WORD = re.compile(r"[^ \t\r\n]+")
# Ends of sentences, and what may close after them.
_ENDERS, _CLOSERS = ".!?…。！？؟", "\"'”’»)]}"
_ENDER_CODES, _CLOSER_CODES = codes(_ENDERS), codes(_CLOSERS)


def words_of(text: str | None) -> list[str]:
    """The runs of characters other than blank, tab, carriage return and line feed."""
    return [w for w in _BLANKS.split(text) if w] if text else []


def cohesion(at: np.ndarray, hashes: np.ndarray, counted: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Cosine of the word counts of the blocks before and after each word, for many texts at once.

    A repeated word at i < j is one product for every gap that has i in the block before it and j in
    the block after; gaps form an interval, so all cosines come from a few difference arrays. Words
    repeat within a window of two blocks only, which keeps it linear in the number of words.
    """
    n = at.size
    cross, left, right = (np.zeros(n + 1) for _ in range(3))
    own = np.concatenate(([0.0], np.cumsum(counted)))
    first = np.searchsorted(at, at, side="left")
    last = np.searchsorted(at, at, side="right")
    spots = np.flatnonzero(counted)
    order = spots[np.lexsort((spots, hashes[spots], at[spots]))]
    for far in range(1, 2 * block):
        i, j = order[:-far], order[far:]
        near = (hashes[i] == hashes[j]) & (at[i] == at[j]) & (j - i < 2 * block)
        if not near.any():
            break
        i, j = i[near], j[near]
        for out, low, high in ((cross, np.maximum(i + 1, j - block + 1), np.minimum(j, i + block)), (left, j + 1, np.minimum(i + block, last[j])), (right, np.maximum(j - block + 1, first[i]), i)):
            ok = low <= high
            np.add.at(out, low[ok], 1.0)
            np.add.at(out, np.minimum(high[ok] + 1, n), -1.0)
    gap = np.arange(n)
    before = own[gap] - own[np.maximum(first, gap - block)]
    after = own[np.minimum(last, gap + block)] - own[gap]
    scale = np.sqrt(np.maximum(before + 2 * np.cumsum(left)[:n], 0) * np.maximum(after + 2 * np.cumsum(right)[:n], 0))
    return np.divide(np.cumsum(cross)[:n], scale, out=np.zeros(n), where=scale > 0)


def valley_depth(similar: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """How deep each gap lies under the nearest peaks on both sides, over one text's candidate gaps in order."""
    s = similar[gaps]
    depth = np.zeros(gaps.size)
    for values, out in ((s, depth), (s[::-1], depth[::-1])):
        # the peak is where values stop to rise on the way back
        starts = np.arange(values.size)
        starts[1:][values[:-1] >= values[1:]] = 0
        out += values[np.maximum.accumulate(starts)] - values
    return depth


def cuts(n_words: int, tiers: Sequence[tuple[np.ndarray, np.ndarray]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (first word, end) of at most limit words that each open with the last overlap words before.

    tiers has boundaries with their depths, the better ones first: the cut is the deepest valley of the
    first tier in the second half of the window, else its last boundary in the window, else the same of
    the next tier, else the window's end.
    """
    out, start, fresh = [], 0, 0
    while n_words - start > limit:
        end = start + limit
        for gaps, depth in tiers:
            low, middle, high = np.searchsorted(gaps, (fresh + 1, fresh + max(1, (start + limit - fresh) // 2), start + limit + 1))
            if low < high:
                end = int(gaps[middle + int(np.argmax(depth[middle:high]))] if middle < high else gaps[high - 1])
                break
        out.append((start, end))
        fresh, start = end, max(0, end - overlap)
    out.append((start, n_words))
    return out


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before which a sentence or, after a blank line, a paragraph begins; and those before which any line does, too."""
    c = codes(text)
    lines = np.concatenate(([0], np.cumsum(c == 10)))
    between = lines[starts[1:]] - lines[ends[:-1]]
    last = ends[:-1] - 1
    # what may close after the end of a sentence
    for _ in range(int((ends - starts).max(initial=0))):
        closing = np.isin(c[last], _CLOSER_CODES) & (last > starts[:-1])
        if not closing.any():
            break
        last = last - closing
    strong = (between > 1) | np.isin(c[last], _ENDER_CODES)
    return np.flatnonzero(strong) + 1, np.flatnonzero(strong | (between > 0)) + 1


def bad_pieces(text: str | None, chunks: list[dict] | None, limit: int, overlap: int) -> list[int]:
    """Positions of stored pieces that are too long, don't open with the overlap, or don't stand in the text. Null pieces and positions are skipped."""
    stored: dict[int, list[list[str]]] = {}
    for x in chunks or ():
        if x is not None and x["position"] is not None:
            stored.setdefault(x["position"], []).append(words_of(x["text"]))
    whole = f" {' '.join(words_of(text))} "
    bad, before = [], None
    for position in sorted(stored):
        for words in stored[position]:
            tail = before[-overlap:] if before is not None and overlap else []
            if len(words) > limit or words[: len(tail)] != tail or (words and f" {' '.join(words)} " not in whole):
                bad.append(position)
                break
        before = stored[position][-1]
    return bad


def kept_pieces(chunks: list[dict] | None) -> list[dict]:
    """Stored pieces that have a position, in its order."""
    return sorted((x for x in chunks or () if x is not None and x["position"] is not None), key=lambda x: x["position"])


def fit_pieces(text: str | None, chunks: list[dict] | None, limit: int, overlap: int) -> bool:
    """Whether stored pieces that break no rule of bad_pieces may stay.

    Chained with their overlaps they must be the text's words from first to last, each piece with
    new ones; and none may end off a paragraph or sentence end while one lies in reach, or off a line's
    end while there is only that. In reach are, as for cuts, the ends after the piece before and at most limit words from the
    piece's first word. The text's own end is always one.
    """
    spans = [m.span() for m in _WORD.finditer(text or "")]
    words = [text[a:b] for a, b in spans]
    start = end = 0
    inner = []
    for x in kept_pieces(chunks):
        own = words_of(x["text"])
        fresh, start = end, max(start, end - overlap)
        end = start + len(own)
        if end <= fresh or words[start:end] != own:
            return False
        if end < len(words):
            inner.append((fresh, start, end))
    if not words or end < len(words):
        return False
    if not inner:
        return True
    tiers = boundaries(text, *np.array(spans, dtype=np.int64).T)

    def natural(fresh: int, start: int, end: int) -> bool:
        for gaps in tiers:
            low, high = np.searchsorted(gaps, (fresh + 1, start + limit + 1))
            if low < high:
                return end in gaps[low:high]
        return True

    return all(natural(*piece) for piece in inner)


def split_batch(texts: list[str | None], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """For each text, its pieces as character ranges."""
    out: list[list[tuple[int, int]]] = []
    for low, high in slices(texts):
        part = texts[low:high]
        folded = [t.lower() if t and len(t.lower()) == len(t) else t for t in part]
        at, starts, ends, hashes = tokenise(folded, nonblank_table())
        edges = np.searchsorted(at, np.arange(len(part) + 1))
        long = np.diff(edges) > limit
        keep = long[at] if at.size else np.zeros(0, bool)
        similar = np.zeros(at.size)
        if keep.any():
            similar[keep] = cohesion(at[keep], hashes[keep], (ends - starts >= LEAST_LETTERS)[keep])
        for k, text in enumerate(part):
            a, b = edges[k], edges[k + 1]
            if a == b:
                out.append([])
            elif not long[k]:
                out.append([(int(starts[a]), int(ends[b - 1]))])
            else:
                tiers = [(gaps, valley_depth(similar[a:b], gaps)) for gaps in boundaries(text, starts[a:b], ends[a:b])]
                pieces = cuts(int(b - a), tiers, limit, overlap)
                out.append([(int(starts[a + x]), int(ends[a + y - 1])) for x, y in pieces])
    return out


def _recut(limit: int, overlap: int):
    piece = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            chunks = batch.column("chunks").to_pylist()
            bad = [bad_pieces(t, c, limit, overlap) for t, c in zip(texts, chunks, strict=True)]
            # texts whose stored pieces are all good and fit keep them
            cut = [k for k in range(len(texts)) if bad[k] or not chunks[k] or not fit_pieces(texts[k], chunks[k], limit, overlap)]
            pieces: list = [None] * len(texts)
            for k, found in zip(cut, split_batch([texts[k] for k in cut], limit, overlap), strict=True):
                pieces[k] = [{"start": a, "end": b} for a, b in found]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(bad, pa.list_(pa.int32())), pa.array(pieces, pa.list_(piece))], names=["row_id", "bad", "pieces"])

    return run


def recut(df: DataFrame, row_id: str, text: str, chunks: str | None = None, limit: int = 180, overlap: int = 40) -> DataFrame:
    """(row_id, bad, pieces): verdict on the stored pieces and, where one is bad or unfit or none is stored, new pieces.

    bad holds the positions of stored pieces over the limit, without the overlap, or not standing in
    the text; pieces holds character ranges of the text, in order, or null where all stored pieces are
    good, cover every word, and none ends off a paragraph or sentence end with one in reach (fit_pieces). A null, empty or blank text gives no pieces. A text within the limit is one piece. A longer
    one is cut where word counts of the blocks around a paragraph or sentence end are least alike
    (the deepest valley in reach), each piece opening with the last overlap words before; where no
    such end lies in reach, at a line's end, and without one at the limit. Whole texts are read, in one pass, without a shuffle; rows
    are independent, so repeated rows are cut alike; other columns aren't read.
    """
    return _asked(df, row_id, text, chunks, limit, overlap).mapInArrow(_recut(limit, overlap), f"row_id {_type(df, row_id)}, bad array<int>, pieces array<struct<start:int,end:int>>")


def _type(df: DataFrame, name: str) -> str:
    return df.select(F.col(name).alias("x")).dtypes[0][1]


def _asked(df: DataFrame, row_id: str, text: str, chunks: str | None, limit: int, overlap: int) -> DataFrame:
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    stored = F.transform(F.col(chunks), lambda x: F.struct(x["text"].alias("text"), x["position"].cast("int").alias("position"))) if chunks else F.lit(None)
    return df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), stored.cast("array<struct<text:string,position:int>>").alias("chunks"))


def piece_rows(df: DataFrame, row_id: str, text: str, chunks: str | None = None, limit: int = 180, overlap: int = 40) -> DataFrame:
    """(row_id, position, text, word_count): every text's pieces, kept or new, as rows; positions from 0.

    Same cases as recut.
    """
    return _asked(df, row_id, text, chunks, limit, overlap).mapInArrow(_piece_rows(limit, overlap), f"row_id {_type(df, row_id)}, position int, text string, word_count int")


def _piece_rows(limit: int, overlap: int):
    judge = _recut(limit, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (judged,) = judge(iter([batch]))
            ids, texts, chunks = (batch.column(c).to_pylist() for c in ("row_id", "text", "chunks"))
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for row, text, old, new in zip(ids, texts, chunks, judged.column("pieces").to_pylist(), strict=True):
                if new is None:
                    own = [x["text"] or "" for x in kept_pieces(old)]
                else:
                    own = [text[x["start"] : x["end"]] for x in new]
                for k, piece in enumerate(own):
                    for column, value in zip(rows, (row, k, piece, len(words_of(piece))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column("row_id").type), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int32())], names=["row_id", "position", "text", "word_count"])

    return run
