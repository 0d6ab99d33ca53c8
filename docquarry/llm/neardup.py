"""Near-duplicate records by covering locality-sensitive hashing (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.grid import alnum_table, codes, distinct, mix, text_slices, tokenise
from docquarry.operators.components import connected_components
from docquarry.session import broadcast_if_small, drop_materialised, materialise

_RUN = re.compile(r"[^\W_]+")


def word_shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) of all sequences of consecutive runs of letters and digits, in lower case."""
    at, _, _, h = tokenise([t.lower() if t else t for t in texts], alnum_table())
    n = at.size - words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = mix(total + h[k : k + n])
    whole = at[:n] == at[words - 1 :]
    return distinct(at[:n][whole], total[whole])


def letter_shingles(texts: list[str | None], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) of all substrings of so many characters of the runs joined by one blank, in lower case."""
    joined = [" ".join(_RUN.findall(t.lower())) if t else "" for t in texts]
    lengths = np.fromiter((len(t) for t in joined), np.int64, len(joined))
    c = codes("".join(joined)).astype(np.uint64)
    at = np.repeat(np.arange(len(joined)), lengths)
    n = c.size - letters + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(letters):
        total = mix(total + c[k : k + n] + np.uint64(1))
    whole = at[:n] == at[letters - 1 :]
    return distinct(at[:n][whole], total[whole])


SHINGLES: dict[str, Callable] = {"words": word_shingles, "letters": letter_shingles}


@dataclass(frozen=True)
class Covering:
    """Structured masks over a sketch of minhash symbols.

    The sketch has groups of sum(widths) symbols. Each group's positions fall into three classes, and
    three masks leave out one class each: the covering family of radius 1, as any one position lies
    in a class that one of the masks leaves out. So two sketches that differ in at most
    2 * groups - 1 positions differ in at most one position of some group, and collide there.

    At similarity s a group fails with 1 - (ab + ac + bc - 2abc), a, b, c being s to the widths.
    """

    groups: int
    widths: tuple[int, int, int]

    @property
    def symbols(self) -> int:
        return self.groups * sum(self.widths)

    def miss(self, s: float) -> float:
        """Chance that a pair of similarity s collides under no mask."""
        a, b, c = (s**w for w in self.widths)
        return (1 - (a * b + a * c + b * c - 2 * a * b * c)) ** self.groups

    def signatures(self, sketch: np.ndarray) -> np.ndarray:
        """One 64-bit signature per mask, for a sketch of (symbols, texts)."""
        out, k = [], 0
        for group in range(self.groups):
            classes = []
            for width in self.widths:
                key = np.zeros(sketch.shape[1], np.uint64)
                for _ in range(width):
                    key = mix(key + sketch[k])
                    k += 1
                classes.append(key)
            for left_out in range(3):
                x, y = (classes[i] for i in range(3) if i != left_out)
                out.append(mix(x * np.uint64(3) + mix(y + np.uint64(3 * group + left_out + 1))))
        return np.stack(out, axis=1)


#: Symbols of which two bits each are kept for a first estimate, and how many standard deviations it may lie under the limit.
DIGEST = 128
DEVIATIONS = 5.0
#: Each word of a digest holds two bits of so many symbols.
A_WORD = 32
DIGESTS = [f"digest_{k + 1}" for k in range(DIGEST // A_WORD)]


def _sketches(kind: str, size: int, covering: Covering) -> Callable:
    need = max(covering.symbols, DIGEST)
    odd = np.frombuffer(np.random.default_rng(20260912).bytes(8 * need), np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_slices(batch.column("text")):
                at, h = SHINGLES[kind](texts, size)
                if not at.size:
                    continue
                rows, first, counts = np.unique(at, return_index=True, return_counts=True)
                sketch = np.stack([np.minimum.reduceat(h * a, first) for a in odd])
                prints = [np.add.reduceat(mix(h + np.uint64(salt)), first).view(np.int64) for salt in (1, 2)]
                bits = mix(sketch[:DIGEST]) & np.uint64(3)
                shift = (np.arange(A_WORD, dtype=np.uint64) * np.uint64(2))[:, None]
                digest = [np.bitwise_or.reduce(bits[k : k + A_WORD] << shift, axis=0).view(np.int64) for k in range(0, DIGEST, A_WORD)]
                marks = covering.signatures(sketch).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(rows.size + 1, dtype=np.int32) * marks.shape[1], pa.array(marks.ravel()))
                columns = [batch.column("id").slice(low, len(texts)).take(pa.array(rows)), pa.array(counts.astype(np.int32)), *map(pa.array, prints), *map(pa.array, digest), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "print_1", "print_2", *DIGESTS, "marks"])

    return run


def _sets(kind: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_slices(batch.column("text")):
                at, h = SHINGLES[kind](texts, size)
                rows, first = np.unique(at, return_index=True)
                lists = pa.ListArray.from_arrays(np.append(first, h.size).astype(np.int32), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, len(texts)).take(pa.array(rows)), lists], names=["id", "elements"])

    return run


def _agreeing(a: Column, b: Column) -> Column:
    """Symbols of which both bits agree, in one digest word."""
    x = a.bitwiseXOR(b)
    return F.lit(A_WORD) - F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))


def _least_agreeing(symbols: int, chance: float) -> float:
    """How many of so many symbols agree at least, each agreeing with the given chance, but for DEVIATIONS standard deviations."""
    return symbols * chance - DEVIATIONS * (symbols * chance * (1 - chance)) ** 0.5


#: Columns of the short digest: one bit of each symbol of the digest, those of two words in one.
BITS = [f"bits_{k + 1}" for k in range(len(DIGESTS) // 2)]


def _one_bit_each() -> list[Column]:
    low = [F.col(d).bitwiseAND(F.lit(0x5555555555555555)) for d in DIGESTS]
    return [low[2 * k].bitwiseOR(F.shiftleft(low[2 * k + 1], 1)).alias(b) for k, b in enumerate(BITS)]


#: Members of a bucket that are compared with each other in one piece; buckets that a sample of the rows shows to be larger are cut into pairs of blocks.
BUCKET = 4000
SIZED = 1 / 64


def _bucket_pairs(leaders: DataFrame, limit: float, bucket: int, sized: float) -> DataFrame:
    """(class_a, class_b), class_a < class_b: the pairs that share a bucket and whose short digests don't rule them out, each once.

    A bucket of many different texts would be one task's work, quadratic in its size. Its members fall
    into blocks by hash, and each pair of blocks is a join key of its own. The sample decides only how
    the work is cut: every pair of blocks is joined. Pairs of unlike texts that meet by chance grow with
    the square of the rows; the short digest drops them where they meet, before anything of a pair is
    shuffled.
    """
    spread = leaders.select("id", *_one_bit_each(), F.explode("marks").alias("mark"))
    some = spread.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(round(1 / sized))) == 0)
    hot = materialise(some.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) / (bucket * sized)).cast("int").alias("blocks")).where("blocks > 1"), "hot")
    n_hot = hot.count()
    differing = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BITS), F.lit(0))
    # a bit of unlike symbols agrees with a chance of one half
    alike = DIGEST - differing >= _least_agreeing(DIGEST, limit + (1 - limit) / 2)
    side = lambda x: [F.col("id").alias(f"class_{x}"), *(F.col(b).alias(f"{b}_{x}") for b in BITS)]
    if not n_hot:
        a, b = (spread.select("mark", *side(x)) for x in "ab")
        return a.join(b, "mark").where((F.col("class_a") < F.col("class_b")) & alike).select("class_a", "class_b").distinct()
    posts = spread.join(broadcast_if_small(hot, n_hot, 48), "mark", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("mark", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", *BITS)
    a, b = (posts.select("mark", "x", "y", *side(x), F.col("block").alias(f"block_{x}")) for x in "ab")
    met = a.join(b, ["mark", "x", "y"]).where(F.expr("class_a < class_b and (x = y or block_a <> block_b)") & alike)
    return met.select("class_a", "class_b").distinct()


def near_duplicates(df: DataFrame, row_id: str, text: str, kind: str = "words", size: int = 5, limit: float = 0.8, covering: Covering = Covering(15, (3, 3, 3)), bucket: int = BUCKET, sized: float = SIZED) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of rows with equal shingle sets, and the similar pairs of classes.

    members has (id, class), class being the least id of its rows; links has (class_a, class_b,
    similarity), class_a < class_b, for classes whose Jaccard similarity is at least limit. Null texts
    and texts without a shingle are in no class; an id that comes twice should carry one text; ties
    can't matter; an empty table gives two empty results; other columns aren't read.

    Copies are collapsed to classes by a 128-bit fingerprint first, so a text that a third of all rows
    share is one row from then on. Classes that share a signature under any mask of the covering are
    candidates; half of a 256-bit digest travels with each signature, the whole digest is looked up for
    the pairs that this leaves, and either drops those whose estimate lies more than DEVIATIONS standard
    deviations under the limit (a chance of 3e-7 each for a pair at the limit); the rest is verified on
    the whole sets. Buckets are joined, not gathered, large ones in pairs of
    blocks. The chance of losing a pair at the limit is covering.miss(limit).
    """
    asked = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    of = asked.dtypes[0][1]
    rows = materialise(asked.mapInArrow(_sketches(kind, size, covering), f"id {of}, n int, print_1 bigint, print_2 bigint, {', '.join(f'{d} bigint' for d in DIGESTS)}, marks array<bigint>"), "sketches")
    prints = ["n", "print_1", "print_2"]
    least = rows.groupBy(*prints).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))
    # only classes of several rows need looking up; the others are their own class
    copied = rows.select("id", *prints).join(least.where("copies > 1"), prints).select("id", "class").distinct()
    copied = materialise(copied, "copies")
    n_copied = copied.count()
    rest = broadcast_if_small(copied.where("id <> class").select("id"), n_copied, 48)
    leaders = rows.join(rest, "id", "left_anti")
    pairs = _bucket_pairs(leaders, limit, bucket, sized)
    n_rows = rows.count()
    brief = rows.select("id", "n", *DIGESTS).dropDuplicates(["id"])
    for side in "ab":
        pairs = pairs.join(broadcast_if_small(brief.select([F.col(c).alias(f"{'class' if c == 'id' else c}_{side}") for c in brief.columns]), n_rows, 160), f"class_{side}")
    floor = _least_agreeing(DIGEST, limit + (1 - limit) / 4)
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(limit)
    agreeing = sum((_agreeing(F.col(f"{d}_a"), F.col(f"{d}_b")) for d in DIGESTS), F.lit(0))
    likely = pairs.where(sized & (agreeing >= floor)).select("class_a", "class_b", "n_a", "n_b")
    likely = materialise(likely, "likely")
    n_likely = likely.count()
    involved = likely.select(F.explode(F.array("class_a", "class_b")).alias("id")).distinct()
    sets = asked.join(broadcast_if_small(involved, 2 * n_likely, 48), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(kind, size), f"id {of}, elements array<bigint>")
    sets = materialise(sets, "sets")
    judged = likely.join(sets.select(F.col("id").alias("class_a"), F.col("elements").alias("elements_a")), "class_a").join(sets.select(F.col("id").alias("class_b"), F.col("elements").alias("elements_b")), "class_b")
    shared = F.size(F.array_intersect("elements_a", "elements_b"))
    links = judged.select("class_a", "class_b", "n_a", "n_b", shared.alias("shared")).select("class_a", "class_b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= limit)
    links = materialise(links, "similar")
    drop_materialised(sets)
    members = rows.select("id").distinct().join(broadcast_if_small(copied, n_copied, 64), "id", "left").select("id", F.coalesce("class", "id").alias("class"))
    return members, links


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, group, n_links): one row per record; group is the least class tied to its class over links, n_links its class's links."""
    groups = connected_components(links, "class_a", "class_b").select(F.col("node").alias("class"), F.col("component").alias("group"))
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(groups.join(degree, "class"), "class", "left").select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of similar records, copies expanded. Quadratic in the copies of a text by definition."""
    # a link joins the members of two classes, a loop those of one
    several = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = links.select("class_a", "class_b").unionByName(several.select(F.col("class").alias("class_a"), F.col("class").alias("class_b")))
    a, b = (members.select(F.col("class").alias(f"class_{x}"), F.col("id").alias(f"m_{x}")) for x in "ab")
    both = ties.join(a, "class_a").join(b, "class_b").where("class_a <> class_b or m_a < m_b")
    return both.select(F.least("m_a", "m_b").alias("id_a"), F.greatest("m_a", "m_b").alias("id_b"))
