"""Most similar vectors by a permutation index (problem 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import broadcast_if_small, lookup_salted, materialise


#: Vectors that ask at once.
ASKED = 256


@dataclass(frozen=True)
class PermutationIndex:
    """Parameters of the index.

    order: nearest pivots that stand for a vector. posted: how many of them it is posted under. file:
    vectors that an inverted file shall hold on average, at every size of the collection. least, most:
    bounds of the number of pivots, which are a sample of the vectors by hash of their id, the only thing
    fitted on a sample; pivots beyond most would make finding the nearest ones too dear. branch: how many
    pivots share vectors with one pivot, a low guess. depth: pivots that name a file together (None: as
    many as keep the candidates of a vector near posted * file). reranked: candidates of the least
    footrule distance that are reranked in each file. spread: shelves that a vector is sent to at most,
    those of the most and nearest of its posted pivots. shelf: vectors of the collection for each shelf;
    files of like pivots stand on one shelf, so that a vector posted under several of them is sent there
    once. block: vectors of one shelf in one task; larger shelves are worked off in pairs of blocks, all
    of them.
    """

    order: int = 20
    posted: int = 8
    file: int = 512
    least: int = 16
    most: int = 4096
    branch: int = 24
    depth: int | None = None
    reranked: int = 320
    spread: int = 4
    shelf: int = 8192
    block: int = 65536

    def pivots(self, n: int) -> int:
        return max(1, min(n, self.most, max(self.least, math.ceil(n * self.posted / self.file))))

    def pivots_of_a_file(self, n: int) -> int:
        """1 up to most pivots, then as many as keep a vector's candidates from growing."""
        if self.depth is not None:
            return self.depth
        m = self.pivots(n)
        for d in range(1, self.posted):
            if math.comb(self.posted, d) * (math.comb(self.posted, d) * n / (m * self.branch ** (d - 1))) <= 2 * self.posted * self.file:
                return d
        return self.posted

    def shelves(self, n: int, pivots: int) -> tuple[int, int]:
        """Groups of pivots, and parts of a group by the second pivot of a file, where files have one."""
        groups = min(pivots, max(1, math.ceil(n / self.shelf)))
        return groups, 1 if self.pivots_of_a_file(n) == 1 else max(1, math.ceil(n * self.posted / (2 * groups * self.block)))


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector has the dimension, only finite values and not only zeros; null, empty and short ones are not."""
    inf = float("inf")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value, which the JVM copies whole."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix of binary values of one width."""
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(array), -1)


def _directions(flat: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    exact = flat.astype(np.float64)
    largest = np.abs(exact).max(axis=1, keepdims=True)
    exact /= largest
    return exact / np.linalg.norm(exact, axis=1, keepdims=True)


def arranged(pivots: np.ndarray, groups: int, rounds: int = 8) -> np.ndarray:
    """Each pivot's group: like pivots around means, a few rounds, as vectors near one pivot are near its like."""
    means = pivots[:groups].copy()
    for _ in range(rounds):
        group = np.argmax(pivots @ means.T, axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, group, pivots)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(length > 0, sums / np.maximum(length, 1e-300), means)
    return np.argmax(pivots @ means.T, axis=1)


@dataclass(frozen=True)
class Files:
    """Which files a permutation is posted in, and on which shelf each stands."""

    group: np.ndarray
    parts: int
    posted: int
    depth: int

    def shelves_of(self, ranks: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
        """(shelves in order, which of them count): each vector's distinct shelves, at most spread, those whose files weigh most by the nearness of their pivots."""
        _, shelf = self.of(ranks)
        near = self.posted - np.argsort(ranks[:, : self.posted], axis=1)
        chosen = np.array(list(combinations(range(near.shape[1]), min(self.depth, near.shape[1]))))
        weight = near[:, chosen].sum(axis=2)
        order = np.argsort(shelf, axis=1, kind="stable")
        shelf, weight = np.take_along_axis(shelf, order, 1), np.take_along_axis(weight, order, 1)
        fresh = np.ones(shelf.shape, bool)
        fresh[:, 1:] = shelf[:, 1:] != shelf[:, :-1]
        total = np.where(fresh, ((shelf[:, :, None] == shelf[:, None, :]) * weight[:, None, :]).sum(axis=2), -1)
        kept = np.zeros(shelf.shape, bool)
        np.put_along_axis(kept, np.argsort(-total, axis=1, kind="stable")[:, :spread], True, 1)
        return shelf, kept & fresh

    def of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(file, shelf) of each vector's postings: files are named by every choice of depth of its posted pivots."""
        held = np.sort(ranks[:, : self.posted].astype(np.int64), axis=1)
        chosen = np.array(list(combinations(range(held.shape[1]), min(self.depth, held.shape[1]))))
        file = np.zeros((held.shape[0], len(chosen)), np.int64)
        for column in chosen.T:
            file = file * 1_000_003 + held[:, column] + 1  # a chance collision only makes one file of two
        shelf = self.group[held[:, chosen[:, 0]]] * self.parts
        if chosen.shape[1] > 1:
            shelf = shelf + held[:, chosen[:, 1]] % self.parts
        return file, shelf


def _values(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten()).reshape(-1, dimension)


def _ordered(pivots: np.ndarray, dimension: int, order: int, files: Files, spread: int):
    table = pivots.astype(np.float32).T.copy()

    def lists(values: np.ndarray, keep: np.ndarray) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum(keep.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(values[keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, values = [], _values(batch.column("vector"), dimension)
            for low in range(0, batch.num_rows, 1024):
                near = -(_directions(values[low : low + 1024]).astype(np.float32) @ table)
                k = min(order, near.shape[1])
                head = np.argpartition(near, k - 1, axis=1)[:, :k]
                found.append(np.take_along_axis(head, np.lexsort((head, np.take_along_axis(near, head, 1)), axis=1), 1))
            if found:
                ranks = np.concatenate(found).astype(np.int16)
                held = [files.shelves_of(ranks[low : low + 1024], spread) for low in range(0, len(ranks), 1024)]
                shelves, kept = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(values), _packed(ranks), lists(shelves.astype(np.int32), kept)], names=["id", "vector", "ranks", "shelves"])

    return run


def overlaps(asked: np.ndarray, held: np.ndarray) -> Iterator[np.ndarray]:
    """For blocks of asked permutations, the overlap with each held one: the larger, the less Spearman's footrule.

    A pivot at place j weighs order - j, one that isn't among the nearest weighs 0; the footrule, the sum
    of weight differences over all pivots, is order * (order + 1) less twice the sum of the smaller
    weights, which is the overlap.
    """
    local, inverse = np.unique(np.concatenate([asked.ravel(), held.ravel()]), return_inverse=True)
    order = held.shape[1]
    own, other = inverse[: asked.size].reshape(asked.shape), inverse[asked.size :].reshape(held.shape)
    weight = np.zeros((local.size, held.shape[0]), np.uint8 if order <= 22 else np.uint16)
    weight[other, np.arange(held.shape[0])[:, None]] = np.arange(order, 0, -1, dtype=weight.dtype)
    for low in range(0, len(own), ASKED):
        rows = own[low : low + ASKED]
        shared = weight[rows[:, 0]]
        smaller = np.empty_like(shared)
        for j in range(1, order):
            np.take(weight, rows[:, j], axis=0, out=smaller, mode="clip")
            np.minimum(smaller, weight.dtype.type(order - j), out=smaller)
            np.add(shared, smaller, out=shared)
        yield shared


def _rank(k: int, reranked: int, least: float | None, files: Files):
    def best(ids_a: np.ndarray, exact_a: np.ndarray, ranks_a: np.ndarray, ids_b: np.ndarray, exact_b: np.ndarray, ranks_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared_of = overlaps(ranks_a, ranks_b) if ids_b.size > reranked else None
        small_a, small_b = exact_a.astype(np.float32), exact_b.astype(np.float32).T.copy()
        for low in range(0, ids_a.size, ASKED):
            rows = slice(low, min(low + ASKED, ids_a.size))
            cosine = small_a[rows] @ small_b
            if shared_of is not None:
                shared = next(shared_of)
                edge = np.sort(shared, axis=1, kind="stable")[:, -reranked - 1 : -reranked]
                cosine[shared < edge] = -2
            cosine[ids_a[rows][:, None] == ids_b[None, :]] = -2
            if least is not None:
                at, held = np.nonzero(cosine >= least - 1e-4)
            else:
                n = min(k + 2, ids_b.size)
                held = np.argpartition(-cosine, n - 1, axis=1)[:, :n].ravel()
                at = np.repeat(np.arange(cosine.shape[0]), n)
                real = cosine[at, held] > -2
                at, held = at[real], held[real]
            value = np.einsum("ij,ij->i", exact_a[at + low], exact_b[held])
            order = np.lexsort((ids_b[held], -value, at))
            at, held, value = at[order], held[order], value[order]
            place = np.arange(at.size) - np.searchsorted(at, at)
            keep = place < k
            if least is not None:
                keep &= value >= least
            yield ids_a[at[keep] + low], ids_b[held[keep]], value[keep]

    def unit(own: int, x: int, y: int, table: pa.Table) -> pa.RecordBatch:
        ids = table.column("id").to_numpy()
        exact = _directions(_unpacked(table.column("vector"), np.float32))
        ranks = _unpacked(table.column("ranks"), np.int16)
        block = table.column("block").to_numpy()
        file, shelf = files.of(ranks)
        row, column = np.nonzero(shelf == own)
        file = file[row, column]
        # the inverted files of this shelf, one after the other
        order = np.lexsort((row, file))
        row, file = row[order], file[order]
        edges = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1], [True])))
        found = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            here = np.unique(row[low:high])
            a, b = here[block[here] == x], here[block[here] == y]
            for p, q in ((a, b),) if x == y else ((a, b), (b, a)):
                if p.size and q.size:
                    found.extend(best(ids[p], exact[p], ranks[p], ids[q], exact[q], ranks[q]))
        a, b, cosine = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        # once each, and no more than k an asking vector
        order = np.lexsort((b, -cosine, a))
        a, b, cosine = a[order], b[order], cosine[order]
        fresh = np.ones(a.size, bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, cosine = a[fresh], b[fresh], cosine[fresh]
        keep = np.arange(a.size) - np.searchsorted(a, a) < k
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(cosine[keep])], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition holds whole units, by its number mostly one
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(c).to_numpy() for c in ("shelf", "x", "y")])
            if (keys == keys[:, :1]).all():
                yield unit(*keys[:, 0], table)
                return
            for own, x, y in np.unique(keys, axis=1).T:
                yield unit(own, x, y, table.filter(pa.array((keys == np.array([[own], [x], [y]])).all(axis=0))))

    return run


#: Share of the vectors that tells which shelves are larger than a block; it sets how the work is cut, never what is compared.
SIZED = 1 / 16


def _units(ordered: DataFrame, leaders: DataFrame, n: int, files: Files, index: PermutationIndex, of) -> tuple[DataFrame, int]:
    """(posts, number of units): each vector once on every shelf that it is posted on, with its unit of work.

    A unit is a shelf, or a pair of blocks of a large one.
    """
    large = []
    if n > index.block:
        some = of(leaders.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(round(1 / SIZED))) == 0))
        sizes = some.select(F.explode("shelves").alias("shelf")).groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / (index.block * SIZED)).cast("int").alias("blocks"))
        large = [(x["shelf"], x["blocks"]) for x in sizes.where("blocks > 1").collect()]  # at most one row a shelf
    first = (int(files.group.max()) + 1) * files.parts
    rows = []
    for shelf, blocks in large:
        rows.append((shelf, blocks, first))
        first += blocks * blocks
    posts = ordered.withColumn("shelf", F.explode("shelves"))
    if not rows:
        zero = F.lit(0)
        return posts.select(F.col("shelf").alias("unit"), "shelf", zero.alias("x"), zero.alias("y"), "id", "vector", "ranks", zero.alias("block")), first
    blocks = ordered.sparkSession.createDataFrame(rows, "shelf int, blocks int, first int")
    posts = posts.join(F.broadcast(blocks), "shelf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("shelf", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "vector", "ranks", "block", "blocks", "first")
    unit = F.coalesce(F.col("first") + F.col("x") * F.col("blocks") + F.col("y"), F.col("shelf"))
    return posts.select(unit.alias("unit"), "shelf", "x", "y", "id", "vector", "ranks", "block"), first


def _looked_up(left: DataFrame, right: DataFrame, key: str, spread: str, rows: int, row_bytes: int) -> DataFrame:
    """Left join on a key that may be hot: a broadcast while right's counted rows are few, else with salts."""
    small = broadcast_if_small(right, rows, row_bytes)
    return left.join(small, key, "left") if small is not right else lookup_salted(left, right, key, F.col(spread))


def nearest_vectors(df: DataFrame, row_id: str, vector: str, k: int = 5, dimension: int = 64, least: float | None = None, index: PermutationIndex = PermutationIndex()) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar vectors of each usable vector, rank from 1, ties by id.

    With least, only neighbours of at least that cosine. Unusable vectors (see usable) neither ask nor
    answer; ids must be integers, and one that comes twice should carry one vector; fewer than k others
    give fewer rows; an empty table gives none; other columns aren't read.

    Every vector is posted in the inverted files of its nearest pivots; each file ranks its members
    for each other by footrule distance and reranks the nearest by cosine. The number of pivots grows
    with the collection, and beyond the most pivots the number that name a file together does, so that
    files keep their length and the work of a vector its amount. Equal vectors are one while searching:
    a copy takes part through the class's least k + 1 ids, and looks its neighbours up with salts.
    Pivots are drawn from the data, so dense regions have more of them; shelves that are large all the
    same are worked off in pairs of blocks. Recall against brute force is measured in the tests.
    """
    points = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col(vector), dimension))
    prints = [F.xxhash64("vector").alias("print_1"), F.xxhash64(F.lit(7), "vector").alias("print_2")]
    names = ["print_1", "print_2"]
    printed = materialise(points.select("id", *prints).distinct(), "prints")
    n = printed.count()
    classes = printed.groupBy(*names).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = materialise(printed.join(classes, names).select("id", "class"), "copies")
    n_copies = copies.count()
    leaders = points.dropDuplicates(["id"]) if n != points.count() else points
    leaders = leaders.join(broadcast_if_small(copies.where("id <> class").select("id"), n_copies, 24), "id", "left_anti")
    m = index.pivots(n)
    drawn = leaders.orderBy(F.xxhash64("id"), "id").limit(m).select("vector").toArrow()
    if not drawn.num_rows:
        return points.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank")).where("false")
    pivots = _directions(_values(drawn.column("vector"), dimension))
    groups, parts = index.shelves(n, len(pivots))
    files = Files(arranged(pivots, groups), parts, index.posted, index.pivots_of_a_file(n))
    schema = "id bigint, vector binary, ranks binary, shelves array<int>"
    of = lambda frame: frame.mapInArrow(_ordered(pivots, dimension, index.order, files, index.spread), schema)
    posts, units = _units(of(leaders), leaders, n, files, index, of)
    found = posts.repartitionById(units, F.col("unit")).mapInArrow(_rank(k, index.reranked, least, files), "a bigint, b bigint, cosine double")
    # one exchange serves both the distinct pairs and the ranking
    merged = found.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
    if not n_copies:
        return merged.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", "rank")
    # copies ask like their class, and answer for it by its least ids; lists hold at most k + 1 of them
    merged = materialise(merged.drop("rank"), "merged")
    least_ids = copies.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1)
    answers = least_ids.groupBy("class").agg(F.collect_list("id").alias("answers"))
    held = merged.groupBy(F.col("a").alias("class")).agg(F.collect_list(F.struct("b", "cosine")).alias("held")).join(broadcast_if_small(classes.select("class"), n_copies, 16), "class", "left_semi")
    rest = copies.where("id <> class")
    asks = _looked_up(rest, held, "class", "id", n_copies, 32 + 24 * k).select("id", F.explode("held").alias("h")).select("id", "h.b", "h.cosine")
    asks = merged.select(F.col("a").alias("id"), "b", "cosine").unionByName(asks)
    both = _looked_up(asks, answers.select(F.col("class").alias("b"), "answers"), "b", "id", n_copies, 32 + 8 * k)
    both = both.select("id", F.explode(F.coalesce("answers", F.array("b"))).alias("neighbour"), "cosine")
    own = _looked_up(copies, answers, "class", "id", n_copies, 32 + 8 * k).select("id", F.explode("answers").alias("neighbour"), F.lit(1.0).alias("cosine")).where("id <> neighbour")
    every = both.unionByName(own).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return every.where(F.col("rank") <= k)
