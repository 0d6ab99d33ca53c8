"""Models of documents on words and word pairs that are held by columns: no vocabulary and no weights reach the driver.

A gram's column, the rows it stands in and how often, lies whole in one of many chunks. What the driver
holds are numbers of rows by labels: a linear machine is fitted in the span of its gradients, whose inner products
and whose values on every row are all that descent needs. A gradient's values are a sum over chunks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.operators.learning import _slot_grams
from docquarry.session import drop_materialised, forget_shuffles, materialise

#: Characters of text whose grams are sorted in one piece, and characters for each chunk of columns.
SLOT_LETTERS = 8 << 20
CHUNK_LETTERS = 4 << 20
BLOCK = 1 << 20

_CUT = "bucket int, slot bigint, n int, trained binary, keys binary, sizes binary, rows binary, tf binary"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte tells how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if not x.size or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[x[0]], offset=1)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes[:-1], dtype=np.int64)) if sizes.size else np.zeros(0, np.int64)


def _cutter(buckets: int, slot_letters: int) -> Callable:
    """Batches of rows to the columns of their slots by bucket; bucket -1 has the slot's rows themselves."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def cut(t: pa.Table, slot: int) -> pa.RecordBatch:
        n = t.num_rows
        trained = np.packbits(t.column("part").to_numpy() == 0).tobytes()
        at, gram, tf, keys = _slot_grams(t.column("tokens"))
        keys = keys.view(np.uint64)
        by_key = np.argsort(keys)
        rank = np.empty(keys.size, np.int64)
        rank[by_key] = np.arange(keys.size)
        code = rank[gram]
        order = np.argsort(code * max(1, n) + at)
        at, tf, sizes, keys = at[order], tf[order], np.bincount(code, minlength=keys.size), keys[by_key]
        lows = np.concatenate([[0], np.searchsorted(keys, edges), [keys.size]])
        ends = np.append(0, np.cumsum(sizes))[lows]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(["id", "label"]).schema) as writer:
            writer.write_table(t.select(["id", "label"]))
        y, part = t.column("y").fill_null(-1).to_numpy() + 1, t.column("part").to_numpy()
        out = [(-1, trained, sink.getvalue().to_pybytes(), b"", _packed(y), _packed(part))]
        for b in range(buckets):
            k, e = slice(lows[b], lows[b + 1]), slice(ends[b], ends[b + 1])
            out.append((b, trained, keys[k].tobytes(), _packed(sizes[k]), _packed(at[e]), _packed(tf[e])))
        bucket, trained_, *rest = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([slot] * len(out), pa.int64()), pa.array([n] * len(out), pa.int32()), pa.array(trained_, pa.binary()), *(pa.array(x, pa.binary()) for x in rest)], names=["bucket", "slot", "n", "trained", "keys", "sizes", "rows", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, slot = [], 0, TaskContext.get().partitionId() << 24
        for b in batches:
            held.append(b)
            letters += sum(x or 0 for x in b.column("letters").to_pylist())
            if letters >= slot_letters:
                yield cut(pa.Table.from_batches(held), slot)
                held, letters, slot = [], 0, slot + 1
        if held and sum(b.num_rows for b in held):
            yield cut(pa.Table.from_batches(held), slot)

    return run


def _merged(own: pa.Table) -> pa.Table:
    """The columns of all slots of a bucket as one chunk, of grams that at least two rows of part 0 have; rows count on from slot to slot."""
    if own.column("bucket")[0].as_py() < 0:
        return own
    parts = sorted(own.to_pylist(), key=lambda x: x["slot"])
    offsets = _starts(np.array([p["n"] for p in parts]))
    trained = np.concatenate([np.unpackbits(np.frombuffer(p["trained"], np.uint8), count=p["n"]) for p in parts]).astype(bool)
    keys = np.concatenate([np.frombuffer(p["keys"], np.uint64) for p in parts])
    sizes = np.concatenate([_unpacked(p["sizes"]).astype(np.int64) for p in parts])
    rows = np.concatenate([_unpacked(p["rows"]).astype(np.int32) + np.int32(o) for p, o in zip(parts, offsets)])
    tf = np.concatenate([_unpacked(p["tf"]) for p in parts])
    del parts
    order = np.argsort(keys, kind="stable")
    keys, begin, sizes = keys[order], _starts(sizes)[order], sizes[order]
    take = np.repeat(begin - _starts(sizes), sizes) + np.arange(rows.size)
    rows, tf = rows[take], tf[take]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    keys, sizes = keys[first], np.add.reduceat(sizes, first) if first.size else sizes
    df = np.add.reduceat(trained[rows].astype(np.int64), _starts(sizes)) if first.size else sizes
    kept = df >= 2
    mine = np.repeat(kept, sizes)
    rows, tf, sizes = rows[mine], tf[mine], sizes[kept]
    # distances within a column take fewer bytes
    steps = np.diff(rows, prepend=0)
    steps[_starts(sizes)] = rows[_starts(sizes)]
    return pa.table({"bucket": own.column("bucket")[:1], "slot": pa.array([-1], pa.int64()), "n": pa.array([int(kept.sum())], pa.int32()), "trained": pa.array([_packed(df[kept])], pa.binary()), "keys": pa.array([keys[kept].tobytes()], pa.binary()), "sizes": pa.array([_packed(sizes)], pa.binary()), "rows": pa.array([_packed(steps)], pa.binary()), "tf": pa.array([_packed(tf)], pa.binary())})


class Columns:
    """The columns of rows in numbered parts, of which part 0 is fitted on.

    Grams are those of operators.tfidf.grams of at least two rows of part 0, with inverse document frequencies
    from it, each row of length 1: learning.text_features without its vocabulary. Grams are named by 64-bit hashes.
    Labels are few; the driver holds their numbers by rows.
    """

    def __init__(self, rows: DataFrame, part: str, text: str, label: str, row_id: str, slot_letters: int = SLOT_LETTERS, chunk_letters: int = CHUNK_LETTERS):
        self.spark, self.row_id = rows.sparkSession, row_id
        named = rows.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("letters")).collect()
        first = [r for r in named if r[part] == 0]
        self.labels = [x for _, x in sorted(((r["n"], r[label]) for r in first if r[label] is not None), key=lambda x: (-x[0], x[1]))]
        n_first, letters = sum(r["n"] for r in first), sum(r["letters"] for r in named)
        y = (F.array_position(F.array(*map(F.lit, self.labels)), F.col(label)) - 1).cast("int") if self.labels else F.lit(None).cast("int")
        every = rows.select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.when(y >= 0, y).alias("y"), F.col(part).cast("int").alias("part"), F.col(text).alias("text"))
        self.kinds = dict(every.dtypes)
        buckets = max(1, -(-letters // chunk_letters))
        cut = every.select("id", "label", "y", "part", F.length("text").alias("letters"), tokens(F.col("text")).alias("tokens"))
        held = cut.mapInArrow(_cutter(buckets, slot_letters), _CUT).groupBy("bucket").applyInArrow(_merged, _CUT)
        self.table = materialise(held, "columns")
        forget_shuffles(self.spark)
        self.heads = self.table.where("bucket < 0")
        heads = sorted(self.heads.select("slot", "n", F.col("rows").alias("y"), F.col("tf").alias("part")).collect(), key=lambda r: r["slot"])
        self.offsets = dict(zip([r["slot"] for r in heads], _starts(np.array([r["n"] for r in heads], np.int64)).tolist()))
        gather = lambda name: np.concatenate([_unpacked(bytes(r[name])).astype(np.int32) for r in heads]) if heads else np.zeros(0, np.int32)
        self.y, self.part = gather("y") - 1, gather("part")
        self.n = self.y.size
        self.trained = (self.part == 0) & (self.y >= 0)
        self.sizes = {r["bucket"]: r["n"] for r in self.table.where("bucket >= 0").select("bucket", "n").collect()}
        self.tasks = max(1, min(len(self.sizes), self.spark.sparkContext.defaultParallelism))
        self.n_first, self.n_terms = n_first, sum(self.sizes.values())
        self.length = np.ones(self.n)
        squares = self.over(_squares, {}, 1)[0]
        self.length = np.sqrt(np.where(squares > 0, squares, 1.0))

    def over(self, work: Callable, given: dict, wide: int) -> np.ndarray:
        """The sum over all chunks of work(chunk, given, total), which adds to total: wide by rows, float64."""
        n = self.n

        def add(source: Iterator[dict], given: dict) -> Iterator[pa.RecordBatch]:
            total = np.zeros((wide, n))
            for chunk in source:
                work(chunk, given, total)
            flat = total.astype(np.float32).ravel()
            for low in range(0, flat.size, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([flat[low : low + BLOCK].tobytes()], pa.binary())], names=["low", "data"])

        out = np.zeros(wide * n)
        for batch in self.read(add, given, "low bigint, data binary").to_batches():
            for low, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), np.float32)
                out[low : low + x.size] += x
        return out.reshape(wide, n)

    def read(self, work: Callable, given: dict, schema: str) -> pa.Table:
        """What work(chunks, given) yields of each task, which takes its chunks one after the other."""
        sent = self.spark.sparkContext.broadcast(given | {"inverse": 1 / self.length, "trained": self.trained, "n_first": self.n_first})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = sent.value
            yield from work((_chunk(b.slice(i, 1), given) for b in batches for i in range(b.num_rows)), given)

        found = self.table.where("bucket >= 0").select("bucket", "trained", "sizes", "rows", "tf").coalesce(self.tasks).mapInArrow(run, schema).toArrow()
        sent.destroy()
        return found

    def rows(self, part: int, schema: str, **found: np.ndarray) -> DataFrame:
        """(id, label and what is found) of a part's rows; id and label have their own names in the caller."""
        offsets, parts = self.offsets, self.part == part
        sent = self.spark.sparkContext.broadcast((parts, found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, found = sent.value
            for b in batches:
                for slot, n, keys in zip(*(b.column(c).to_pylist() for c in ("slot", "n", "keys"))):
                    here = slice(offsets[slot], offsets[slot] + n)
                    t = pa.ipc.open_stream(keys).read_all()
                    for name, x in found.items():
                        t = t.append_column(name, pa.array(x[here]))
                    yield from t.filter(pa.array(parts[here])).combine_chunks().to_batches()

        return self.heads.select("slot", "n", "keys").mapInArrow(run, f"id {self.kinds['id']}, label {self.kinds['label']}, {schema}")

    def guesses(self, part: int, codes: np.ndarray) -> DataFrame:
        """(row_id, label, predicted) of a part's rows."""
        names = F.array(*map(F.lit, self.labels)) if self.labels else F.array(F.lit(None).cast(self.kinds["label"]))
        out = self.rows(part, "code int", code=codes.astype(np.int32))
        return out.select(F.col("id").alias(self.row_id), "label", F.element_at(names, F.col("code") + 1).alias("predicted"))

    def drop(self) -> None:
        drop_materialised(self.table)


def _chunk(b: pa.RecordBatch, given: dict) -> dict:
    raw = lambda c: memoryview(b.column(c)[0].as_buffer())
    sizes, df = (_unpacked(raw(c)).astype(np.int64) for c in ("sizes", "trained"))
    idf, starts = np.log((given["n_first"] + 1) / (df + 1)), _starts(sizes)
    rows = np.cumsum(_unpacked(raw("rows")), dtype=np.intp)
    if rows.size:
        # each column counts from 0
        rows -= np.repeat(np.append(0, rows[starts[1:] - 1]), sizes)
    return {"bucket": b.column("bucket")[0].as_py(), "sizes": sizes, "starts": starts, "rows": rows, "tf": _unpacked(raw("tf")), "idf": idf}


def _values(c: dict, given: dict, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x) of the columns from low to high."""
    sizes = c["sizes"][low:high]
    begin = c["starts"][low] if low < c["starts"].size else 0
    here = slice(begin, begin + sizes.sum())
    rows = c["rows"][here]
    return rows, c["tf"][here] * np.repeat(c["idf"][low:high], sizes) * given["inverse"][rows]


def _squares(c: dict, given: dict, total: np.ndarray) -> None:
    rows, x = _values(c, given)
    total[0] += np.bincount(rows, x * x, total.shape[1])


def _scored(c: dict, given: dict, total: np.ndarray) -> None:
    """Adds each row's sum of x by the logarithm of what its labels' rows hold, and last its sum of x."""
    rows, x = _values(c, given)
    if not rows.size:
        return
    y, n = given["labels"][rows], total.shape[1]
    for i in range(total.shape[0] - 1):
        held = np.add.reduceat(np.where(y == i, x, 0.0), c["starts"])
        total[i] += np.bincount(rows, x * np.repeat(np.log(held + 1), c["sizes"]), n)
    total[-1] += np.bincount(rows, x, n)


def _images(c: dict, given: dict, total: np.ndarray) -> None:
    """Adds to every row its product with the gradients of r, in columns of mean 0 and deviation 1 over the rows that are fitted on."""
    rows, x = _values(c, given)
    if not rows.size:
        return
    starts, sizes, m, n = c["starts"], c["sizes"], max(1, given["trained"].sum()), total.shape[1]
    own = x * given["trained"][rows]
    mean = np.add.reduceat(own, starts) / m
    own *= x
    variance = (np.add.reduceat(own, starts) - m * mean * mean) / max(1, m - 1)
    scale = np.divide(1.0, variance, out=np.zeros_like(variance), where=variance > 1e-15)
    for i, r in enumerate(given["r"]):
        np.multiply(x, r[rows], out=own)
        q = (np.add.reduceat(own, starts) - mean * r.sum()) * scale
        np.multiply(x, np.repeat(q, sizes), out=own)
        total[i] += np.bincount(rows, own, n) - mean @ q


def hinge(y: np.ndarray, trained: np.ndarray) -> Callable:
    """The mean hinge loss of values z, one row of them, and its slope by z; y is 1 or -1."""
    m = max(1, trained.sum())

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        gap = np.where(trained, 1 - y * z[0], 0.0)
        return float(np.maximum(gap, 0).sum() / m), np.where(gap > 0, -y / m, 0.0)[None, :]

    return loss


def softmax(y: np.ndarray, trained: np.ndarray, labels: int) -> Callable:
    """The mean logarithmic loss of values z, labels by rows, and its slope by z."""
    m, own = max(1, trained.sum()), np.flatnonzero(trained)
    mine = y[own]

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        p = z[:, own] - z[:, own].max(axis=0)
        total = np.log(np.exp(p).sum(axis=0))
        value = float((total - p[mine, np.arange(own.size)]).sum() / m)
        p = np.exp(p - total)
        p[mine, np.arange(own.size)] -= 1
        slope = np.zeros((labels, y.size))
        slope[:, own] = p / m
        return value, slope

    return loss


def descend(loss: Callable, z: np.ndarray, most: int, history: int = 10, tolerance: float = 1e-6) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """L-BFGS in the span of the gradients: yields slopes r by values, gets the values of the gradient of r on every row, returns the last values.

    A point is known by its values z; a direction by its coefficients of the gradients so far. Their inner
    products are slopes times values. Steps meet the Wolfe conditions by bisection and need no gradient. The
    gradients' values wait in a file of the driver.
    """
    value, r = loss(z)
    with tempfile.TemporaryFile() as file:
        held = np.memmap(file, np.float32, "w+", shape=(most + 1, *z.shape))
        inner, pairs = np.zeros((most + 1, most + 1)), []
        for k in range(most):
            held[k] = (yield r) + r.sum(axis=1, keepdims=True)  # with a constant
            for j in range(k + 1):
                inner[k, j] = inner[j, k] = float(np.vdot(r, held[j].astype(float)))
            own = np.eye(1, most + 1, k)[0]
            if pairs:
                pairs[-1] = (pairs[-1], own - np.eye(1, most + 1, k - 1)[0])
            if inner[k, k] <= 1e-24:
                break
            steps = [(s, g, s @ inner @ g) for s, g in pairs[-history:]]
            q, weights = own.copy(), []
            steps = [x for x in steps if x[2] > 0]
            for s, g, sg in reversed(steps):
                weights.append((s @ inner @ q) / sg)
                q -= weights[-1] * g
            if steps:
                s, g, sg = steps[-1]
                q *= sg / (g @ inner @ g)
            for (s, g, sg), w in zip(steps, reversed(weights)):
                q += (w - (g @ inner @ q) / sg) * s
            slope = -(own @ inner @ q)
            if slope >= 0:  # rounding; downhill instead
                q, slope = own, -inner[k, k]
            along = np.zeros(z.shape)
            for j in range(k + 1):
                along -= q[j] * held[j]
            low, high, step, best = 0.0, np.inf, 1.0 if k else 1 / np.sqrt(inner[k, k]), None
            for _ in range(30):
                new, slopes = loss(z + step * along)
                if new > value + 1e-4 * step * slope:
                    high = step
                else:
                    best = (step, new, slopes)
                    if np.vdot(slopes, along) >= 0.9 * slope:
                        break
                    low = step
                step = (low + high) / 2 if np.isfinite(high) else 2 * step
            if best is None:
                break
            step, new, r = best
            z = z + step * along
            pairs.append(-step * q)
            done = value - new <= tolerance * max(abs(value), 1e-6)
            value = new
            if done:
                break
        del held
    return z


def _together(columns: Columns, fits: list[Generator]) -> list[np.ndarray]:
    """The results of several descents, each step of all in one pass over the columns."""
    asked, out = {}, {}

    def go(i: int, image: np.ndarray | None) -> None:
        try:
            asked[i] = fits[i].send(image)
        except StopIteration as end:
            asked.pop(i, None)
            out[i] = end.value

    for i in range(len(fits)):
        go(i, None)
    while asked:
        r = np.concatenate([asked[i] for i in asked])
        images, low = columns.over(_images, {"r": r}, len(r)), 0
        for i in list(asked):
            wide = len(asked[i])
            go(i, images[low : low + wide])
            low += wide
    return [out[i] for i in range(len(fits))]


def _machines(columns: Columns, most: int = 20) -> list[Generator]:
    return [descend(hinge(np.where(columns.y == i, 1.0, -1.0), columns.trained), np.zeros((1, columns.n)), most) for i in range(len(columns.labels))]


def machine_values(columns: Columns) -> np.ndarray:
    """Labels by rows: by how much a linear machine of each label against the rest speaks for it."""
    return np.concatenate(_together(columns, _machines(columns))) if columns.labels else np.zeros((1, columns.n))


def lines(columns: Columns, models: Sequence[str]) -> dict[str, np.ndarray]:
    """Of svm and logistic, what is asked for: labels by rows, the higher the likelier. All are fitted in the same passes."""
    fits, wide = [], []
    for model in models:
        if model == "svm":
            own = _machines(columns)
        else:
            counts = np.bincount(columns.y[columns.trained], minlength=len(columns.labels)) + 0.0
            prior = np.log(np.maximum(counts, 1e-12) / counts.sum())
            own = [descend(softmax(columns.y, columns.trained, len(columns.labels)), np.repeat(prior[:, None], columns.n, axis=1), 30)]
        fits += own
        wide.append(len(own))
    found, out = _together(columns, fits), {}
    for model, n in zip(models, wide):
        out[model], found = np.concatenate(found[:n]), found[n:]
    return out


def bayes(columns: Columns) -> np.ndarray:
    """Labels by rows: scores of a multinomial Bayes model, counts smoothed by one, in one pass."""
    k = len(columns.labels)
    *scores, sums = columns.over(_scored, {"labels": np.where(columns.trained, columns.y, -1)}, k + 1)
    y = columns.y[columns.trained]
    counts, totals = np.bincount(y, minlength=k), np.bincount(y, sums[columns.trained], k)
    prior = np.log(counts + 1.0) - np.log(counts.sum() + k)
    return np.array(scores) + prior[:, None] - np.log(totals + columns.n_terms)[:, None] * sums if columns.n_terms else np.repeat(prior[:, None], columns.n, axis=1)


def _best_splits(source: Iterator[dict], given: dict) -> Iterator[pa.RecordBatch]:
    """Of each node the best split over its columns that a task holds, with the rows above it."""
    node, bag, labels, n_terms, best = given["node"], given["bag"], given["labels"], given["n_terms"], {}
    k = given["k"]
    for c in source:
        base, size = given["bases"][c["bucket"]], c["sizes"].size
        for t, nd, first, many, whole in given["nodes"]:
            # the window goes on at the first column after the last
            for begin in (first, first - n_terms):
                low, high = max(begin - base, 0), min(begin + many - base, size)
                if low >= high:
                    continue
                rows, x = _values(c, given, low, high)
                col = np.repeat(np.arange(low, high), c["sizes"][low:high])
                inside = node[t, rows] == nd
                mine = inside & (labels[rows] >= 0) & (bag[t, rows] > 0) & (x > 0)
                f, v, r = col[mine], x[mine], rows[mine]
                if not f.size:
                    continue
                order = np.lexsort((v, f))
                f, v, r = f[order], v[order], r[order]
                each = np.zeros((f.size, k))
                each[np.arange(f.size), labels[r]] = bag[t, r]
                summed = np.concatenate([np.zeros((1, k)), np.cumsum(each, axis=0)])
                fresh = np.append(True, f[1:] != f[:-1])
                under = np.where(fresh, 0.0, np.append(0.0, v[:-1]))
                end = np.searchsorted(f, f, side="right")
                above = summed[end] - summed[:-1]
                below = whole - above
                a, b = above.sum(axis=1), below.sum(axis=1)
                fits = (v > under) & (b > 0)
                gain = np.where(fits, (above**2).sum(axis=1) / a + (below**2).sum(axis=1) / np.where(b > 0, b, 1), -1.0)
                i = int(np.argmax(gain))
                found = (gain[i], -(base + int(f[i])))
                if fits[i] and found > best.get((t, nd), ((-1.0, 0), None))[0]:
                    best[t, nd] = found, rows[inside & (col == f[i]) & (x > (under[i] + v[i]) / 2)]
    for (t, nd), ((gain, at), above) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([nd], pa.int32()), pa.array([gain], pa.float64()), pa.array([-at], pa.int64()), pa.array([above.astype(np.int32).tobytes()], pa.binary())], names=["tree", "node", "gain", "at", "above"])


def forest(columns: Columns, trees: int = 30, depth: int = 5, seed: int = 7) -> np.ndarray:
    """Labels by rows: what the leaves of a forest say together.

    As the library's: rows drawn with replacement for each tree, at each node the root of the number of columns, the split of
    the least Gini impurity, leaves' shares added up. Columns lie in the order of their hashes; a node's are those that follow a
    place drawn for it. Every distance between two values is a split; the library tries 31 at most.
    """
    k, n, draw = len(columns.labels), columns.n, np.random.default_rng(seed)
    labels = np.where(columns.trained, columns.y, -1)
    own = np.flatnonzero(labels >= 0)
    bag = draw.poisson(1.0, (trees, n)).astype(np.uint8)
    node = np.zeros((trees, n), np.uint8)
    ended: set[tuple[int, int]] = set()
    bases = dict(zip(sorted(columns.sizes), _starts(np.array([columns.sizes[b] for b in sorted(columns.sizes)], np.int64)).tolist()))
    many = int(np.ceil(np.sqrt(columns.n_terms)))

    def totals(level: int) -> np.ndarray:
        return np.stack([np.bincount(node[t, own].astype(np.int64) * k + labels[own], bag[t, own], k << level).reshape(-1, k) for t in range(trees)])

    for level in range(depth):
        whole = totals(level)
        # a pure node has nothing to split
        nodes = [(t, nd, int(draw.integers(max(1, columns.n_terms))), many, whole[t, nd]) for t in range(trees) for nd in range(1 << level) if (t, nd) not in ended and (whole[t, nd] > 0).sum() > 1]
        best: dict = {}
        if nodes and columns.n_terms:
            found = columns.read(_best_splits, {"node": node, "bag": bag, "labels": labels, "n_terms": columns.n_terms, "nodes": nodes, "bases": bases, "k": k}, "tree int, node int, gain double, at bigint, above binary")
            for i, (t, nd, gain, at) in enumerate(zip(*(found.column(c).to_pylist() for c in ("tree", "node", "gain", "at")))):
                if (t, nd) not in best or (gain, -at) > best[t, nd][0]:
                    best[t, nd] = (gain, -at), i
            # a split that gains nothing isn't made
            best = {x: b for x, b in best.items() if b[0][0] > (whole[x] ** 2).sum() / whole[x].sum() + 1e-9}
        node *= 2
        for (t, _), (_, i) in best.items():
            node[t, np.frombuffer(found.column("above")[i].as_buffer(), np.int32)] += 1
        ended = {(t, 2 * nd) for t in range(trees) for nd in range(1 << level) if (t, nd) not in best}
    whole = totals(depth)
    shares = whole / np.maximum(whole.sum(axis=2, keepdims=True), 1)
    out = np.zeros((k, n))
    for t in range(trees):
        out += shares[t].T[:, node[t]]
    return out
