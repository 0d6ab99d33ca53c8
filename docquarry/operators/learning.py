"""Classification and clustering of documents on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import STOPWORDS, tokens
from docquarry.operators.components import connected_components
from docquarry.operators.tfidf import grams, term_counts
from docquarry.session import broadcast_if_small, forget_shuffles, materialise

#: Rows, or characters of text, that are worked on in one piece, with what is known of their terms.
SLOT_ROWS = 4096
SLOT_LETTERS = 16 << 20

MODELS = {
    "logistic": lambda: LogisticRegression(featuresCol="x", labelCol="y", maxIter=30),
    "svm": lambda: OneVsRest(classifier=LinearSVC(featuresCol="x", labelCol="y", maxIter=20), featuresCol="x", labelCol="y"),
    "bayes": lambda: NaiveBayes(featuresCol="x", labelCol="y"),
    "forest": lambda: RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=30, seed=7),
}


def character_grams(c, low: int = 3, high: int = 5):
    """Character n-grams of each word with a blank on both sides."""
    padded = F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def cut(w):
        parts = [F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i, n=n: F.substring(w, i, n)) for n in range(low, high + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(padded, cut))


def text_features(kind: str = "words", buckets: int = 1 << 14) -> Pipeline:
    """grams column to a vector x of length 1: all terms of at least two rows with weights, or terms hashed into buckets."""
    # vocabSize is only a ceiling; as many terms are held as pass minDF
    count = CountVectorizer(inputCol="grams", outputCol="tf", minDF=2, vocabSize=(1 << 31) - 1) if kind == "words" else HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets)
    return Pipeline(stages=[count, IDF(inputCol="tf", outputCol="w"), Normalizer(inputCol="w", outputCol="x")])


def classify(train: DataFrame, test: DataFrame, text: str, label: str, model: str = "logistic", row_id: str = "doc_id") -> DataFrame:
    """(row_id, label, predicted) of the test rows by words and word pairs; everything is fitted on the train rows."""
    if model == "bayes":
        return bayes_of_terms(train, test, text, label, row_id)
    rows = train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return classify_all(rows, "part", text, label, (model,), row_id)[model]


def classify_all(df: DataFrame, part: str, text: str, label: str, models: Sequence[str], row_id: str = "doc_id") -> dict[str, DataFrame]:
    """(row_id, label, predicted) of the rows of part 1 by each model of words and word pairs, fitted on part 0; the columns of grams are made once."""
    from docquarry.operators import columns as C

    held = C.Columns(df, part, text, label, row_id)
    if not held.labels:
        return {m: held.guesses(1, np.zeros(held.n)) for m in models}
    values = C.lines(held, [m for m in models if m in ("svm", "logistic")])
    values |= {m: {"bayes": C.bayes, "forest": C.forest}[m](held) for m in models if m not in values}
    return {m: held.guesses(1, np.argmax(values[m], axis=0)) for m in models}


def classify_features(train: DataFrame, test: DataFrame, label: str, model: str = "logistic", row_id: str = "doc_id") -> DataFrame:
    """(row_id, label, predicted) of the test rows by their vectors x; fitted on the train rows."""
    fitted = StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip").fit(train)
    guess = MODELS[model]().fit(fitted.transform(train)).transform(test)
    names = F.array(*map(F.lit, fitted.labels))
    return guess.select(row_id, F.col(label).alias("label"), F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot_grams(tokens: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count, keys): how often each gram stands in each row; gram counts from 0, keys has its 64-bit hash.

    Grams are those of operators.tfidf.grams: tokens without stop words, and pairs of neighbours.
    """
    lists = tokens.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary
    kept = pc.and_(pc.greater_equal(pc.utf8_length(names), 2), pc.invert(pc.is_in(names, value_set=pa.array(STOPWORDS, names.type)))).to_numpy(zero_copy_only=False)
    h = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(names) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    mine = kept[codes].astype(bool)
    at, one = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)[mine], h[codes[mine]]
    del lists, coded, codes, mine
    next_to = at[1:] == at[:-1]
    one = np.concatenate([one, _mixed(one[:-1][next_to] * np.uint64(3) + _mixed(one[1:][next_to] + np.uint64(1)))])
    both, keys = pd.factorize(one)
    del one
    n = max(1, keys.size)
    both += np.concatenate([at, at[1:][next_to]]).astype(np.int64) * n
    both.sort()
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if both.size else np.zeros(0, np.int64)
    return both[first] // n, both[first] % n, np.diff(np.append(first, both.size)), keys.view(np.int64)


def _slot_vectors(tokens: pa.ChunkedArray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, x): weighted counts of the grams that are known, each row of length 1; place is that in known, which is sorted."""
    at, gram, n, keys = _slot_grams(tokens)
    place = np.searchsorted(known, keys)
    there = place < known.size
    there[there] = known[place[there]] == keys[there]
    mine = there[gram]
    at, place, w = at[mine], place[gram[mine]], n[mine].astype(float)
    w *= idf[place]
    norm = np.sqrt(np.bincount(at, weights=w * w, minlength=1))[at]
    return at, place, np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)


def bayes_of_terms(train: DataFrame, test: DataFrame, text: str, label: str, row_id: str = "doc_id", slot_letters: int = SLOT_LETTERS) -> DataFrame:
    """(row_id, label, predicted) of the test rows by a multinomial Bayes model of words and word pairs fitted on the train rows.

    The same model as text_features with MODELS["bayes"]: grams of at least two train rows, inverse
    document frequencies, rows of length 1, counts smoothed by one, the more frequent label on ties.
    No vocabulary reaches the driver: rows fall into slots of about slot_letters characters; what is shuffled by
    grams are the grams of slots, and a slot's rows meet what is known of its grams in one place. Grams
    are named by 64-bit hashes: among 10 million any two are one with a chance of 3e-6. Labels are few.
    """
    spark = train.sparkSession
    letters = F.coalesce(F.sum(F.length(text)), F.lit(0))
    named = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"), letters.alias("letters")).collect()
    classes = sorted(((r["n"], r[label]) for r in named if r[label] is not None), key=lambda x: (-x[0], x[1]))
    n_train, labels = sum(r["n"] for r in named), [x for _, x in classes]

    def slots(df: DataFrame, held: int, *columns) -> DataFrame:
        parts = max(1, -(-held // slot_letters))
        cut = df.select(*columns, F.col(text).alias("text"), F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int").alias("slot")).repartition("slot")
        return cut.select(*[c for c in cut.columns if c != "text"], tokens(F.col("text")).alias("tokens"))

    def grams_of(own: pa.Table) -> pa.Table:
        _, gram, _, keys = _slot_grams(own.column("tokens"))
        return pa.table({"slot": pa.array(np.full(keys.size, own.column("slot")[0].as_py(), np.int32)), "key": keys, "df": np.bincount(gram, minlength=keys.size).astype(np.int64)})

    def known_of(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = held.column("key").to_numpy()
        order = np.argsort(key)
        df = held.column("df").to_numpy()[order]
        return order, key[order], np.log((n_train + 1) / (df + 1))

    def sums(own: pa.Table, held: pa.Table) -> pa.Table:
        order, known, idf = known_of(held)
        at, place, x = _slot_vectors(own.column("tokens"), known, idf)
        y = own.column("y").fill_null(-1).to_numpy()[at]
        each = {f"s_{i}": np.bincount(place[y == i], weights=x[y == i], minlength=known.size).astype(float) for i in range(len(labels))}
        return pa.table({"key": known, "df": held.column("df").to_numpy()[order], **each})

    y = (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("int") if labels else F.lit(None).cast("int")
    own = slots(train, sum(r["letters"] for r in named), y.alias("y"))
    grams = own.groupBy("slot").applyInArrow(grams_of, "slot int, key bigint, df bigint")
    held = grams.withColumn("df", F.sum("df").over(Window.partitionBy("key"))).where("df >= 2")
    columns = ", ".join(["key bigint", "df bigint", *(f"s_{i} double" for i in range(len(labels)))])
    summed = own.groupBy("slot").cogroup(held.groupBy("slot")).applyInArrow(sums, columns)
    model = materialise(summed.groupBy("key").agg(F.max("df").alias("df"), *(F.sum(f"s_{i}").alias(f"s_{i}") for i in range(len(labels)))), "model")
    forget_shuffles(spark)
    n_terms, *totals = model.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(f"s_{i}"), F.lit(0.0)) for i in range(len(labels)))).first()
    prior = np.log(np.array([n for n, _ in classes]) + 1.0) - np.log(sum(n for n, _ in classes) + len(labels))
    base = np.log(np.array(totals) + n_terms) if n_terms else np.zeros(len(labels))
    kinds = dict(test.select(F.col(row_id).alias("id"), F.col(label).alias("label")).dtypes)

    def guesses(own: pa.Table, held: pa.Table) -> pa.Table:
        order, known, idf = known_of(held)
        at, place, x = _slot_vectors(own.column("tokens"), known, idf)
        out = np.stack([prior[i] + np.bincount(at, weights=x * (np.log(held.column(f"s_{i}").to_numpy()[order] + 1) - base[i])[place], minlength=own.num_rows) for i in range(len(labels))], axis=1)
        return pa.table({"id": own.column("id"), "label": own.column("label"), "predicted": pa.array(np.argmax(out, axis=1).astype(np.int32))})

    asked = slots(test, test.agg(letters).first()[0], F.col(row_id).alias("id"), F.col(label).alias("label"))
    if not labels:
        return test.select(row_id, F.col(label).alias("label"), F.lit(None).cast(kinds["label"]).alias("predicted"))
    wanted = asked.groupBy("slot").applyInArrow(grams_of, "slot int, key bigint, df bigint").select("slot", "key").join(model, "key")
    found = asked.groupBy("slot").cogroup(wanted.groupBy("slot")).applyInArrow(guesses, f"id {kinds['id']}, label {kinds['label']}, predicted int")
    return found.select(F.col("id").alias(row_id), "label", F.element_at(F.array(*map(F.lit, labels)), F.col("predicted") + 1).alias("predicted"))


def grouped_folds(df: DataFrame, group: str, folds: int, seed: int = 7) -> DataFrame:
    """Adds fold, the same for all rows of a group: from the MD5 of seed and group, so that any engine folds alike."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group))), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (draw % folds).cast("int"))


def shared_groups(df: DataFrame, group: str) -> DataFrame:
    """(fold, groups, rows, leaked): of each fold its groups, its rows, and how many of its groups other folds hold too."""
    each = df.groupBy("fold", group).agg(F.count(F.lit(1)).alias("n"))
    spread = each.groupBy(group).agg(F.count(F.lit(1)).alias("folds"))
    return each.join(spread, group).groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("folds") > 1).alias("leaked"))


def leave_one_group_out(df: DataFrame, row_id: str, text: str, label: str, group: str, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(row_id, group, label, predicted): each row by a multinomial Bayes model of all groups but its own, on single words.

    Counts are additive: the model without a group is the whole model's counts less the group's, so all
    models come from one aggregation and nothing is fitted again. Smoothing adds one to each count; a
    label that only the own group has isn't predicted; ties go to the first label. Labels are few.

    Rows fall into slots, parts of a group of about slot_rows rows. What is shuffled by terms are the
    terms of slots, not of rows; a slot's rows then meet what each term gains each label in one place.
    A term that only one group holds gains nothing for any label of that group and is left out.
    """
    base = df.select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(group).alias("group"), F.col(text).alias("text"))
    sizes = materialise(base.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / slot_rows).alias("slots")), "sizes")
    slotted = base.join(broadcast_if_small(sizes, sizes.count(), 128), "group").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    counted = slotted.select("id", "label", "group", "slot", term_counts(F.col("text"), 1).alias("c"))
    rows = materialise(counted.select("id", "label", "group", "slot", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs")), "rows")
    words = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    held = materialise(rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("docs"), F.sum(words).alias("words")), "held")
    labels = sorted(r[0] for r in held.select("label").where("label is not null").distinct().collect())
    posts = rows.select("group", "slot", "label", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("c")).select("group", "slot", "label", "c.term", "c.tf")
    n_terms = posts.select(F.count_distinct("term")).scalar()

    # what is left of each label without each group
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = lambda of: [zero(F.sum(F.when(F.col("label") == x, F.col(of)))).alias(f"{of}_{i}") for i, x in enumerate(labels)]
    whole = held.agg(*(c.alias(f"all_{of}_{i}") for of in ("docs", "words") for i, c in enumerate(each(of))))
    left = held.groupBy("group").agg(*each("docs"), *each("words")).join(F.broadcast(whole), F.lit(True), "cross")
    less = lambda of, i: F.col(f"all_{of}_{i}") - F.col(f"{of}_{i}")
    left = left.select("group", F.array(*(F.struct(F.lit(x).alias("label"), less("docs", i).alias("docs"), (less("words", i) + n_terms).alias("total")) for i, x in enumerate(labels))).alias("left"))

    # terms of a slot with what each gains each label
    counts = posts.groupBy("group", "slot", "term").agg(*each("tf"))
    by_term, by_group = Window.partitionBy("term"), Window.partitionBy("term", "group")
    over = [F.sum(f"tf_{i}").over(w).alias(f"{n}_{i}") for n, w in (("all", by_term), ("own", by_group)) for i in range(len(labels))]
    gains = counts.select("group", "slot", "term", *over, F.min("group").over(by_term).alias("low"), F.max("group").over(by_term).alias("high")).where("low <> high")
    gains = gains.select("group", "slot", "term", *(F.log(F.col(f"all_{i}") - F.col(f"own_{i}") + 1).alias(f"gain_{i}") for i in range(len(labels))))

    def run(own: pa.Table, gained: pa.Table) -> pa.Table:
        lists = own.column("terms").combine_chunks()
        tf = own.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        at = pc.index_in(lists.flatten(), value_set=gained.column("term").combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
        table = np.zeros((gained.num_rows + 1, len(labels)))
        for i in range(len(labels)):
            table[:-1, i] = gained.column(f"gain_{i}").to_numpy()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        out = np.zeros((own.num_rows, len(labels)))
        some = np.flatnonzero(sizes)
        if some.size:
            out[some] = np.add.reduceat(tf[:, None] * table[at], np.append(0, np.cumsum(sizes[some]))[:-1].astype(np.int64), axis=0)
        offsets = np.arange(own.num_rows + 1, dtype=np.int32) * len(labels)
        total = np.bincount(np.repeat(np.arange(own.num_rows), sizes), weights=tf, minlength=own.num_rows)
        return pa.table({"id": own.column("id"), "group": own.column("group"), "truth": own.column("truth"), "words": pa.array(total.astype(float)), "s": pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))})

    kinds = dict(base.dtypes)
    own = rows.withColumnRenamed("label", "truth").groupBy("group", "slot")
    found = own.cogroup(gains.groupBy("group", "slot")).applyInArrow(run, f"id {kinds['id']}, `group` {kinds['group']}, truth {kinds['label']}, words double, s array<double>")
    scored = found.join(broadcast_if_small(left, sizes.count(), 128 + 96 * len(labels)), "group")
    score = lambda x, s: F.log(x["docs"]) + s - F.col("words") * F.log(x["total"])
    ranked = F.zip_with("left", "s", lambda x, s: F.when(x["docs"] > 0, F.struct((-F.round(score(x, s), 6)).alias("score"), x["label"].alias("label"))))
    best = F.array_min(F.filter(ranked, lambda x: x.isNotNull()))["label"]
    return scored.select(F.col("id").alias(row_id), "group", F.col("truth").alias("label"), best.alias("predicted"))


def _sparse(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, x) of the vectors x of a batch, all of which are sparse."""
    x = b.column("x")
    places, values = x.field("indices"), x.field("values")
    row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))
    return row, places.flatten().to_numpy(), values.flatten().to_numpy()


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows, the sums of the rows of each number; numbers ascend."""
    out = np.zeros((n, rows.shape[1]), np.float64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if at.size else at
    if at.size:
        out[at[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _right_vectors(df: DataFrame, width: int, k: int, block: int = 64, passes: int = 16, tolerance: float = 1e-5) -> np.ndarray:
    """The k leading right singular vectors of the rows x, as columns, from a Krylov space of blocks: width by block is all that a task sends.

    The library would hold all inner products of columns in every task and in the driver. Each pass multiplies a block by
    the rows and their transpose; it ends when a pass changes none of the k values by more than tolerance of itself.
    """
    spark = df.sparkSession
    rows = df.select("x").coalesce(spark.sparkContext.defaultParallelism)

    def product(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q.astype(np.float32))

        def run(batches):
            asked = sent.value
            z = np.zeros((width, asked.shape[1]))
            for whole in batches:
                for low in range(0, whole.num_rows, 2048):
                    row, place, x = _sparse(whole.slice(low, 2048))
                    x = x.astype(np.float32)[:, None]
                    y = _summed(row, asked[place] * x, min(2048, whole.num_rows - low)).astype(np.float32)
                    order = np.argsort(place, kind="stable")
                    z += _summed(place[order], (y[row] * x)[order], width)
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["z"])

        found = rows.mapInArrow(run, "z binary").toArrow().column("z")
        sent.destroy()
        return sum((np.frombuffer(z.as_buffer()).reshape(q.shape) for z in found), np.zeros(q.shape))

    q = np.linalg.qr(np.random.default_rng(7).normal(size=(width, min(block, width))))[0]
    basis, images, last, v = np.zeros((width, 0)), np.zeros((width, 0)), None, q[:, :k]
    for _ in range(passes):
        z = product(q)
        basis, images = np.concatenate([basis, q], axis=1), np.concatenate([images, z], axis=1)
        inner = basis.T @ images
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, v = values[::-1][:k], basis @ vectors[:, ::-1][:, :k]
        if last is not None and np.all(np.abs(values - last) <= tolerance * np.maximum(values, 1e-12 * max(values[0], 1e-300))) or basis.shape[1] + q.shape[1] > width:
            break
        last = values
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        q = np.linalg.qr(z)[0]
        q -= basis @ (basis.T @ q)
        q = np.linalg.qr(q)[0]
    return v


def lsa(train: DataFrame, *others: DataFrame, text: str, components: int = 50, buckets: int = 1 << 13) -> list[DataFrame]:
    """train and others without their text, with latent, vectors of length 1: hashed weighted terms on the leading right singular vectors of train.

    The vectors that reach the driver are buckets by a few hundred, whatever the number of rows.
    """
    named = [d.withColumn("grams", grams(F.col(text), 1)) for d in (train, *others)]
    features = text_features("hashed", buckets).fit(named[0])
    weighed = [materialise(features.transform(d).drop(text, "grams", "tf", "w"), "weighed") for d in named]
    v = _right_vectors(weighed[0], buckets, min(components, buckets)).astype(np.float32)

    def project(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                b = whole.slice(low, 2048)
                row, place, x = _sparse(b)
                out = _summed(row, v[place] * x.astype(np.float32)[:, None], b.num_rows)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out /= np.where(norm > 0, norm, 1)
                latent = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))
                t = pa.Table.from_batches([b]).drop_columns(["x"]).append_column("latent", latent)
                yield from t.combine_chunks().to_batches()

    def latent(d: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in d.drop("x").dtypes) + ", latent array<double>"
        return d.mapInArrow(project, schema)

    return [latent(d) for d in weighed]


def mini_batch_k_means(df: DataFrame, row_id: str, vector: str, k: int, batch: int = 1024, rounds: int = 60, seed: int = 7) -> DataFrame:
    """(row_id, cluster) of every row: centres move towards batches of rows, each by one over the rows it has won so far.

    Batches are drawn by hash, of about batch rows each, and are all that reaches the driver; they fit the
    centres only: every row is assigned. Null vectors are left out.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    parts = max(1, -(-rows.count() // batch))
    take = lambda i: np.array([x["v"] for x in rows.where(F.pmod(F.xxhash64(F.lit(seed + i), "row_id"), F.lit(parts)) == 0).orderBy(F.xxhash64(F.lit(seed), "row_id")).limit(2 * batch).collect()])
    draw = np.random.default_rng(seed)
    first = take(0)
    if not len(first):
        return rows.select("row_id", F.lit(0).alias("cluster"))
    centres = [first[0]]
    while len(centres) < min(k, len(first)):
        far = np.min([((first - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(first[draw.choice(len(first), p=far / far.sum()) if far.sum() > 0 else 0])
    m, won = np.array(centres), np.zeros(len(centres))
    distinct = min(rounds, parts)
    batches = [first] + [take(i) for i in range(1, distinct)]
    for i in range(rounds):
        b = batches[i % distinct]
        if not len(b):
            continue
        at = np.argmin(((b[:, None, :] - m[None, :, :]) ** 2).sum(axis=2), axis=1)
        for c in np.unique(at):
            mine = b[at == c]
            won[c] += len(mine)
            m[c] += (mine.mean(axis=0) - m[c]) * len(mine) / won[c]

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v) if len(v) else np.zeros((0, m.shape[1]))
        return pd.Series(np.argmin((m**2).sum(axis=1)[None, :] - 2 * x @ m.T, axis=1).astype(np.int32))

    return rows.select("row_id", nearest("v").alias("cluster"))


def platt(margins: DataFrame, margin: str, correct: str):
    """A fitted logistic curve from margin to the chance of being right; its transform adds confidence."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=[margin], outputCol="_m")
    model = LogisticRegression(featuresCol="_m", labelCol="_y", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q").fit(ready.transform(margins.withColumn("_y", F.col(correct).cast("double"))))
    return lambda d: model.transform(ready.transform(d)).withColumn("confidence", vector_to_array("_q")[1]).drop("_m", "_r", "_q", "_p")


def margins(df: DataFrame, part: str, tests: int, text: str, label: str, row_id: str = "doc_id") -> list[DataFrame]:
    """Parts 1 to tests with margin and ok: by how much a linear machine fitted on part 0 has its best class lead the second, and whether it is right. Labels that part 0 lacks are left out."""
    from docquarry.operators.columns import Columns, machine_values

    columns = Columns(df.where(F.col(label).isNotNull()), part, text, label, row_id)
    values = machine_values(columns)
    ordered = np.sort(values, axis=0)
    lead = ordered[-1] - (ordered[-2] if len(ordered) > 1 else 0.0)
    found = {"y": columns.y.astype(float), "margin": lead, "ok": np.argmax(values, axis=0) == columns.y}
    return [columns.rows(i, "y double, margin double, ok boolean", **found).where("y >= 0").select("y", "margin", "ok") for i in range(1, tests + 1)]


def nearest_labels(neighbours: DataFrame, labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """(row_id, predicted): the label most of a row's neighbours have, the higher cosine sum and then the alphabet on ties."""
    named = neighbours.join(labels.select(F.col(row_id).alias("neighbour"), F.col(label).alias("predicted")), "neighbour")
    votes = named.where("predicted is not null").groupBy(row_id, "predicted").agg(F.count(F.lit(1)).alias("n"), F.sum("cosine").alias("s"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("n"), F.desc("s"), "predicted"))).where("r = 1").select(row_id, "predicted")


def as_features(df: DataFrame, vector: str) -> DataFrame:
    """Array of floats to an MLlib vector x of length 1."""
    return Normalizer(inputCol="_v", outputCol="x").transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))).drop("_v")


def principal_components(df: DataFrame, share: float = 0.9) -> tuple[DataFrame, int]:
    """Replaces x by its leading components, as many as hold the share of variance; also their number. All rows have one dimension; an empty table is an error."""
    first = df.select("x").first()
    if first is None:
        raise ValueError("no rows to find components of")
    width = first["x"].size
    model = PCA(k=width, inputCol="x", outputCol="pc").fit(df)
    # rounding may leave the sum of all a little under 1
    kept = min(int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share) + 1), width)
    short = PCA(k=kept, inputCol="x", outputCol="pc").fit(df)
    return short.transform(df).drop("x").withColumnRenamed("pc", "x"), kept


def k_means(df: DataFrame, k: int, seed: int = 7, mode: str = "k-means||") -> tuple[DataFrame, float, float]:
    """Rows with cluster, the inertia, and the cosine silhouette."""
    model = KMeans(k=k, seed=seed, initMode=mode, featuresCol="x", predictionCol="cluster", maxIter=30).fit(df)
    out = model.transform(df)
    silhouette = ClusteringEvaluator(featuresCol="x", predictionCol="cluster", distanceMeasure="cosine").evaluate(out)
    return out, float(model.summary.trainingCost), float(silhouette)


def sweep(df: DataFrame, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """(k, inertia, silhouette) of each number of clusters."""
    rows = []
    for k in ks:
        _, inertia, silhouette = k_means(df, k, seed)
        rows.append((k, inertia, silhouette))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def radius_pairs(df: DataFrame, row_id: str, vector: str, radius: float, block: int = 4096) -> DataFrame:
    """(a, b), a < b: all pairs within a cosine distance, exactly.

    Rows fall into blocks by hash, and each task compares two blocks as one matrix product: the work is
    quadratic, its memory isn't. Vectors must be of one dimension and not zero.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    posts = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posts = posts.select("id", "v", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, m = part["id"].to_numpy(), np.stack(part["v"])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        left = np.flatnonzero(part["own"].to_numpy() == key[0])
        right = np.flatnonzero(part["own"].to_numpy() == key[1])
        found = []
        for low in range(0, left.size, 1024):
            i, j = np.nonzero(1 - m[left[low : low + 1024]] @ m[right].T <= radius)
            found.append(np.stack([ids[left[i + low]], ids[right[j]]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        keep = a < b if key[0] == key[1] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return posts.groupBy("x", "y").applyInPandas(run, "a bigint, b bigint")


def dbscan(links: DataFrame, nodes: DataFrame, a: str, b: str, node: str, least: int = 5) -> DataFrame:
    """(node, cluster): links join nodes within the radius, each once; a node is core with least others and itself; noise has -1.

    Clusters are the connected components of core nodes; a border node goes to its least core's cluster.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
    core = both.groupBy("u").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= least).select("u")
    inner = both.join(core, "u", "left_semi").join(core.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    alone = core.select("u", F.col("u").alias("v"))
    components = connected_components(inner.unionByName(alone), "u", "v")
    border = both.join(core, "u", "left_anti").join(core.select(F.col("u").alias("v")), "v", "left_semi").groupBy("u").agg(F.min("v").alias("v"))
    reached = border.join(components, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "component")
    every = components.unionByName(reached).select(F.col("node").alias(node), F.col("component").alias("cluster"))
    return nodes.select(node).join(every, node, "left").select(node, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def agglomerate(vectors: np.ndarray, k: int, linkage: str = "average") -> np.ndarray:
    """Bottom-up clusters of one bounded group, by single, complete, average or Ward linkage (Lance-Williams updates)."""
    n = len(vectors)
    d = np.linalg.norm(vectors[:, None, :] - vectors[None, :, :], axis=2)
    if linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(n), np.arange(n)
    for _ in range(n - k):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if linkage == "single":
            row = np.minimum(d[i], d[j])
        elif linkage == "complete":
            row = np.maximum(d[i], d[j])
        elif linkage == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        d[i], d[:, i] = row, row
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i
    return np.unique(owner, return_inverse=True)[1]


def agglomerate_groups(df: DataFrame, group: str, row_id: str, vector: str, k: int, linkage: str = "average", most: int = 2000) -> DataFrame:
    """(group, row_id, cluster) per group of at most most rows; a larger group is an error, as the method is quadratic."""
    kinds = {c: df.select(F.col(c).alias("x")).dtypes[0][1] for c in (group, row_id)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"a group of {len(rows)} rows; at most {most} can be clustered")
        return pd.DataFrame({"group": rows["g"], "row_id": rows["r"], "cluster": agglomerate(np.stack(rows["v"]).astype(float), min(k, len(rows)), linkage)})

    named = df.select(F.col(group).alias("g"), F.col(row_id).alias("r"), F.col(vector).alias("v"))
    return named.groupBy("g").applyInPandas(run, f"group {kinds[group]}, row_id {kinds[row_id]}, cluster int")
