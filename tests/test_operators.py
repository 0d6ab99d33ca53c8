"""Operators against brute force and hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.operators import edits, evaluation, graphs, learning, quality, randomised, strings
from docquarry.operators.components import connected_components
from docquarry.operators.orphans import orphan_references, orphan_report
from docquarry.operators.vocabulary import correct_query, vocabulary
from docquarry.plans import textquery
from docquarry.plans.search import SearchSpec, merge_ranges, search, snippet_of

rng = random.Random(11)
short = st.text("abc", max_size=9)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


# strings


@given(short, short)
def test_matchers_agree(text, pattern):
    want = [i for i in range(len(text) - len(pattern) + 1) if pattern and text.startswith(pattern, i)]
    if pattern:
        joined = pattern + "\0" + text
        m = len(pattern)
        assert [i - 2 * m for i, k in enumerate(strings.prefix_function(joined)) if k == m and i > m] == want
        assert [i - m - 1 for i, k in enumerate(strings.z_function(joined)) if k == m and i > m] == want
        assert [s for _, s, _ in strings.Automaton([pattern]).find(text)] == want


@given(st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=5), st.text("ab", max_size=20))
def test_automaton_finds_all_in_order(patterns, text):
    got = list(strings.Automaton(patterns).find(text))
    want = [(k, i, i + len(p)) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i)]
    assert got == sorted(want, key=lambda m: (m[2], m[1] - m[2], m[0]))


@given(st.text("abé", max_size=25))
def test_suffix_arrays(text):
    order = strings.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for k, n in enumerate(strings.common_prefixes(text, order)):
        a, b = (text[order[k - 1] :], text[order[k] :]) if k else ("", "")
        assert n == len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False))))
    repeats = [text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text.find(text[i:j], i + 1) >= 0]
    assert len(strings.longest_repeat(text)) == max(map(len, repeats), default=0)


def test_occurrences_frame(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("a", "abc"), (None, "a")], "t string, p string")
    assert [r[0] for r in df.select(strings.occurrences(F.col("t"), F.col("p"))).collect()] == [[0, 1, 2], [], [], None]
    assert df.select(strings.occurrence_count(F.col("t"), "aa")).first()[0] == 3
    assert {tuple(r) for r in strings.pattern_matches(df, "t", "t", ["a", "aa"]).where("row_id = 'aaaa' and start = 2").collect()} == {("aaaa", 0, 2, 3), ("aaaa", 1, 2, 4)}


# edits


@given(short, short)
def test_distances_are_ordered(a, b):
    free, tied, plain = edits.swaps_any(a, b), edits.swaps_adjacent(a, b), lev(a, b)
    assert free <= tied <= plain <= 2 * free
    assert tied == edits.swaps_adjacent(b, a) and free == edits.swaps_any(b, a)


def test_known_distances(spark):
    assert (edits.swaps_any("CA", "ABC"), edits.swaps_adjacent("CA", "ABC")) == (2, 3)
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), (None, "a")], "a string, b string")
    got = df.select(edits.similarity(F.col("a"), F.col("b")), edits.osa_distance(F.col("a"), F.col("b")), edits.damerau_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(1 - 3 / 7) and tuple(got[0][1:]) == (3, 3) and tuple(got[1]) == (1.0, 0, 0) and got[2][1] is None
    r = df.select(edits.global_alignment(F.lit("GATT"), F.lit("GCT")).alias("g"), edits.local_alignment(F.lit("xxabc"), F.lit("abcyy")).alias("l"), edits.local_alignment(F.lit("a"), F.lit("b")).alias("n")).first()
    assert r["g"]["score"] == 1 - 1 + 1 - 2 + 0 or r["g"]["score"] == -1
    assert (r["l"]["a"], r["l"]["score"], r["l"]["start_a"], r["l"]["start_b"]) == ("abc", 6, 2, 0)
    assert (r["n"]["a"], r["n"]["score"]) == ("", 0)


# graphs


def test_flow_equals_cut_and_matching_equals_flow():
    for _ in range(60):
        n = rng.randrange(2, 7)
        es = [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 9)) for _ in range(rng.randrange(0, 16))]
        net = graphs.Flow()
        for e in es:
            net.add(*e)
        value = net.max_flow(0, n - 1)
        cuts = [sum(c for u, v, c in es if u in s and v not in s) for k in range(n) for extra in itertools.combinations(range(1, n - 1), k) for s in [{0, *extra}]]
        side = net.source_side(0)
        assert value == min(cuts) == sum(c for u, v, c in es if u in side and v not in side)
        pairs = [(f"l{rng.randrange(5)}", f"r{rng.randrange(5)}") for _ in range(rng.randrange(0, 12))]
        flow = graphs.Flow()
        for a in {p[0] for p in pairs}:
            flow.add("s", a, 1)
        for b in {p[1] for p in pairs}:
            flow.add(b, "t", 1)
        for a, b in set(pairs):
            flow.add(a, b, 1)
        held = graphs.matching(pairs)
        assert len(held) == flow.max_flow("s", "t") and len(set(held.values())) == len(held) and all((a, b) in pairs for b, a in held.items())
    assert graphs.Flow().max_flow(1, 1) == 0


def test_covers_and_schedules():
    for _ in range(40):
        es = [tuple(rng.sample(range(8), 2)) for _ in range(rng.randrange(0, 12))]
        near, best = graphs.vertex_cover(es), graphs.least_cover(es)
        assert all(set(e) & near and set(e) & best for e in es) and len(best) <= len(near) <= 2 * len(best)
        jobs = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]
        bound = max(max(jobs), -(-sum(jobs) // 3))
        assert bound <= graphs.schedule(jobs, 3, True) <= 2 * bound and bound <= graphs.schedule(jobs, 3) <= 2 * bound
    with pytest.raises(ValueError):
        graphs.least_cover([(i, i + 1) for i in range(30)])


def test_components_against_union_find(spark):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (999, 999), (None, 3), (5, 5), (5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in list(parent)} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


# problem 3


def test_orphans(spark):
    parents = spark.createDataFrame([(1, "2024-01-10", None), (2, "2024-01-10", "2024-02-01"), (3, None, None), (4, "2024-01-10", None), (4, "2024-01-01", None), (None, "2024-01-01", None)], "k bigint, born string, gone string").withColumn("may", F.lit(1))
    refs = [(10, 1, "2024-01-10"), (11, 1, "2024-01-09"), (12, 1, None), (13, 2, "2024-01-20"), (14, 3, "2020-01-01"), (15, 99, "2024-01-01"), (16, None, "2024-01-01"), (17, 4, "2024-01-05"), (15, 99, "2024-01-01")]
    df = spark.createDataFrame(refs, "id int, ref int, at string").withColumn("words", F.lit(1)).withColumn("k", F.lit(2))
    got = orphan_references(df, "ref", "at", "id", parents, "k", "born", "gone")
    assert sorted((r["row_id"], r["reason"]) for r in got.collect()) == [(11, "later"), (13, "absent"), (15, "absent"), (15, "absent")]
    report = orphan_report(got.withColumn("ref_table", F.lit("t")).withColumn("at", F.col("at").cast("timestamp"))).collect()
    assert sum(r["n_orphans"] for r in report) == 4
    assert orphan_references(df.limit(0), "ref", "at", "id", parents, "k", "born", "gone").count() == 0
    assert orphan_references(df, "ref", "at", "id", parents.limit(0), "k", "born", "gone").count() == 8
    # a filter far too small proves nothing, and nothing changes
    assert sorted(r["row_id"] for r in orphan_references(df, "ref", "at", "id", parents, "k", "born", "gone", max_bits=64).collect()) == [11, 13, 15, 15]


def test_orphans_of_a_hot_key(spark):
    from docquarry.session import lookup_salted

    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("row"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), F.lit(True).alias("found")).unionByName(spark.range(1, 2).select(F.col("id").alias("k"), F.lit(True).alias("found")))
    plain = left.join(right, "k", "left")
    salted = lookup_salted(left, right, "k", F.col("row"), hot_rows=500, salts=4)
    key = lambda d: sorted(tuple(map(str, r)) for r in d.select("k", "row", "found").collect())
    assert key(salted) == key(plain)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "z")], "id int, v string")
    assert [tuple(r) for r in quality.unique_violations(df, "id", "v").collect()] == [(1, "a", 2)]
    assert [r["id"] for r in quality.domain_violations(df, "v", ["a"]).collect()] == [3]
    assert [tuple(r) for r in quality.null_violations(df, "id", "v").collect()] == [(2, "v")]
    assert [r["id"] for r in quality.missing_parents(df, "id", df.where("id < 3"), "id").collect()] == [3]


# randomised


def test_primes_and_generator():
    sieve = [n for n in range(2, 3000) if all(n % d for d in range(2, int(n**0.5) + 1))]
    assert [n for n in range(3000) if randomised.prime(n)] == sieve
    assert randomised.prime(2**61 - 1) and not randomised.prime((2**31 - 1) * (2**29 - 3))
    with pytest.raises(ValueError):
        randomised.prime(-1)
    assert randomised.probably_prime(7919, 10, 1) and not randomised.probably_prime(7917, 10, 1)
    draw = randomised.SplitMix(0)
    assert draw.next() == 0xE220A8397B1DCDAF
    values = np.array([randomised.SplitMix(s).below(10) for s in range(5000)])
    assert randomised.spread(values, 10) < 30


def test_samples(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    assert randomised.uniform_sample(df, 20, "v", 3).collect() == randomised.uniform_sample(df, 20, "v", 3).collect()
    got = randomised.reservoir(df, "g", "v", 7, 1).collect()
    assert len(got) == 14 and all(r["v"] % 2 == r["g"] for r in got)


# language


@pytest.mark.parametrize("text,kind,terms", [('find "a b"', "find", ("a b",)), ('FINDALL a "" c', "findall", ("a", "", "c")), ('fuzzy "x y" ~3', "fuzzy", ("x y",)), ("similar a b", "similar", ("a", "b")), ("prime 7", "prime", ())])
def test_parse(text, kind, terms):
    q = textquery.parse(text)
    assert (q.kind, q.terms) == (kind, terms)
    assert q.threshold == (3 if kind == "fuzzy" else 0)


@pytest.mark.parametrize("text,part", [(None, "null"), ("  ", "empty"), ("find", "exactly one"), ("find a b", "got 2"), ("findall", "at least one"), ("fuzzy a ~x", "malformed"), ("fuzzy a ~-1", "negative"), ("similar a", "exactly two"), ("prime x", "integer"), ("go", "unknown command"), ('find "a', "unterminated"), ('find a"b', "unexpected quote")])
def test_parse_errors(text, part):
    with pytest.raises(ValueError, match=part):
        textquery.parse(text)


def test_run_language(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "bandana"), (3, None)], "id int, t string")
    run = lambda q: [tuple(r) for r in textquery.run(q, df, "id", "t").collect()]
    assert run("find ana") == [(1, 2), (2, 1)]
    assert (2, "x", 0) in run("findall ana x")
    assert run("fuzzy banana ~1") == [(1, 0), (2, 1)]
    assert run("prime 97") == [(97, True)]
    assert run("similar ab ba")[0][2:6] == (2, 1, 1, 0.0)


# evaluation and learning


def test_metrics_by_hand(spark):
    rels = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "query_id int, doc_id int")
    run = spark.createDataFrame([(1, 11, 2), (1, 99, 1), (2, 20, 1), (4, 1, 1)], "query_id int, doc_id int, rank int")
    m = {r["query_id"]: r for r in evaluation.query_metrics(run, rels).collect()}
    assert (m[1]["rr"], m[1]["recall_1"], m[1]["recall_3"]) == (0.5, 0.0, 0.5)
    assert m[1]["ndcg_3"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert (m[2]["rr"], m[3]["rr"], m[3]["ndcg_10"]) == (1.0, 0.0, 0.0) and 4 not in m
    assert evaluation.mean_metrics(evaluation.query_metrics(run, rels)).first()["rr"] == 0.5


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, 0.1 + 0.01 * (i % 5)) for i in range(40)] + [(99, 0.0)], "q int, d double")
    r = evaluation.paired_bootstrap(df, "q", "d", 400).first()
    assert r["low"] < r["mean"] < r["high"] and (r["wins"], r["losses"], r["ties"]) == (40, 0, 1) and r["p"] < 0.05


def test_agreement_and_knee(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b")], "c int, l string")
    assert [round(x, 9) for x in evaluation.cluster_agreement(df, "c", "l").first()] == [1, 1, 1, 1]
    curve = spark.createDataFrame([(1, 100.0), (2, 40.0), (3, 12.0), (4, 9.0), (5, 7.0), (6, 5.0)], "k int, v double")
    assert evaluation.knee(curve, "k", "v").first()["k"] == 3


def test_dbscan_and_radius_pairs(spark):
    points = [(i, [np.cos(a), np.sin(a)]) for i, a in enumerate([0, 0.01, 0.02, 1, 1.01, 1.02, 2.5])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points], "id bigint, v array<double>")
    near = learning.radius_pairs(df, "id", "v", 0.001, block=3)
    assert {tuple(r) for r in near.collect()} == {(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)}
    got = {r["id"]: r["cluster"] for r in learning.dbscan(near, df, "a", "b", "id", 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}
    assert sorted(learning.agglomerate(np.array([[0.0], [0.1], [5.0], [5.1]]), 2, "ward").tolist()) == [0, 0, 1, 1]


def test_text_features_hold_every_term_of_two_rows(spark):
    terms = [f"t{i}" for i in range((1 << 14) + 100)]
    df = spark.createDataFrame([(terms,), (terms,), (["once"],)], "grams array<string>")
    fitted = learning.text_features().fit(df)
    assert sorted(fitted.stages[0].vocabulary) == sorted(terms)


def test_classify_uses_word_pairs(spark):
    # the same words in both labels; only their order differs
    rows = [(i, *(("alpha beta", "x") if i % 2 else ("beta alpha", "y"))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    assert all(r["label"] == r["predicted"] for r in learning.classify(df, df, "text", "label", "bayes").collect())


def test_bayes_without_a_vocabulary_is_that_of_the_library(spark):
    from docquarry.operators.tfidf import grams

    draw = random.Random(11)
    words = "The and alpha beta gamma delta épsilon zeta-eta x 7 42".split()
    rows = [(i, None if i == 3 else "" if i == 4 else " ".join(draw.choices(words, weights=[1 + (k + i) % 3 for k in range(len(words))], k=draw.randrange(1, 12))), None if i == 5 else "pqr"[i % 3]) for i in range(90)]
    rows.append((90, "once seen", "q"))
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    train, test = df.where("doc_id % 4 <> 0"), df.where("doc_id % 4 = 0 or doc_id = 5")
    tr, te = (d.withColumn("grams", grams(F.col("text"))) for d in (train, test))
    features = learning.text_features().fit(tr)
    want = sorted(tuple(r) for r in learning.classify_features(features.transform(tr), features.transform(te), "label", "bayes").collect())
    for slot_letters in (100, 1 << 24):
        assert sorted(tuple(r) for r in learning.bayes_of_terms(train, test, "text", "label", slot_letters=slot_letters).collect()) == want
    assert learning.bayes_of_terms(train, test.where("false"), "text", "label").count() == 0


def test_classify_by_bayes_needs_no_vocabulary_in_the_driver(spark, monkeypatch):
    # the vocabulary of the library's features is an array in the driver
    monkeypatch.setattr(learning, "text_features", None)
    df = spark.createDataFrame([(i, "alpha beta" if i % 2 else "beta alpha", "xy"[i % 2]) for i in range(8)], "doc_id int, text string, label string")
    assert all(r["label"] == r["predicted"] for r in learning.classify(df, df, "text", "label", "bayes").collect())


def test_principal_components_beyond_fifty(spark):
    # 64 directions of equal variance: 58 of them hold 90 %
    rows = [([float(sign * (i == j)) for j in range(64)],) for i in range(64) for sign in (1, -1)]
    short, kept = learning.principal_components(learning.as_features(spark.createDataFrame(rows, "v array<double>"), "v"))
    assert kept == 58 and short.first()["x"].size == 58


# search


def test_correction(spark):
    docs = spark.createDataFrame([(1, "budget planning"), (2, "budget report"), (3, None)], "id int, t string")
    words = vocabulary(docs, "t")
    assert {tuple(r) for r in words.collect()} == {("budget", 2), ("planning", 1), ("report", 1)}
    assert correct_query("Budgte of rep, planning", words) == ("budget of rep, planning", pytest.approx(5 / 6))
    assert correct_query("budget plan", words) is None


def test_search_rights_and_modes(spark):
    docs = spark.createDataFrame([(1, "budget audit", None, "x", 1, 5, "INDEXED", None), (2, "budget audit", None, "x", None, 6, "INDEXED", None), (3, "budget audit", None, "x", 1, 6, "FAILED", None), (4, "other", None, None, 1, 5, "INDEXED", None), (5, "budget audit", None, None, 1, 5, "INDEXED", "2024")], "doc_id bigint, title string, description string, text string, category_id int, owner_id int, status string, deleted_at string")
    grants = spark.createDataFrame([(2, 5, "read"), (3, 5, "WRITE"), (None, 5, "READ")], "document_id int, user_id int, permission_type string")
    cats = spark.createDataFrame([(1, "Finance")], "id int, name string")
    points = spark.createDataFrame([(1, "c1", 1, None, None, [1.0, 0.0]), (2, "c2", 4, None, None, [0.9, 0.1]), (3, "c3", 4, None, None, [0.0, 1.0]), (4, "c4", 2, None, None, None)], "point_id bigint, chunk_id string, postgres_document_id int, category string, department string, vector array<float>")
    ids = lambda **k: [r["doc_id"] for r in search(SearchSpec("budget audit", **k), docs, grants, cats, points).collect()]
    assert ids(mode="KEYWORD", user=5) == [1, 2]
    assert ids(mode="KEYWORD", admin=True) == [1, 2, 3]
    assert ids(mode="KEYWORD") == []
    assert ids(mode="KEYWORD", admin=True, status="FAILED") == [3]
    assert ids(mode="HYBRID", user=5, vector=[1.0, 0.0]) == [1, 2, 4]
    assert ids(mode="HYBRID", user=5, vector=[1.0, 0.0], page=1, size=2) == [4]
    hits = {r["doc_id"]: r for r in search(SearchSpec("budget audit", [1.0, 0.0], user=5), docs, grants, cats, points).collect()}
    assert hits[1]["matched_by"] == ["KEYWORD", "VECTOR"] and hits[4]["chunk_id"] == "c2" and hits[4]["keyword_score"] is None
    for bad in ({"mode": "X"}, {"size": 0}, {"page": -1}, {"mode": "SEMANTIC"}):
        with pytest.raises(ValueError):
            SearchSpec("a", **bad)


def test_snippets_and_ranges(spark):
    text = "word " * 60 + "the budget audit of " + "tail " * 80
    shown, marks = snippet_of(text, "budget audit")
    assert shown.startswith("…") and shown.endswith("…") and "budget audit" in shown and {shown[a:b] for a, b in marks} == {"budget", "audit"}
    assert snippet_of("plain", "zzz") == ("plain", []) and snippet_of(None, "a") == (None, [])
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 9), ("b", 0, 1)], "g string, low int, high int")
    assert {tuple(r) for r in merge_ranges(df, "g", "low", "high").collect()} == {("a", 1, 5), ("a", 7, 9), ("b", 0, 1)}


@settings(max_examples=30)
@given(st.text(max_size=40))
def test_any_query_text_can_be_split(text):
    try:
        textquery.parse(text)
    except ValueError as error:
        assert str(error)


def test_mini_batches_find_plain_clusters(spark):
    import numpy as np

    from docquarry.operators.learning import mini_batch_k_means

    g = np.random.default_rng(2)
    rows = [(i, (np.eye(4)[i % 4] * 5 + 0.1 * g.normal(size=4)).tolist()) for i in range(400)] + [(1000, None)]
    got = {r["row_id"]: r["cluster"] for r in mini_batch_k_means(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 4, batch=100).collect()}
    assert set(got) == set(range(400)) and len({(i % 4, c) for i, c in got.items()}) == 4
    assert mini_batch_k_means(spark.createDataFrame([], "id int, v array<double>"), "id", "v", 4).count() == 0


def test_leaving_a_topic_out_forgets_its_words(spark):
    from docquarry.operators.learning import leave_one_group_out, shared_groups

    rows = [(1, "apple pear", "fruit", "t1"), (2, "pear plum", "fruit", "t2"), (3, "truck car truck truck", "ride", "t3"), (4, "truck bus truck truck", "ride", "t4"), (5, "rocket", "space", "t5"), (6, "", "fruit", "t2")]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string, topic string")
    got = {r["doc_id"]: r["predicted"] for r in leave_one_group_out(df, "doc_id", "text", "label", "topic").collect()}
    # no other topic has the label space, so it can't be foretold
    assert got[1] == got[2] == "fruit" and got[3] == got[4] == "ride" and got[5] != "space" and set(got) == {1, 2, 3, 4, 5, 6}
    folded = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("c", 0), ("c", 1)], "g string, fold int")
    assert sorted(tuple(r) for r in shared_groups(folded, "g").collect()) == [(0, 2, 3, 1), (1, 2, 2, 1)]


def test_leaving_a_topic_out_in_several_slots(spark):
    import math
    from collections import Counter

    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("apple pear plum truck car bus rocket moon".split()) for _ in range(draw.randrange(0, 9))), draw.choice("xyz"), f"t{i % 4}") for i in range(60)]
    rows.append((60, "orbit orbit apple", "y", "t9"))

    def best(i, text, topic):
        others = [r for r in rows if r[3] != topic]
        words, terms = Counter(), len({w for r in rows for w in r[1].split()})
        for r in others:
            words.update((r[2], w) for w in r[1].split())
        score = {}
        for label in {r[2] for r in others}:
            total = sum(n for (x, _), n in words.items() if x == label) + terms
            score[label] = math.log(sum(r[2] == label for r in others)) + sum(math.log((words[label, w] + 1) / total) for w in text.split())
        return min(score, key=lambda x: (-round(score[x], 6), x))

    df = spark.createDataFrame(rows, "doc_id int, text string, label string, topic string")
    want = {r[0]: best(r[0], r[1], r[3]) for r in rows}
    for slot_rows in (4, 4096):
        assert {r["doc_id"]: r["predicted"] for r in learning.leave_one_group_out(df, "doc_id", "text", "label", "topic", slot_rows).collect()} == want


def test_terms_are_counted_within_rows(spark):
    from docquarry.operators.tfidf import counted_terms

    df = spark.createDataFrame([(1, "Leave the leave policy, leave"), (2, ""), (3, None)], "doc_id int, text string")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in counted_terms(df, "doc_id", "text").collect()}
    assert got == {(1, "leave"): 3, (1, "policy"): 1, (1, "leave leave"): 1, (1, "leave policy"): 1, (1, "policy leave"): 1}


def test_cascades_and_edits(spark):
    from docquarry.operators.quality import cascaded, edited_everywhere

    gone = spark.createDataFrame([(1,), (1,)], "doc bigint")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, ref int")
    assert sorted(r["id"] for r in cascaded(gone, "doc", {"child": (child, "ref")})["child"].collect()) == [11, 12]
    edits = spark.createDataFrame([(2, None)], "doc bigint, id int")
    assert sorted(map(str, edited_everywhere(child, "ref", edits, "doc", "id").collect())) == sorted(map(str, spark.createDataFrame([(10, 1), (None, 2), (12, None)], "id int, ref int").collect()))


def test_stored_percentiles_are_values(spark):
    from docquarry.operators.evaluation import stored_percentiles

    df = spark.createDataFrame([(x,) for x in [5, 1, 9, 3, None, 7]], "x bigint")
    assert tuple(stored_percentiles(df, "x", low=0.0, middle=0.5, high=0.99).first()) == (1, 5, 9)
    assert tuple(stored_percentiles(df.where("x = 5"), "x", a=0.9).first()) == (5,) and tuple(stored_percentiles(df.limit(0), "x", a=0.9).first()) == (None,)


def _two_parts(spark):
    words = {"a": ["red cat", "red dog", "red owl", "red"], "b": ["blue cat", "blue dog", "blue owl", "blue"], "c": ["green cat", "green dog", "green owl", "green"]}
    rows = [(10 * i + j, f"{t} {y if i % 2 else ''} tail", y, int(i > 3)) for j, (y, texts) in enumerate(words.items()) for i, t in enumerate(texts * 2)]
    return spark.createDataFrame([*rows, (900, None, "a", 1), (901, "red cat", "unseen", 1), (902, "none of these", "b", 0)], "doc_id long, text string, label string, part int")


def test_margins_need_no_vocabulary_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(learning, "text_features", None)
    (found,) = learning.margins(_two_parts(spark), "part", 1, "text", "label")
    got = found.collect()
    # a label that was not seen is left out, a row without words is not
    assert len(got) == 13 and sum(r["ok"] for r in got) >= 12 and all(r["margin"] >= 0 for r in got)


@pytest.mark.parametrize("letters", [1, 1 << 20])
def test_columns_hold_what_the_library_holds(spark, letters):
    from docquarry.operators import columns as C
    from docquarry.operators.tfidf import grams

    df = _two_parts(spark)
    held = C.Columns(df, "part", "text", "label", "doc_id", slot_letters=letters, chunk_letters=8 * letters)
    fitted = learning.text_features().fit(df.where("part = 0").withColumn("grams", grams(F.col("text"))))
    assert held.n == df.count() and held.n_terms == len(fitted.stages[0].vocabulary)
    vectors = {r["doc_id"]: r["x"].toArray() for r in fitted.transform(df.withColumn("grams", grams(F.col("text")))).select("doc_id", "x").collect()}
    ids = [r["id"] for part in (0, 1) for r in held.rows(part, "place int", place=np.arange(held.n, dtype=np.int32)).orderBy("place").collect()]
    places = [r["place"] for part in (0, 1) for r in held.rows(part, "place int", place=np.arange(held.n, dtype=np.int32)).orderBy("place").collect()]
    assert sorted(places) == list(range(held.n))
    order = [i for _, i in sorted(zip(places, ids))]
    x = np.array([vectors[i] for i in order])
    own = x[held.trained]
    deviation = own.std(axis=0, ddof=1)
    x = (x - own.mean(axis=0)) / np.where(deviation > 1e-7, deviation, np.inf)
    r = np.random.default_rng(1).normal(size=(2, held.n)) * held.trained
    assert np.allclose(held.over(C._images, {"r": r}, 2), (x @ (x.T @ r.T)).T, atol=1e-3)


def test_descent_comes_to_the_least_value():
    from docquarry.operators import columns as C

    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(60, 4)), draw.integers(0, 3, 60)
    loss = C.softmax(y, np.ones(60, bool), 3)
    fit, image = C.descend(loss, np.zeros((3, 60)), 100, tolerance=1e-12), None
    try:
        while True:
            r = fit.send(image)
            image = (x @ (x.T @ r.T)).T
    except StopIteration as end:
        value, slope = loss(end.value)
    assert value < loss(np.zeros((3, 60)))[0] and np.abs(slope @ np.c_[x, np.ones(60)]).max() < 1e-4


def test_classify_by_any_model_needs_no_vocabulary_in_the_driver(spark, monkeypatch):
    df = _two_parts(spark)
    bayes = {r["doc_id"]: r["predicted"] for r in learning.bayes_of_terms(df.where("part = 0"), df.where("part = 1"), "text", "label").collect()}
    monkeypatch.setattr(learning, "text_features", None)
    found = learning.classify_all(df, "part", "text", "label", ("bayes", "logistic", "svm", "forest"))
    got = {m: {r["doc_id"]: (r["label"], r["predicted"]) for r in f.collect()} for m, f in found.items()}
    assert {i: p for i, (_, p) in got["bayes"].items()} == bayes
    for m in ("logistic", "svm", "forest"):
        assert set(got[m]) == set(bayes) and sum(x == y for x, y in got[m].values()) >= 10


def test_right_vectors_are_those_of_all_rows(spark):
    from pyspark.ml.linalg import SparseVector

    draw = np.random.default_rng(5)
    x = draw.normal(size=(80, 30)) * np.linspace(3, 0.1, 30) * (draw.random((80, 30)) < 0.5)
    df = spark.createDataFrame([(SparseVector(30, {j: float(v) for j, v in enumerate(r) if v}),) for r in x], ["x"])
    v = learning._right_vectors(df, 30, 4, block=6)
    assert np.linalg.svd(v.T @ np.linalg.svd(x)[2][:4].T)[1].min() > 0.9999
