"""Small cases and brute force for every operator of the llm folder."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import checked, cohesion, queries
from docquarry.llm.confusables import lookalike_pairs, one_form, single_mapping, transducer
from docquarry.llm.grid import alnum_table, slices, tokenise
from docquarry.llm.mixing import allot, mix_sources, pivotal, source_name
from docquarry.llm.neardup import Covering, duplicate_groups, duplicate_pairs, near_duplicates
from docquarry.llm.neighbours import PermutationIndex, nearest_vectors, overlaps
from docquarry.llm.packing import fill_report, pack, recipes
from docquarry.llm.splits import entity_components, grouped_splits, records_with_component
from docquarry.llm.tokens import token_count

rng = random.Random(5)


def prose(n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


# grid


def test_tokenise_agrees_with_a_pattern():
    texts = ["Ab c_d 12", "", None, "naïve — π2", "x" * 50 + " y"]
    at, starts, ends, hashes = tokenise(texts, alnum_table())
    got = [(int(i), texts[i][s:e]) for i, s, e in zip(at, starts, ends)]
    assert got == [(i, m) for i, t in enumerate(texts) for m in re.findall(r"[^\W_]+", t or "")]
    again = tokenise(["y " * 3], alnum_table())[3]
    assert len(set(again.tolist())) == 1 and again[0] == hashes[-1]


def test_slices_cover_everything_once():
    texts = ["a" * n for n in (5, 0, 3, 900, 2)]
    assert [i for low, high in slices(texts, 8) for i in range(low, high)] == list(range(5))


# 1


def chunked(*parts):
    return [{"text": t, "position": p} for p, t in parts]


def test_bad_pieces_by_rule():
    text = " ".join(f"t{i}" for i in range(300))
    w = text.split()
    good = chunked((0, " ".join(w[:180])), (1, " ".join(w[140:300])))
    assert cohesion.bad_pieces(text, good, 180, 40) == []
    assert cohesion.bad_pieces(text, list(reversed(good)), 180, 40) == []
    assert cohesion.bad_pieces(text, chunked((0, " ".join(w[:181]))), 180, 40) == [0]
    assert cohesion.bad_pieces(text, chunked((0, " ".join(w[:180])), (1, " ".join(w[141:300]))), 180, 40) == [1]
    assert cohesion.bad_pieces(text, chunked((0, "t1 t3")), 180, 40) == [0]
    assert cohesion.bad_pieces(text, chunked((0, "1 t2")), 180, 40) == [0]
    assert cohesion.bad_pieces(None, chunked((0, "a")), 180, 40) == [0]
    assert cohesion.bad_pieces(text, [None, {"text": "x", "position": None}], 180, 40) == []
    assert cohesion.bad_pieces("", chunked((0, None)), 180, 40) == []


def test_cohesion_equals_plain_counting():
    words = [rng.randrange(9) for _ in range(150)] + [rng.randrange(5, 14) for _ in range(90)]
    at = np.array([0] * 150 + [1] * 90)
    hashes = np.array(words, np.uint64)
    counted = np.array([w % 3 > 0 for w in words])
    got = cohesion.cohesion(at, hashes, counted, 20)
    for g in range(len(words)):
        low, high = (0, 150) if g < 150 else (150, 240)
        a = Counter(words[i] for i in range(max(low, g - 20), g) if counted[i])
        b = Counter(words[i] for i in range(g, min(high, g + 20)) if counted[i])
        scale = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        assert got[g] == pytest.approx(sum(n * b[w] for w, n in a.items()) / scale if scale else 0)


@pytest.mark.parametrize("n", [0, 1, 179, 180, 181, 500, 2500])
def test_pieces_keep_the_limit_the_overlap_and_every_word(n):
    text = prose(n).replace(". ", ".\n\n", 3)
    (ranges,) = cohesion.split_batch([text], 180, 40)
    pieces = [text[a:b].split() for a, b in ranges]
    assert all(len(p) <= 180 for p in pieces) and bool(pieces) == bool(n)
    for before, p in zip(pieces, pieces[1:]):
        assert p[:40] == before[-40:]
    assert [w for i, p in enumerate(pieces) for w in p[40 * (i > 0) :]] == text.split()
    inner = [p[-1] for p in pieces[:-1]]
    assert all(w.endswith(".") for w in inner)


def test_cut_falls_where_the_topic_changes():
    one, two = ([f"{x}{i % 7}word" for i in range(100)] for x in "ab")
    text = ". ".join(" ".join(one[i : i + 10]) for i in range(0, 100, 10)) + ". " + ". ".join(" ".join(two[i : i + 10]) for i in range(0, 100, 10)) + "."
    (ranges,) = cohesion.split_batch([text], 180, 40)
    assert len(text[: ranges[0][1]].split()) == 100


def test_lines_end_pieces_only_without_better_ends():
    w = [f"t{i}" for i in range(400)]
    lines = "\n".join(" ".join(w[i : i + 20]) for i in range(0, 400, 20))
    (ranges,) = cohesion.split_batch([lines], 180, 40)
    assert all(lines[b : b + 1] in ("\n", "") for _, b in ranges)
    mixed = lines.replace("t124 ", "t124. ").replace("t255 ", 't255.") ')
    (ranges,) = cohesion.split_batch([mixed], 180, 40)
    assert [mixed[:b].split()[-1] for _, b in ranges[:2]] == ["t124.", 't255.")']
    (gaps, every) = cohesion.boundaries("a b. c\n\nd (e!)\nf g", *np.array([(0, 1), (2, 4), (5, 6), (8, 9), (10, 14), (15, 16), (17, 18)]).T)
    assert gaps.tolist() == [2, 3, 5] and every.tolist() == [2, 3, 5]


def test_text_without_boundaries_is_cut_at_the_limit():
    (ranges,) = cohesion.split_batch(["x " * 400], 180, 40)
    assert [len(("x " * 400)[a:b].split()) for a, b in ranges] == [180, 180, 120]


def test_recut_frame_cases(spark):
    rows = [(1, "a b.", None, "extra"), (2, None, None, "x"), (3, "  ", [], "y"), (4, "a b", [("a b", 0)], "z"), (4, "a b", [("b a", 0)], "z")]
    df = spark.createDataFrame(rows, "id int, text string, chunks array<struct<text:string,position:int>>, bad string")
    got = sorted((r["row_id"], r["bad"], None if r["pieces"] is None else len(r["pieces"])) for r in cohesion.recut(df, "id", "text", "chunks").collect())
    assert got == [(1, [], 1), (2, [], 0), (3, [], 0), (4, [], None), (4, [0], 1)]
    assert cohesion.recut(df.limit(0), "id", "text", "chunks").count() == 0
    assert {(r["row_id"], r["position"], r["text"]) for r in cohesion.piece_rows(df, "id", "text", "chunks").collect()} == {(1, 0, "a b."), (4, 0, "a b")}


def test_stored_pieces_that_end_off_a_boundary_in_reach_are_cut_anew(spark):
    w = [f"t{i}" + ("." if i in (154, 170) else "") for i in range(300)]
    off = [(" ".join(w[:180]), 0), (" ".join(w[140:]), 1)]
    on = [(" ".join(w[:171]), 0), (" ".join(w[131:]), 1)]
    plain = [x.rstrip(".") for x in w]
    rows = [(1, " ".join(w), off), (2, " ".join(w), on), (3, " ".join(plain), [(" ".join(plain[:180]), 0), (" ".join(plain[140:]), 1)])]
    df = spark.createDataFrame(rows, "id int, text string, chunks array<struct<text:string,position:int>>")
    got = {r["row_id"]: (r["bad"], r["pieces"]) for r in cohesion.recut(df, "id", "text", "chunks").collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [[], [], []]
    assert got[1][1] is not None and got[2][1] is None and got[3][1] is None
    ends = [r["text"].split()[-1] for r in cohesion.piece_rows(df.where("id = 1"), "id", "text", "chunks").orderBy("position").collect()]
    assert all(e.endswith(".") for e in ends[:-1])


def test_stored_pieces_that_lose_words_are_cut_anew(spark):
    w = [f"t{i}" + ("." if i % 10 == 9 else "") for i in range(300)]
    text = " ".join(w)
    cut = lambda *ranges: [(" ".join(w[a:b]), k) for k, (a, b) in enumerate(ranges)]
    stored = {
        1: cut((0, 180), (140, 300)),
        2: cut((0, 180), (140, 299)),  # stops early
        3: cut((10, 180), (140, 300)),  # starts late
        4: [None],
        5: [("x", None)],
        6: [(None, 0)],
        7: [(" ", 0)],
        8: cut((0, 180)),
        9: [*cut((0, 180), (140, 300)), (None, 2)],
    }
    df = spark.createDataFrame([(i, text, x) for i, x in stored.items()] + [(10, "a b. a c.", [("a b.", 0), ("a b. a c.", 1)]), (11, "", [(" ", 0)]), (12, None, [None])], "id int, text string, chunks array<struct<text:string,position:int>>")
    assert sorted(r["row_id"] for r in cohesion.recut(df, "id", "text", "chunks").where("pieces is null").collect()) == [1, 10]
    got = defaultdict(list)
    for r in cohesion.piece_rows(df, "id", "text", "chunks").orderBy("row_id", "position").collect():
        got[r["row_id"]].append(r["text"].split())
    assert set(got) == {*range(1, 11)}
    for i in range(1, 10):
        words = []
        for p in got[i]:
            assert p and (not words or p[:40] == words[-40:])
            words += p[40 * bool(words) :]
        assert words == w


# 2


def test_components_over_chains_and_cycles(spark):
    t = spark.createDataFrame([("A-1", "b 2"), ("B2", "c3"), ("x", None), ("y", "Z."), ("z", "y"), (None, "q"), ("x", None)], "k string, f string")
    got = defaultdict(set)
    for r in entity_components(t, "k", "f").collect():
        got[r["component"]].add(r["entity"])
    assert sorted(map(sorted, got.values())) == [["a1", "b2", "c3"], ["q"], ["x"], ["y", "z"]] or sorted(map(sorted, got.values())) == [["a1", "b2", "c3"], ["x"], ["y", "z"]]
    docs = spark.createDataFrame([(1, " A 1"), (2, None), (3, "nope"), (3, "Y!")], "id int, k string")
    r = {(x["row_id"], x["component"]) for x in records_with_component(docs, "id", "k", entity_components(t, "k", "f")).collect()}
    assert r == {(1, "a1"), (2, None), (3, None), (3, "y")}


def test_documents_under_a_former_key_follow_the_renamed_topic(spark, tmp_path):
    # no topic holds the keys old0 to old39 any more
    topics = spark.createDataFrame([(i, f"new{i}", f"c{i % 2}", f"old{i}") for i in range(40)], "topic_id int, topic_key string, category string, former_key string")
    docs = spark.createDataFrame([(2 * i + k, f"{('new', 'Old ')[k]}{i}") for i in range(40) for k in (0, 1)], "doc_id bigint, topic_key string")
    topics.write.parquet(f"{tmp_path}/topics.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    split = {r["doc_id"]: r["split"] for r in queries.p2_splits(spark, str(tmp_path)).collect()}
    assert len(split) == 80 and all(split[2 * i] == split[2 * i + 1] for i in range(40))
    assert {r["doc_id"] for r in queries.p2_found(spark, str(tmp_path)).collect()} == {2 * i for i in range(40)}


def test_splits_keep_groups_shares_and_categories(spark):
    rows = [(i, f"g{min(int(rng.paretovariate(0.8)), 300)}") for i in range(6000)]
    rows = [(i, g, f"c{int(g[1:]) % 4}" if int(g[1:]) % 9 else None) for i, g in rows] + [(10_000 + i, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, grp string, c string").withColumn("split", F.lit("clash"))
    got = grouped_splits(df, "id", "grp", "c").collect()
    assert len(got) == len(rows)
    split = {r["row_id"]: r["split"] for r in got}
    assert all(len({split[i] for i, g, _ in rows if g == x}) == 1 for x in {g for _, g, _ in rows if g})
    n = Counter(split.values())
    assert abs(n["train"] / len(rows) - 0.8) < 0.03 and abs(n["test"] / len(rows) - 0.1) < 0.03
    for c in ("c0", "c1", "c2", "c3"):
        assert {split[i] for i, _, x in rows if x == c} == {"train", "validation", "test"}
    assert grouped_splits(df.limit(0), "id", "grp", "c").count() == 0
    # groups that lie somewhere already stay there when the data grow
    first = df.where("id % 2 = 0")
    before = grouped_splits(first, "id", "grp", "c").join(first.select(F.col("id").alias("row_id"), F.col("grp").alias("group")), "row_id").where("group is not null").select("group", "split").distinct()
    held = {r["group"]: r["split"] for r in before.collect()}
    after = grouped_splits(df.drop("split"), "id", "grp", "c", earlier=before).collect()
    assert len(after) == len(rows)
    now = {r["row_id"]: r["split"] for r in after}
    assert all(now[i] == held[g] for i, g, _ in rows if g in held)
    assert all(len({now[i] for i, g, _ in rows if g == x}) == 1 for x in {g for _, g, _ in rows if g})
    m = Counter(now.values())
    assert abs(m["train"] / len(rows) - 0.8) < 0.04


# 4


def brute(texts, kind, size, limit):
    def shingles(t):
        runs = re.findall(r"[^\W_]+", (t or "").lower())
        if kind == "words":
            return {tuple(runs[i : i + size]) for i in range(len(runs) - size + 1)}
        s = " ".join(runs)
        return {s[i : i + size] for i in range(len(s) - size + 1)}

    sets = [(i, shingles(t)) for i, t in texts]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and i != j and len(a & b) / len(a | b) >= limit}


@pytest.mark.parametrize("kind,size,limit,covering", [("words", 3, 0.6, Covering(15, (2, 2, 1))), ("letters", 3, 0.7, Covering(18, (3, 3, 2))), ("words", 5, 0.8, Covering(15, (3, 3, 3)))])
def test_near_duplicates_agree_with_brute_force(spark, kind, size, limit, covering):
    texts, i = [], 0
    for _ in range(25):
        base = prose(60, 3000).split()
        for _ in range(5):
            i += 1
            edited = list(base)
            for _ in range(rng.randrange(0, 7)):
                edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
            texts.append((i, " ".join(edited)))
    texts += [(i + 1, None), (i + 2, ""), (i + 3, "one"), (i + 4, texts[0][1]), (i + 5, texts[0][1].upper()), (i + 6, "?! ...")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("class", F.lit(1)).withColumn("mark", F.lit(2))
    members, links = near_duplicates(df, "id", "text", kind, size, limit, covering)
    want = brute(texts, kind, size, limit)
    assert {tuple(r) for r in duplicate_pairs(members, links).collect()} == want
    # buckets cut into pairs of blocks give the same
    assert {tuple(r) for r in duplicate_pairs(*near_duplicates(df, "id", "text", kind, size, limit, covering, bucket=2, sized=1.0)).collect()} == want
    groups = {r["id"]: r["group"] for r in duplicate_groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    assert len(groups) == len([1 for _, t in texts if brute([(1, t), (2, t)], kind, size, limit)])


@pytest.mark.parametrize("bucket", [4000, 2])
def test_unlike_members_of_a_bucket_make_no_pair(spark, bucket):
    from docquarry.llm.neardup import DIGESTS, _bucket_pairs

    # three unlike digests, four rows each, all in one bucket; those of a digest differ in a few symbols
    draw = random.Random(5)
    rows = []
    for kind in range(3):
        words = [draw.getrandbits(64) for _ in DIGESTS]
        rows += [(4 * kind + k, [1, 2], *(w - (1 << 64) if w >> 63 else w for w in (w ^ (1 << draw.randrange(64)) for w in words))) for k in range(4)]
    leaders = spark.createDataFrame(rows, "id int, marks array<bigint>, " + ", ".join(f"{d} bigint" for d in DIGESTS))
    got = sorted(tuple(r) for r in _bucket_pairs(leaders, 0.7, bucket, 1.0).collect())
    assert got == [(a, b) for a in range(12) for b in range(a + 1, 12) if a // 4 == b // 4]


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id int, text string")
    members, links = near_duplicates(df, "id", "text")
    assert members.count() == links.count() == 0 == duplicate_groups(members, links).count()


def test_covering_masks_guarantee_their_radius():
    covering = Covering(4, (2, 2, 1))
    sketch = np.arange(covering.symbols, dtype=np.uint64)[:, None].repeat(1, 1)
    own = covering.signatures(sketch)
    for _ in range(200):
        other = sketch.copy()
        for k in rng.sample(range(covering.symbols), 2 * covering.groups - 1):
            other[k] += np.uint64(1000)
        assert (covering.signatures(other) == own).any()
    assert Covering(15, (2, 2, 1)).miss(0.6) < 5e-4 and Covering(18, (3, 3, 2)).miss(0.7) < 7e-4 and Covering(15, (3, 3, 3)).miss(0.8) < 1e-3


# 5


@pytest.mark.parametrize("index", [PermutationIndex(), PermutationIndex(block=64, shelf=200), PermutationIndex(file=64, shelf=100, reranked=40), PermutationIndex(file=64, most=48, branch=4, depth=2, shelf=60, block=90)])
def test_nearest_vectors_recall_and_cases(spark, index):
    g = np.random.default_rng(3)
    centres = g.normal(size=(60, 16))
    x = (centres[g.integers(0, 60, 900)] + 0.25 * g.normal(size=(900, 16))).astype(np.float32) * g.uniform(0.1, 40, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + k, x[7].tolist()) for k in range(9)]
    ok = dict(rows)
    rows += [(2000, None), (2001, []), (2002, [1.0] * 15), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").withColumn("pivot", F.lit("x"))
    got = nearest_vectors(df, "id", "v", 5, 16, index=index).collect()
    ids = sorted(ok)
    m = np.array([ok[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = np.round(m @ m.T, 12)
    np.fill_diagonal(c, -2)
    mine = defaultdict(dict)
    for r in got:
        mine[r["id"]][r["neighbour"]] = r["cosine"]
        assert r["cosine"] == pytest.approx(c[ids.index(r["id"]), ids.index(r["neighbour"])], abs=1e-9)
    assert set(mine) == set(ids) and all(len(v) == 5 for v in mine.values())
    hit = sum(ids[j] in mine[ids[k]] for k in range(len(ids)) for j in np.lexsort((ids, -c[k]))[:5])
    assert hit / (5 * len(ids)) >= 0.9
    assert set(mine[1003]) == {7, 1000, 1001, 1002, 1004}
    near = nearest_vectors(df, "id", "v", 5, 16, least=0.95, index=index).collect()
    assert all(r["cosine"] >= 0.95 for r in near)
    assert nearest_vectors(df.limit(0), "id", "v", 5, 16).count() == 0
    assert nearest_vectors(df.where("id < 1"), "id", "v", 5, 16).count() == 0


def test_files_keep_their_length_as_the_collection_grows():
    index = PermutationIndex()
    for n in (10_000, 1_000_000, 100_000_000, 10**10, 10**12):
        m, d = index.pivots(n), index.pivots_of_a_file(n)
        files = math.comb(index.posted, d)
        assert m <= index.most and (files * files * n / (m * index.branch ** (d - 1)) <= 2 * index.posted * index.file or d == index.posted)
    assert [index.pivots_of_a_file(n) for n in (10_000, 200_000)] == [1, 1] and index.pivots_of_a_file(10**8) > 1


def test_overlap_tables_rank_like_the_footrule():
    g = np.random.default_rng(5)
    asked, held = (np.array([g.permutation(30)[:8] for _ in range(n)]) for n in (6, 40))
    shared = np.concatenate(list(overlaps(asked, held))).astype(int)
    weight = lambda ranks: np.array([[8 - list(r).index(p) if p in r else 0 for p in range(30)] for r in ranks])
    footrule = np.abs(weight(asked)[:, None, :] - weight(held)[None, :, :]).sum(axis=2)
    assert (footrule == 8 * 9 - 2 * shared).all()


# 6


def test_recipes_place_everything_within_capacity():
    for _ in range(50):
        capacity = rng.randrange(5, 300)
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 400)))
        plan = recipes(dict(counts), capacity)
        placed = Counter()
        for bins, recipe in plan:
            assert bins > 0 and sum(s * n for s, n in recipe) <= capacity
            for size, n in recipe:
                placed[size] += bins * n
        assert placed == counts


def test_packing_cases(spark):
    texts = [(i, prose(rng.randrange(1, 90))) for i in range(400)] + [(500, None), (501, ""), (502, prose(700)), (503, "same"), (503, "same")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("container", F.lit(9)).withColumn("size", F.lit(1))
    specs = spark.createDataFrame([(1, "s", 64), (2, "m", 300), (3, "none", None), (4, "zero", 0)], "spec int, name string, capacity int")
    out = pack(df, "id", "text", specs, "spec", "capacity")
    rows = out.collect()
    sizes = {r["id"]: r["n"] for r in df.select("id", token_count(F.col("text")).alias("n")).collect()}
    for spec, capacity in ((1, 64), (2, 300)):
        own = [r for r in rows if r["spec_id"] == spec]
        fill, by_row = Counter(), Counter()
        for r in own:
            by_row[r["row_id"]] += r["token_end"] - r["token_start"]
            if r["container"] is not None:
                fill[r["container"]] += r["token_end"] - r["token_start"]
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        assert all(by_row[i] == n * (2 if i == 503 else 1) for i, n in sizes.items())
        split = {i for i, k in Counter(r["row_id"] for r in own).items() if k > 1 and i != 503}
        assert split == {i for i, n in sizes.items() if n > capacity}
        assert sum(fill.values()) / (len(fill) * capacity) > 0.95
        assert {r["row_id"] for r in own if r["container"] is None} == {500, 501}
    report = fill_report(out, specs, "spec", "capacity").collect()
    assert len(report) == 2 and all(r["class_fill"] <= r["fill"] <= 1 and r["class_containers"] >= r["containers"] for r in report)
    assert all(r["class"] == {1: 64, 2: 300}[r["spec_id"]] // (r["token_end"] - r["token_start"]) for r in rows if r["container"] is not None)
    assert pack(df.limit(0), "id", "text", specs, "spec", "capacity").count() == 0
    assert pack(df, "id", "text", specs.limit(0), "spec", "capacity").count() == 0


# 7


def test_allotment_meets_caps_and_shares_the_rest():
    assert allot({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 5, "b": 2}, 100) == {"a": 80.0, "b": 20.0}
    assert allot({"a": 100}, {"a": 0.6, "none": 0.4}, {"a": 1, "none": 3}) == {"a": 100.0, "none": 0.0}
    assert allot({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}
    assert allot({"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 1000) == {"a": 10.0, "b": 10.0}


def test_pivotal_keeps_the_weighted_sum_and_each_chance():
    size = np.array([3.0, 50.0, 7.0, 21.0, 9.0, 14.0, 30.0])
    chance = np.array([0.3, 0.3, 0.3, 0.3, 0.3, 1.0, 0.0])
    total = np.zeros(7)
    g = np.random.default_rng(1)
    for _ in range(4000):
        p = pivotal(chance, size, g)
        assert (p @ size) == pytest.approx(chance @ size) and ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - chance).max() < 0.03


def test_mixing_in_a_tree_of_several_levels(spark, monkeypatch):
    from docquarry.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, ("web", "books")[i % 2], prose(rng.randrange(5, 60))) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    targets = spark.createDataFrame([("web", 0.3, 2), ("books", 0.7, 3)], "s string, w double, r int")
    # 75 buckets a source, combined by four
    uses = mixing.mix_sources(df, "id", "source", "text", targets, "s", "w", "r")[0].collect()
    assert sorted(r["row_id"] for r in uses) == list(range(1200))
    held, used, largest = Counter(), Counter(), Counter()
    for r in uses:
        held[r["source"]] += r["n"]
        used[r["source"]] += r["n"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["n"])
    want = allot(held, {"web": 0.3, "books": 0.7}, {"web": 2, "books": 3})
    assert all(abs(used[s] - want[s]) <= largest[s] for s in held)


def test_mixing_cases(spark):
    rows = [(i, rng.choice(["Web", " web ", "books", "mail_box"]), prose(rng.randrange(5, 60))) for i in range(900)] + [(2000, None, "x"), (2001, "web", None), (2002, "other", "y z"), (2003, "books", "same"), (2003, "books", "same")]
    df = spark.createDataFrame(rows, "id int, source string, text string").withColumn("copies", F.lit(7)).withColumn("n", F.lit(1))
    targets = spark.createDataFrame([("web", 0.2, 1), ("Books", 0.5, 3), ("mail-box", 0.2, 2), ("absent", 0.1, 2), (None, 0.3, 1)], "s string, w double, r int")
    uses, shares = mix_sources(df, "id", "source", "text", targets, "s", "w", "r")
    u = uses.collect()
    assert len(u) == len(rows)
    most = {"web": 1, "books": 3, "mail-box": 2}
    assert all(0 <= r["copies"] <= most.get(r["source"], 0) for r in u)
    s = {r["source"]: r for r in shares.collect()}
    assert s["absent"]["actual_share"] == 0 and s["other"]["target_share"] is None
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1)
    largest = max(r["n"] for r in u)
    held = Counter()
    for r in u:
        if r["source"] in most:
            held[r["source"]] += r["n"]
    want = allot(held, {"web": 0.2, "books": 0.5, "mail-box": 0.2, "absent": 0.1}, most | {"absent": 2})
    assert all(abs(s[k]["used"] - want[k]) <= largest for k in most)
    again, _ = mix_sources(df.limit(0), "id", "source", "text", targets, "s", "w", "r")
    assert again.count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([("A_b ",), ("a-B",), ("a b",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(F.col("s"))).collect()] == ["a-b", "a-b", "a-b", None, None]


# 8


def test_mapping_has_no_conflict_and_is_stable():
    mapping = single_mapping()
    f = transducer()
    assert all(f(f(c)) == f(c) for c in mapping)
    assert all(f(c) == unicodedata.normalize("NFC", c) for c in "éßñжω中한9!" + "A\t\n")


@pytest.mark.parametrize("a,b", [("ｆｕｌｌ", "full"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("аbc", "abc"), ("ﬁn", "fin"), ("e‍́", "é"), ("во­да", "вода"), ("ΑBC", "ABC"), ("ｅ́", "é"), ("е́", "é")])
def test_same_looks_become_equal(a, b):
    assert transducer()(a) == transducer()(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("a  b", "a b"), ("a\nb", "a b"), ("1", "l"), (".", ","), ("a\r\nb", "a\nb"), ("a\tb", "a b")])
def test_different_looks_stay_apart(a, b):
    assert transducer()(a) != transducer()(b)


@pytest.mark.parametrize("a,b", [("Օօ", "Oo"), ("Ꭺ", "A"), ("Ꮃ", "W"), ("Ꮋ", "H"), ("ꓮꓐ", "AB"), ("Ⲥⲟ", "Co"), ("𝐛𝐨𝐥𝐝", "bold"), ("ℎ", "h"), ("Ⅰ", "I"), ("ⅴ", "v"), ("Ⅷ", "VIII"), ("𝛂", "a"), ("αρ", "ap"), ("υ", "u"), ("κτ", "кт"), ("ı", "i"), ("ꜱ", "s"), ("ё", "ë"), ("=\u0338", "≠"), ("х\u00a0—\u2003у", "x — y")])
def test_looks_of_further_scripts_become_equal(a, b):
    assert transducer()(a) == transducer()(b)


def test_the_automaton_composes_like_the_standard():
    f = transducer()
    pool = [chr(c) for c in range(0x300, 0x370)] + list("aeioukхЕαｅ각각!") + ["\u200d", "\u09c7", "\u09be", "\u0323"]
    for _ in range(5000):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))
        assert unicodedata.normalize("NFC", f(s)) == f(s) == f(f(s))
    for _ in range(2000):
        s = "".join(rng.choice("aeiu" + "".join(map(chr, range(0x300, 0x30D))) + "\u0323\u0327") for _ in range(rng.randrange(1, 6)))
        assert f(s) == unicodedata.normalize("NFC", s)


def test_words_of_another_script_keep_it():
    for text in ("Приложение и вода", "кот", "Ռուսաստան", "ᏣᎳᎩ", "καλά", "Ёлка, Київ"):
        assert transducer()(text) == text
    assert transducer()("καλά") != transducer()("kaλá")


def test_lookalike_pairs_cases(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, ""), (6, "Abc"), (7, "ab​c"), (2, "аbc"), (8, "​"), (9, "x" * 100_000 + "é"), (10, "x" * 100_000 + "é")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("form", F.lit(1)).withColumn("stored", F.lit(1))
    assert {tuple(r) for r in lookalike_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7), (9, 10)}
    assert lookalike_pairs(df.limit(0), "id", "text").count() == 0
    assert [r[0] for r in df.where("id in (4, 5)").orderBy("id").select(one_form(F.col("text"))).collect()] == [None, ""]


# whole queries


def test_whole_results(spark, small):
    rows = {n: queries.QUERIES[n](spark, small).collect() for n in ("p1_pieces", "p2_splits", "p5_nearest", "p6_packing", "p6_fill", "p7_uses", "p7_shares", "p8_text")}
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert len({r["kd_id"] for r in rows["p1_pieces"]}) > 0.8 * spark.read.parquet(f"{small}/knowledge_documents.parquet").count()
    assert len(rows["p2_splits"]) == len(rows["p7_uses"]) == len(rows["p8_text"]) == n
    assert {r["split"] for r in rows["p2_splits"]} == {"train", "validation", "test"}
    assert max(Counter(r["point_id"] for r in rows["p5_nearest"]).values()) == 5
    assert len({(r["spec_id"], r["doc_id"]) for r in rows["p6_packing"]}) == 3 * n
    assert all(0.8 < r["fill"] <= 1 for r in rows["p6_fill"])
    assert sum(r["actual_share"] for r in rows["p7_shares"]) == pytest.approx(1)


def test_a_check_sees_bad_pieces(spark):
    w = [f"t{i}" + ("." if i in (100, 150) else "") for i in range(300)]
    texts = spark.createDataFrame([(i, " ".join(w)) for i in range(4)], "id int, text string")
    cut = lambda i, *ranges: [(i, k, " ".join(w[a:b])) for k, (a, b) in enumerate(ranges)]
    pieces = cut(0, (0, 151), (111, 290), (250, 300)) + cut(1, (0, 180), (140, 300)) + cut(2, (0, 151), (110, 300)) + cut(3, (0, 101), (61, 299))
    df = spark.createDataFrame(pieces, "row_id int, position int, text string")
    got = {r["row_id"]: r for r in checked.pieces_checked(df, texts, "id", "text").collect()}
    assert [(got[i]["n_long"], got[i]["n_unopened"], got[i]["n_unnatural"]) for i in range(4)] == [(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1)]
    assert got[0]["digest"] == got[1]["digest"] != got[3]["digest"] and got[3]["n_words"] == 299


def test_sql_agrees(spark, small):
    import duckdb

    from docquarry.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "topics", "knowledge_documents", "chunk_vectors", "container_specs", "mix_targets"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name, sql in SQL.items():
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(map(repr, map(tuple, QUERIES[name](spark, small).select(*names).collect()))) == sorted(map(repr, got.fetchall())), name
