"""Golden values of scores, corrections, snippets and passages."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions.answers import citations, tidy_answer
from docquarry.functions.lexical import covers_enough, lexical_match
from docquarry.operators.vocabulary import correct_query, deletions, fuzzy_matches
from docquarry.plans.search import SearchSpec, best_passages, corrected, passages, search, snippet_of

CEILING, DESCRIPTION, BODY = 0.95, 0.95, 0.9
typo = lambda d, a, b: 1 - d / max(a, b)
begun = lambda typed, whole: 0.5 + 0.5 * typed / whole

#: query, title, description, body, whether words may be begun or misspelt, score, whether inexact
SCORES = [
    ("Leave Policy", "Leave Policy Update", "x", None, True, 1.0, False),
    ("  leave    policy ", "Leave Policy", "", None, True, 1.0, False),
    ("leave policy", "Onboarding", "mentions the leave policy", None, True, DESCRIPTION, False),
    ("laptops", "Security Standard", "x", "two laptops", True, BODY, False),
    ("policy leave", "Leave Policy Update", "x", None, True, CEILING, False),
    ("the leave policy", "Leave Policy", "", None, True, CEILING, False),
    ("budget draft", "Unrelated", "draft of the budget", None, True, CEILING * DESCRIPTION, False),
    ("leave policy", "Onboarding", "x", "policy on leave", True, CEILING * BODY, False),
    ("port", "Annual Report", "", None, True, 0.0, False),
    ("secur", "Information Security Awareness", "", None, True, 0.85, True),
    ("quart fin", "Quarterly Financial Report Q3", "", None, True, CEILING * (begun(5, 9) + begun(3, 9)) / 2, True),
    ("policy terms", "Policyholder Terms", "", None, True, CEILING * (begun(6, 12) + 1) / 2, True),
    ("qu fi", "Quarterly Financial Report", "", None, True, 0.0, False),
    ("recieve", "How to receive goods", "", None, True, CEILING * typo(1, 7, 7), True),
    ("secrty", "Security Standard", "", None, True, CEILING * typo(2, 6, 8), True),
    ("archtcture", "System Architecture", "", None, True, CEILING * typo(2, 10, 12), True),
    ("plnx", "Office Plan", "", None, True, 0.0, False),
    ("nba", "NDA Template", "Standard NDA", None, True, 0.0, False),
    ("levae policy", "Leave Policy Update", "x", None, False, CEILING / 2, False),
    ("secur", "Information Security", "", None, False, 0.0, False),
    ("policy", "Notes", "the polcy notes", "one policy here", True, BODY, False),
    ("   ", "Leave Policy", "x", None, True, 0.0, False),
    ("leave", None, None, None, True, 0.0, False),
]


@pytest.mark.parametrize("case", SCORES, ids=[f"{c[0].strip()}-{i}" for i, c in enumerate(SCORES)])
def test_scores(spark, case):
    query, title, description, body, fuzzy, score, inexact = case
    df = spark.createDataFrame([(title, description, body)], "t string, d string, b string")
    got = df.select(lexical_match(query, F.col("t"), F.col("d"), F.col("b"), fuzzy).alias("m")).first()["m"]
    assert got["score"] == pytest.approx(score) and got["fuzzy"] == inexact


def test_enough_terms_make_a_hit(spark):
    cases = [("phising", "Security Standard", "phishing reporting", True), ("leave policy", "Policy Notes", "x", False), ("annual leave days carry", "Annual Leave Policy", "days off", True), ("annual leave days carry over", "Annual Notes", "x", False), ("the of and", "x", "y", False)]
    for query, title, description, enough in cases:
        df = spark.createDataFrame([(title, description)], "t string, d string").select(lexical_match(query, F.col("t"), F.col("d"), fuzzy=True).alias("m"))
        assert df.select(covers_enough(F.col("m.score"), F.col("m.matched"), F.col("m.total"))).first()[0] == enough


@pytest.fixture(scope="module")
def words(spark):
    held = {"dynamo": 8, "laptops": 15, "phishing": 15, "everest": 15, "standard": 60, "policy": 90, "police": 1, "security": 15, "awareness": 15, "aware": 40}
    return spark.createDataFrame(list(held.items()), "word string, n_docs bigint").cache()


@pytest.mark.parametrize("typed,fixed,credit", [("Dynmo", "dynamo", typo(1, 5, 6)), ("laptps", "laptops", typo(1, 6, 7)), ("Evrest", "everest", typo(1, 6, 7)), ("secrity awarnes", "security awareness", typo(2, 7, 9)), ("phshng", "phishing", typo(2, 6, 8)), ("What is the dynmo?", "what is the dynamo?", typo(1, 5, 6)), ("polica", "policy", typo(1, 6, 6))])
def test_corrections(words, typed, fixed, credit):
    got = correct_query(typed, words)
    assert got[0] == fixed and got[1] == pytest.approx(credit)


@pytest.mark.parametrize("typed", ["secur", "awar", "phishing standard", "nba", "2024", "kubernetes"])
def test_words_that_stay(words, typed):
    assert correct_query(typed, words) is None


def test_search_goes_on_without_a_vocabulary(spark, words):
    assert corrected(SearchSpec("dynmo", mode="KEYWORD"), words).query == "dynmo"
    assert corrected(SearchSpec("dynmo", mode="FUZZY"), words).query == "dynamo"
    assert corrected(SearchSpec("dynmo", mode="FUZZY"), words.drop("n_docs")).query == "dynmo"


def test_corrected_hits_carry_the_credit(spark, words):
    d = spark.createDataFrame([(1, "Dynamo", None, None, 1, 1, "INDEXED")], "doc_id bigint, title string, description string, text string, category_id int, owner_id int, status string")
    g = spark.createDataFrame([], "user_id int, document_id int, permission_type string")
    c = spark.createDataFrame([(1, "x")], "id int, name string")
    hit = search(SearchSpec("dynmo", mode="HYBRID", admin=True), d, g, c, words=words).first()
    assert hit["score"] == pytest.approx(typo(1, 5, 6)) and hit["matched_by"] == ["KEYWORD", "FUZZY"]
    assert search(SearchSpec("dynmo", mode="KEYWORD", admin=True), d, g, c, words=words).count() == 0


def test_neighbourhoods_meet_all_pairs_within_the_edits(spark):
    from docquarry.operators.edits import swaps_adjacent

    t, w = ["teh", "form", "polcy", "abcdef", "seucrity"], ["then", "from", "farm", "policy", "abdcef", "abcdfe", "bacdfe", "security", "abcd", "acdefg", "xbcdefy"]
    got = {(r["term"], r["word"]) for r in fuzzy_matches(spark.createDataFrame([(x,) for x in t], "term string"), spark.createDataFrame([(x, 1) for x in w], "word string, n_docs bigint")).collect()}
    allowed = lambda x: 0 if len(x) <= 3 else 1 if len(x) <= 5 else 2
    assert got == {(x, y) for x in t for y in w if allowed(x) and swaps_adjacent(x, y) <= allowed(x)}
    assert spark.range(1).select(deletions(F.lit("abc"), 1)).first()[0] == ["abc", "bc", "ac", "ab"]


def marked(text, query, prefix=True):
    shown, ranges = snippet_of(text, query, prefix)
    return [shown[a:b] for a, b in ranges]


def test_snippets():
    assert marked("Report a lost laptop to security.", "lost laptop") == ["lost", "laptop"]
    assert marked("Information security is everyone's job.", "secur") == ["security"]
    assert marked("The policy covers policyholders.", "policy", False) == ["policy"]
    assert marked("Services communicate via Kafka.", "kafka") == ["Kafka"]
    assert marked("Remote working.", "work working") == ["working"]
    filler = "word " * 120
    shown, ranges = snippet_of(filler + "the dynamo project begins " + filler, "dynamo")
    assert shown.startswith("…") and shown.endswith("…") and len(shown) <= 262 and shown[1] != " "
    assert [shown[a:b] for a, b in ranges] == ["dynamo"]
    assert snippet_of("Dynamo begins in June. " + filler, "dynamo")[0].startswith("Dynamo begins")
    assert snippet_of("x" * 300 + " dynamo", "dynamo") == ("…dynamo", [(1, 7)])
    assert snippet_of(None, "a") == snippet_of("  ", "a") == (None, [])
    # the length of lower-cased text doesn't matter
    assert marked("İ" * 30 + " dynamo", "dynamo") == ["dynamo"]


def test_passages_hold_keyword_chunks_then_the_vectors_once(spark):
    hits = spark.createDataFrame([(1, "c3", "d1"), (2, None, "d2"), (3, "zz", None), (4, "c9", "d4")], "doc_id bigint, chunk_id string, description string")
    chunk = lambda i, t, p: (i, t, p)
    rows = [
        (1, 10, [chunk("c1", "Payment is due.", 0), chunk("c2", "This agreement is with the vendor. ", 1), chunk("c3", "Liability is capped.", 2), chunk("c4", "The vendor agreement caps liability.", 3)]),
        (1, 11, [chunk("c1", "newer", 0)]),
        (4, 5, [chunk("c9", "x" * 3000, 0)]),
    ]
    stored = spark.createDataFrame(rows, "doc_id bigint, kd_id bigint, chunks array<struct<chunk_id:string,text:string,position:int>>")
    query = "liability in the vendor agreement"
    got = {r["doc_id"]: r["passage"] for r in passages(hits, stored, query).collect()}
    assert got[1] == "The vendor agreement caps liability.\n…\nThis agreement is with the vendor.\n…\nLiability is capped."
    assert got[2] == "d2" and 3 not in got and got[4] == "x" * 2400 + "…"
    best = {r["doc_id"]: r["best"] for r in best_passages(hits, stored, query).collect()}
    assert best == {1: "The vendor agreement caps liability.", 2: None, 3: None, 4: "x" * 3000}


def test_answers_are_tidied(spark):
    df = spark.createDataFrame([("【1†L1-L3】 says **so**, [2, 3] too  \n* one\n  * two",)], "a string")
    tidy, cited = df.select(tidy_answer(F.col("a")), citations(tidy_answer(F.col("a")))).first()
    assert tidy == "[1] says so, [2, 3] too\n- one\n  - two" and cited == [1, 2, 3]
