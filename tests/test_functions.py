"""Text, lexical and vector expressions against hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions.lexical import lexical_match, query_terms
from docquarry.functions.vectors import calibrated, combined, cosine, cosine_to, hashed_embedding


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("r")).first()["r"]


def test_tokens_and_terms(spark):
    assert one(spark, X.tokens(F.col("t")), t="Ab_c d-2 Éa") == ["ab", "c", "d", "2", "éa"]
    assert one(spark, X.terms(F.col("t")), t="How the Budget and a budget x of") == ["budget"]
    assert one(spark, X.normalise(F.col("t")), t="  A \t b\n") == "a b"
    assert query_terms("How do I file the annual Budget budget?") == ["file", "annual", "budget"]


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 180, 181, 320, 321, 999])
def test_chunks_follow_the_loop(spark, n):
    words = [f"w{i}" for i in range(n)]
    want, start = [], 0
    while start < n:
        want.append(" ".join(words[start : start + 180]))
        if start + 180 >= n:
            break
        start += 140
    assert one(spark, X.chunks(F.col("t")), t=" ".join(words)) == want


def test_chunk_parameters(spark):
    with pytest.raises(ValueError):
        X.chunks(F.lit("a"), 10, 10)


def score(spark, query, title, description=None, body=None, fuzzy=False):
    df = spark.createDataFrame([(title, description, body)], "t string, d string, b string")
    return df.select(lexical_match(query, F.col("t"), F.col("d"), F.col("b"), fuzzy).alias("m")).first()["m"]


def test_phrases_by_field(spark):
    assert score(spark, "annual report", "The Annual Report 2024")["score"] == 1.0
    assert score(spark, "annual report", "x", "an annual report.")["score"] == 0.95
    assert score(spark, "annual report", "x", "y", "the annual report")["score"] == 0.9
    assert score(spark, "port", "report")["score"] == 0
    part = score(spark, "annual rep", "annual report", fuzzy=True)
    assert part["score"] == pytest.approx(max(0.85, 0.95 * (1 + 0.5 + 0.5 * 3 / 6) / 2)) and part["fuzzy"]


def test_coverage(spark):
    m = score(spark, "budget audit", "Audit of the budget")
    assert m["score"] == pytest.approx(0.95) and (m["matched"], m["total"]) == (2, 2) and not m["fuzzy"]
    m = score(spark, "budget audit", "budget", "audit")
    assert m["score"] == pytest.approx(0.95 * (1 + 0.95) / 2)
    m = score(spark, "budget audit", "budget", None, "auditor")
    assert m["score"] == pytest.approx(0.95 / 2) and m["matched"] == 1
    m = score(spark, "budgte", "budget", fuzzy=True)
    assert m["score"] == pytest.approx(0.95 * (1 - 1 / 6)) and m["fuzzy"]
    assert score(spark, "budgte", "budget")["score"] == 0
    assert score(spark, "cat", "car", fuzzy=True)["score"] == 0
    assert score(spark, "secur", "security", fuzzy=True)["score"] == pytest.approx(0.85)


def test_only_stop_words_and_blank(spark):
    m = score(spark, "how to", "how to do it")
    assert (m["score"], m["total"]) == (1.0, 0)
    assert score(spark, "  ", "x")["score"] == 0
    assert score(spark, "a", None)["score"] == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1:] == [None, None, None]
    assert df.select(cosine_to(F.col("a"), [0.0, 2.0])).first()[0] == pytest.approx(0.8)
    assert one(spark, calibrated(F.lit(0.4), True)) == pytest.approx(0.5)
    assert one(spark, calibrated(F.lit(0.4), False)) == pytest.approx(0.7)
    assert one(spark, combined(F.lit(0.5), F.lit(0.8))) == pytest.approx(0.85)
    assert one(spark, combined(F.lit(None).cast("double"), F.lit(0.8))) == pytest.approx(0.8)
    v = one(spark, hashed_embedding(F.split(F.lit("a b a"), " "), 32))
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5)


def test_names_and_times(spark):
    assert one(spark, X.extension(F.col("t")), t="a/b\\C.TXT") == "txt"
    assert one(spark, X.stem(F.col("t")), t="a/b.c.txt") == "b.c"
    assert one(spark, X.initials(F.col("t")), t=" ada  lovelace king") == "AL"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert one(spark, X.relative_time(F.lit("2024-01-01 22:30:00").cast("timestamp"), now)) == "1h ago"
    assert one(spark, X.clean(F.col("t")), t="ﬁ\x00x  y") == "fi x y"
    assert one(spark, X.feature_text(F.lit("Memo 12 (B)"), F.lit("d"), F.lit("7"))) == "Memo 00. d\n0"
