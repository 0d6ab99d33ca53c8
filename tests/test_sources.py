"""Files, sinks and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from docquarry.sources import files
from docquarry.streaming.ingest import chunked, event_counts, ingest, stream_table, streaming_reservoir


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_extraction(spark, tmp_path):
    for name, content in {"a.TXT": b"\xef\xbb\xbfone\r\ntwo", "b.md": b"\xff", "c.txt": b"a\0b", "d.txt": b"  ", "e.docx": docx("p1", "p2"), "f.docx": b"no", "g.pdf": b"%PDF", "h.bin": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in files.extracted(files.binary_files(spark, str(tmp_path))).collect()}
    assert got["a.TXT"] == ("one\ntwo", None) and got[".docx"[-5:]] is not None
    assert (got["/b.md"][1], got["c.txt"][1], got["d.txt"][1], got["g.pdf"][1], got["h.bin"][1]) == ("not UTF-8", "holds NUL", "blank", "no PDF reader", "unknown format")
    assert files.read_docx(docx("p1", "p2")) == ("p1\t\np2\t", None) and files.read_docx(b"no")[0] is None


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("q\td\n1\tx\n")
    assert files.read_tsv(spark, str(tmp_path / "q.tsv")).collect()[0].asDict() == {"q": "1", "d": "x"}
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    files.write_json_lines(df, str(tmp_path / "out"))
    assert sorted(files.read_json_lines(spark, str(tmp_path / "out"), "id int, v string").collect()) == sorted(df.collect())
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "id int").count() == 2


def test_table_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "b"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, files.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, files.updated(old, F.col("id") == 1, v=F.lit("z")).collect())) == [(1, "z"), (2, "b")]
    assert [r["id"] for r in files.without(old, F.col("v") == "a").collect()] == [2]
    grown = files.appended(old.withColumn("k", F.lit(None).cast("array<string>")), "k", F.lit("x"), F.col("id") == 2)
    assert sorted((r["id"], r["k"]) for r in grown.collect()) == [(1, None), (2, ["x"])]
    assert files.insert_statements(spark.createDataFrame([(1, "o'b", None)], "a int, b string, c string"), "t").first()[0] == "INSERT INTO t (a, b, c) VALUES (1, 'o''b', NULL);"
    key = old.select(files.named_uuid(F.lit("x")).alias("u")).first()[0]
    assert len(key) == 36 and key[14] == "3" and key[19] in "89ab"


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").schema
    source = stream_table(spark, f"{small}/document[s].parquet", schema)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest(source, out, state).awaitTermination()
    want = chunked(spark.read.parquet(f"{small}/documents.parquet"))
    got = spark.read.parquet(out)
    assert got.count() == want.count() == got.select("point_key").distinct().count()
    ingest(stream_table(spark, f"{small}/document[s].parquet", schema), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == want.count()
    events = spark.read.parquet(f"{small}/events.parquet")
    assert event_counts(events).agg(F.sum("n")).first()[0] == events.count()
    live = stream_table(spark, f"{small}/event[s].parquet", events.schema)
    q = streaming_reservoir(live, "event_type", "event_id", 5).writeStream.format("memory").queryName("kept").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from kept").collect()
    assert sum(r["seen"] for r in rows) == events.count() and all(len(r["sample"]) == 5 for r in rows)


def test_corpus_is_alike_every_time(spark):
    from docquarry.sources.corpus import corpus, grants

    templates = spark.createDataFrame([("b", "Plan of {town}", "{town} opens at {hour}; {town} closes."), ("a", "Note", "none")], "topic string, title string, body string")
    slots = {"town": ["Ulm", "Bern", "Graz"], "hour": ["8", "9"]}
    made = corpus(templates, 30, slots, ["ann", "bob"], 5)
    rows = made.orderBy("document_id").collect()
    assert [r["document_id"] for r in rows] == list(range(1, 61)) and [r["topic"] for r in rows] == ["a"] * 30 + ["b"] * 30
    assert rows == corpus(templates.repartition(3), 30, slots, ["ann", "bob"], 5).orderBy("document_id").collect()
    for r in rows[30:]:
        town = r["body"].split()[0]
        assert town in slots["town"] and r["body"].endswith(f"{town} closes.") and r["title"].startswith(f"Plan of {town}")
    assert len({r["body"] for r in rows[30:]}) > 3 and rows[0]["title"] == "Note (A)" and rows[27]["title"] == "Note"
    given = grants(made, ["ann", "bob"], 12).collect()
    owner = {r["document_id"]: r["owner"] for r in rows}
    assert len(given) == 24 and all(owner[g["document_id"]] != g["username"] for g in given)


def test_a_cache_of_the_wrong_length_is_built_anew(spark, tmp_path):
    from docquarry.session import reused

    built = []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    path = str(tmp_path / "cache")
    assert [reused(path, n, build(n), spark).count() for n in (3, 3, 5)] == [3, 3, 5]
    assert built == [3, 5]


def test_keys_are_appended_once(spark, tmp_path):
    from docquarry.sources.files import append_keyed

    path = str(tmp_path / "keyed")
    append_keyed(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string"), path, "k")
    append_keyed(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), path, "k")
    append_keyed(spark.createDataFrame([], "k int, v string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_intermediates_are_deleted(spark):
    import os

    from docquarry.session import drop_materialised, materialise, release

    kept, dropped = materialise(spark.range(3), "kept"), materialise(spark.range(3), "dropped")
    at = [df._written_to.removeprefix("file://") for df in (kept, dropped)]
    drop_materialised(dropped)
    assert [os.path.exists(x) for x in at] == [True, False] and kept.count() == 3
    release(spark)
    assert not os.path.exists(at[0])
