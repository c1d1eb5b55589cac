"""Readers, sinks and streams on small files."""

import datetime as dt

from pyspark.sql import functions as F

from granary.sources import readers as R
from granary.sources import sinks as W
from granary.streaming import ingest as I

BIB = """@article{roe2020,
  title = {A {Title} of sorts},
  author = {Roe, Ann and Bob Doe},
  year = {2020},
  pmid = {123},
  keywords = {one; two, three}
}
@book{x,
  title = "Other",
}
"""


def test_bibliography_round_trip(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    rows = {r.key: r for r in R.bibliography(spark, str(tmp_path / "a.bib")).collect()}
    assert rows["roe2020"].authors == ["Ann Roe", "Bob Doe"] and rows["roe2020"].id == "123" and rows["roe2020"].year == 2020
    assert rows["roe2020"].keywords == ["one", "two", "three"] and rows["x"].title == "Other" and rows["x"].id == "x"
    df = spark.createDataFrame([("k", "T", None)], "key string, title string, doi string")
    assert df.select(W.bibtex(F.col("key"), {"title": F.col("title"), "doi": F.col("doi")})).first()[0] == "@article{k,\n  title = {T}\n}"


def test_articles_and_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "title": "x", "authors": ["q"]}]')
    (tmp_path / "b.json").write_text('{"articles": [{"id": "2"}]}')
    assert sorted(r.id for f in "ab" for r in R.articles_json(spark, str(tmp_path / f"{f}.json")).collect()) == ["1", "2"]
    (tmp_path / "ids.txt").write_text("PMID: 12345\nhttps://h.org/23456/\n34567\nnone 99\n12345")
    assert sorted(r.id for r in R.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["12345", "23456", "34567"]


def test_html_pages(spark):
    html = "<html><head><title>T &amp; t</title><meta name='description' content='D'></head><body><h1>One<p>text <a href='/u'>link</a><script>var x = '</p><b>no';</script><pre>" + "c" * 60 + "</pre>"
    rows = {r.page_id: r for r in R.html_pages(spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")).collect()}
    assert rows[1].title == "T & t" and rows[1].description == "D" and rows[1].n_code == 1 and rows[1].links[0].url == "/u"
    assert "no" not in rows[1].content.split() and rows[2].content == "" and rows[3].n_words == 0


def test_xml_records_and_lookup(spark):
    xml = "<r><PMID>7</PMID><Title>T</Title><Author><LastName>Roe</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Team</CollectiveName></Author></r>"
    rec = R.xml_records(spark.createDataFrame([(xml,)], "x string"), "x").select("record.PMID", R.record_authors(F.col("record.Author")).alias("a")).first()
    assert rec.PMID == "7" and rec.a == ["Ann Roe", "Team"]
    df = spark.createDataFrame([("a", "u1", "5"), ("b", "u2", "a")], "id string, url string, pmid string")
    assert R.by_any_id(df, "a").first().id == "a" and R.by_any_id(df, "PMID5").first().id == "a" and R.by_any_id(df, "zz").count() == 0
    assert R.choose_language(spark.createDataFrame([(1, "fr", "f"), (1, "de", "d"), (2, "en", "e"), (2, "fr", "f")], "k int, l string, t string"), "k", "l", "t", ["en", "de"]).orderBy("k").collect() == [(1, "d"), (2, "e")]
    assert R.existing_keys(df, ["id", "pmid"]).count() == 3 and R.sample_exactly(df, "id", 1).count() == 1


def test_ingest_keeps_the_first_of_each_key(spark, tmp_path):
    schema = "k string, seq int, v string"
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    spark.createDataFrame([("a", 1, "x"), ("a", 0, "first"), ("b", 2, "y")], schema).coalesce(1).write.parquet(src)
    stream = lambda: I.files(spark, src, spark.createDataFrame([], schema).schema, per_trigger=1)
    I.ingest(stream(), out, chk, "k", ["seq"])
    spark.createDataFrame([("a", 9, "late"), ("c", 3, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    I.ingest(stream(), out, chk, "k", ["seq"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", "first"), ("b", "y"), ("c", "z")]
    spark.createDataFrame([("c", 1, "again"), ("d", 1, "new"), (None, 1, "no key"), (None, 2, "none either")], schema).coalesce(1).write.mode("append").parquet(src)
    I.ingest(stream(), out, f"{chk}2", "k", ["seq"])  # another run over the same target: what is there stays, and counts as history
    assert sorted((r.k or "", r.v) for r in spark.read.parquet(out).collect()) == [("", "no key"), ("", "none either"), ("a", "first"), ("b", "y"), ("c", "z"), ("d", "new")]


def test_windows_in_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "e", 1.0) for m in (0, 5, 59)] + [(dt.datetime(2024, 1, 1, 5, 0), "e", 2.0)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(str(tmp_path / "in"))
    q = I.tumbling(I.unique_within(stream, ["ts"], "ts", "10 minutes"), "ts", "1 hour", ["kind"]).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("w").collect()] == [(3, 3.0)]
    assert I.sessions(spark.createDataFrame(rows, "ts timestamp, kind string, value double"), "ts", "30 minutes", ["kind"]).count() == 3
