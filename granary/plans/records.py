"""Queries of the readers, normalisers, keyed tables and dates, over parts, customers and orders written as raw records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as E
from granary.operators import linking as K
from granary.operators import normalize as N
from granary.operators import review as V
from granary.plans.registry import query, table
from granary.session import shared_folder
from granary.sources import readers as R
from granary.sources import sinks


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p[1:]) if isinstance(p, str) and p[:1] == "'" else F.col(p).cast("string") if isinstance(p, str) else p for p in parts))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS url, lang AS pmid FROM documents WHERE doc_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by any of its ids, with a prefix or without (SC2)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("url"), F.col("lang").alias("pmid"))
    return R.by_any_id(d, "PMID:17")


@query("SELECT DISTINCT CAST(k AS VARCHAR) AS key FROM (SELECT unnest([o_orderkey, o_custkey]) AS k FROM orders)")
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of several id columns (SC6)."""
    return R.existing_keys(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query()
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of rows by a seeded hash (SC5)."""
    return R.sample_exactly(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 25)


@query("WITH g AS (SELECT source, lang, max(n_chars) AS v FROM documents GROUP BY ALL) SELECT source, arg_min(v, CASE lang WHEN 'fr' THEN '1' WHEN 'en' THEN '2' ELSE '3' END || lang) AS n_chars FROM g GROUP BY 1")
def chosen_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the first language of an order of preference, else any (SC15)."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.max("n_chars").alias("n_chars"))
    return R.choose_language(d, "source", "lang", "n_chars", ["fr", "en"])


@query("SELECT 'part' || p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'part' || p_partkey END AS id, p_name AS title, CAST(1990 + p_size AS INT) AS year, p_brand || ' Doe;Ann ' || p_type AS authors, 'a;' || p_name AS keywords FROM part")
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX texts parsed, with people in either form (SC23, SC24, AR-3)."""
    own = F.when(F.col("p_size") % 2 == 0, _text("'  pmid = {", "p_partkey", "'},\n")).otherwise("")
    text = _text("'@article{part", "p_partkey", "',\n  title = {", "p_name", "'},\n  author = {Doe, ", "p_brand", "' and Ann ", "p_type", "'},\n", own, "'  year = {", F.col("p_size") + 1990, "'},\n  keywords = {a; ", "p_name", "'}\n}\n")
    found = R.bibliography_of(table(spark, sf_dir, "part").select(text.alias("value")))
    return found.select("key", "id", "title", "year", F.array_join("authors", ";").alias("authors"), F.array_join("keywords", ";").alias("keywords"))


@query("SELECT '@article{p' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '}' || CASE WHEN p_size % 2 = 0 THEN ',' || chr(10) || '  year = {' || p_size || '}' ELSE '' END || chr(10) || '}' AS entry FROM part")
def bibliography_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX entries of the fields that have a value (SK16)."""
    entry = sinks.bibtex(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), {"title": F.col("p_name"), "year": F.when(F.col("p_size") % 2 == 0, F.col("p_size"))})
    return table(spark, sf_dir, "part").select(entry.alias("entry"))


@query("SELECT CAST(1000000 + o_orderkey AS VARCHAR) AS id FROM orders UNION SELECT CAST(2000000 + o_custkey AS VARCHAR) FROM orders UNION SELECT CAST(3000000 + o_custkey AS VARCHAR) FROM orders")
def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in three forms from running text (SC25)."""
    text = _text("'PMID: ", F.col("o_orderkey") + 1000000, "' see https://example.org/x/", F.col("o_custkey") + 2000000, "' end\n", F.col("o_custkey") + 3000000)
    return R.ids_of(table(spark, sf_dir, "orders").select(text.alias("value")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS INT) AS year FROM part")
def json_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from JSON lists and objects (SC26)."""
    one = F.to_json(F.array(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))))
    text = F.when(F.col("p_size") % 2 == 0, one).otherwise(F.concat(F.lit('{"articles":'), one, F.lit("}")))
    return R.articles_of(table(spark, sf_dir, "part").select(text.alias("value"))).select("id", "title", "year")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, 'first part ' || c_mktsegment AS abstract, 'Ann ' || c_mktsegment || ';Group of ' || c_nationkey AS authors FROM customer")
def xml_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML records parsed, with people and groups (SC8, SC9, SC31, X9)."""
    text = _text("'<PubmedArticle><PMID>", "c_custkey", "'</PMID><Title>", "c_name", "'</Title><Abstract>first part</Abstract><Abstract>", "c_mktsegment", "'</Abstract><Author><LastName>", "c_mktsegment", "'</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Group of ", "c_nationkey", "'</CollectiveName></Author></PubmedArticle>")
    found = R.xml_records(table(spark, sf_dir, "customer").select(text.alias("x")), "x").select("record.*")
    return found.select(F.col("PMID").alias("id"), F.col("Title").alias("title"), F.array_join("Abstract", " ").alias("abstract"), F.array_join(R.record_authors(F.col("Author")), ";").alias("authors"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name || ' goes on' AS title, p_type AS abstract, 'Doe, ' || p_brand || ';Roe, B' AS authors, CASE p_size % 3 WHEN 0 THEN '10.1/a' || p_partkey WHEN 1 THEN '10.2/l' || p_partkey ELSE '10.3/s' || p_partkey END AS doi, make_date(1990 + p_size, 3, 5) AS published FROM part""")
def tagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged records with fields over several lines and three places of a doi (SC10, Z10, D-2)."""
    kind = F.col("p_size") % 3
    place = F.when(kind == 0, _text("'AID - S1 [pii]\nAID - 10.1/a", "p_partkey", "' [doi]\nLID - 10.9/x [doi]\n")).when(kind == 1, _text("'LID - 10.2/l", "p_partkey", "' [doi]\n")).otherwise("")
    text = _text("'PMID- ", "p_partkey", "'\nTI  - ", "p_name", "'\n      goes on\nAB  - ", "p_type", "'\nFAU - Doe, ", "p_brand", "'\nFAU - Roe, B\nDP  - ", F.col("p_size") + 1990, "' Mar 5\n", place, "'SO  - Journal. 1999 doi: 10.3/s", "p_partkey", "'.\n")
    found = table(spark, sf_dir, "part").select(R.medline(text).alias("m")).select("m.*")
    return found.select("pmid", "title", "abstract", F.array_join("authors", ";").alias("authors"), "doi", E.loose_date(F.col("date")).alias("published"))


@query("SELECT page_id, 'https://x.org/docs/intro' || page_id || '.html,https://y.org/a.html' AS links FROM pages")
def contents_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a Markdown table of contents as absolute addresses (SC22)."""
    text = _text("'* [One](intro", "page_id", "'.md)\n* [Two](https://y.org/a.md)\n* [Again](/intro", "page_id", "'.md)")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(R.toc_links(text, "https://x.org/docs/"), ",").alias("links"))


@query("""WITH p AS (SELECT *, p_size % 4 AS k FROM part) SELECT CAST(p_partkey AS VARCHAR) AS id, 'https://example.org/article/' || p_partkey || '/' AS url, p_name AS title, p_brand || ' Doe' AS authors, CAST(k AS INT) AS cited_by, CAST(k AS BIGINT) AS citation_count, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS subjects, 'pending' AS approval_status FROM p""")
def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as rows of the content table."""
    k = (F.col("p_size") % 4).cast("int")
    cited = F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), k), lambda x: x.cast("string"))
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit("PMID:"), F.col("p_partkey").cast("string")).alias("pmid"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("Doe, "), "p_brand")).alias("authors"), cited.alias("cited_by"), F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit("")).alias("mesh_terms"))
    out = N.articles(raw)
    return out.select("id", "url", "title", F.array_join("authors", ";").alias("authors"), F.col("citations.cited_by_count").alias("cited_by"), "metrics.citation_count", F.array_join("mesh_terms", ";").alias("subjects"), "approval_status")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS content, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_brand || ';Ann' END AS authors, CAST(p_size AS BIGINT) AS view_count FROM part")
def video_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos as rows of the content table: the transcript, else the description."""
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("description"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("transcript"), F.col("p_brand").alias("channel_name"), F.when(F.col("p_size") % 3 != 0, "Ann").alias("presenter"), F.col("p_size").cast("long").alias("view_count"))
    return N.videos(raw).select("id", "content", F.array_join("authors", ";").alias("authors"), "metrics.view_count")


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (SELECT l_partkey, list_transform(list_sort(list(l_suppkey))[1:5], lambda x: CAST(x AS VARCHAR)) AS others FROM s GROUP BY 1)
SELECT CAST(l_partkey AS VARCHAR) AS id, array_to_string(list_concat(['owner'], others), ';') AS authors, CAST(l_partkey % 7 AS BIGINT) AS bookmark_count FROM c""")
def repository_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories as rows of the content table: the owner and the first five contributors (P5, SC33)."""
    c = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("s"))
    raw = c.select(F.col("l_partkey").cast("string").alias("repo_id"), F.lit("owner").alias("owner"), F.transform("s", lambda x: x.cast("string")).alias("contributors"), (F.col("l_partkey") % 7).alias("stars"))
    return N.repositories(raw).select("id", F.array_join("authors", ";").alias("authors"), "metrics.bookmark_count")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'video' WHEN event_type = 'view' THEN 'repository' WHEN value > 50 THEN 'discussion' ELSE 'article' END AS content_type FROM events")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type by source, else by a field's presence, else article."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.when(F.col("value") > 50, 1).alias("reply_count"))
    return e.select("event_id", N.content_type(e, {"click": "video", "view": "repository"}, [("reply_count", "discussion")]).alias("content_type"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, c_acctbal AS balance FROM customer")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with some fields of some rows replaced; null changes leave what was there (SK4, SK5, SK14, SK15)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    changes = c.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "new").alias("name"), F.lit(None).cast("double").alias("balance"))
    return V.patch(c, changes, ["name", "balance"])


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01')")
def retained_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when old rejected rows are deleted (SK6)."""
    o = table(spark, sf_dir, "orders")
    return V.delete_where(o, (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'success' END AS outcome FROM documents")
def action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids of a bulk action are there (SK11, SK12)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return V.outcomes(d, d.where("id % 4 <> 0"))


@query("SELECT doc_id AS id, source, CAST(length(text) % 10 / 10.0 AS DOUBLE) / 2 + 0.25 AS final_score, 'a' AS approved_by FROM documents WHERE doc_id % 2 = 0")
def approved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rows of approved ids: no workflow fields, the mean of both scores (SK8, Z27)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", (F.length("text") % 10 / 10.0).alias("ml_score"), F.lit(0.5).alias("ai_confidence"), F.array(F.lit("x")).alias("categories"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reviewer_id"))
    actions = d.select("id", F.when(F.col("id") % 2 == 0, "approve").otherwise("reject").alias("action"), F.lit("a").alias("reviewer"), F.lit(None).cast("array<string>").alias("categories"))
    out = V.approve(d, actions, F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.select("id", "source", "final_score", "approved_by")


@query("SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS language, CASE WHEN doc_id % 3 = 0 THEN 0.4 ELSE 0.35 END AS final_score, 0.5 AS quality_score FROM documents")
def coalesced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older column names under the present one, and default scores."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.col("source").alias("locale"), F.when(F.col("doc_id") % 3 == 0, 0.4).alias("final_score"), F.lit(0.5).alias("ml_score"), F.lit(0.2).alias("ai_confidence"), F.lit(None).cast("double").alias("quality_score"))
    return V.score_defaults(V.coalesced(d, {"language": ["lang", "locale"]})).select("id", "language", "final_score", "quality_score")


@query("SELECT n_nationkey, n_name FROM nation")
def swapped_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a new version, counted, and read by its view (SK13, SK19)."""
    view = f"nations_{uuid.uuid4().hex}"
    V.swap(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{shared_folder(spark)}/{view}", "v2", view)
    return spark.table(view)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN CAST(date_trunc('year', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS published, CAST(year(o_orderdate) AS INT) AS year FROM orders""")
def loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in five forms, and the year named in a text (D-1 to D-4)."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    forms = ("yyyyMMdd", "yyyy-MM-dd", "yyyy MMM d", "yyyy MMM", "yyyy")
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k == i, F.date_format(d, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", E.loose_date(text).alias("published"), E.year_of(_text("'In ", F.year("o_orderdate"), "', or 12345.")).alias("year"))


@query("""WITH s AS (SELECT event_id, CAST(event_id % 9000 AS INT) AS s FROM events) SELECT event_id, s AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS label,
CASE WHEN s * 100 < 3600 THEN (s * 100 // 60) || 'm ago' WHEN s * 100 < 86400 THEN (s * 100 // 3600) || 'h ago' WHEN s * 100 <= 604800 THEN (s * 100 // 86400) || 'd ago' END AS age FROM s""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO durations as seconds, their labels, and ages in words (D-5, D-6, P34)."""
    s = F.col("event_id") % 9000
    text = _text("'PT", F.floor(s / 3600), "'H", F.floor(s % 3600 / 60), "'M", s % 60, "'S")
    e = table(spark, sf_dir, "events").select("event_id", E.duration_seconds(text).alias("seconds"))
    return e.select("event_id", "seconds", E.duration_label(F.col("seconds")).alias("label"), E.relative_age(F.col("seconds") * 100).alias("age"))


@query("SELECT c_custkey, substr('Institute of ' || c_mktsegment || ' ' || c_name, 1, 50) AS organisation FROM customer")
def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations from affiliations."""
    text = _text("'ann@x.org Institute of ", "c_mktsegment", "' ", "c_name", "' 12345-678 Germany, Berlin, Department")
    return table(spark, sf_dir, "customer").select("c_custkey", E.organisation(text).alias("organisation"))


@query("SELECT doc_id AS id, source AS a, CAST(NULL AS BIGINT) AS b FROM documents UNION ALL SELECT c_custkey, NULL, c_nationkey FROM customer")
def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of several sources, missing columns null."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("a"))
    return K.union_sources([d, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("b"))])


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_nationkey < 10 THEN c_name ELSE 'unknown' END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def attached_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A looked-up value, or a default where there is none (J1, SC19)."""
    c = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return K.attach(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "name", F.lit("unknown"))


@query("SELECT p_partkey, p_name || ':' || p_brand || ',B:' || p_type AS people FROM part")
def merged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of people merged by position, empty fields filled from the second."""
    kind = "array<struct<name:string,place:string>>"
    a = F.array(F.struct(F.col("p_name").alias("name"), F.lit("").alias("place")), F.struct(F.lit("B").alias("name"), F.col("p_type").alias("place"))).cast(kind)
    b = F.array(F.struct(F.lit("x").alias("name"), F.col("p_brand").alias("place")), F.struct(F.lit("y").alias("name"), F.lit("z").alias("place"))).cast(kind)
    both = K.merge_positions(a, b, ["name", "place"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(both, lambda p: F.concat_ws(":", p["name"], p["place"])), ",").alias("people"))


@query("WITH e AS (SELECT o_orderkey AS id, o_orderkey // 40 + 1000 AS pmid FROM orders) SELECT a.id AS left_id, b.id AS right_id, 'pmid' AS kind FROM e a JOIN e b ON a.pmid = b.pmid AND a.id <> b.id")
def shared_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that name the same identifier."""
    from granary.functions import text as T

    o = table(spark, sf_dir, "orders").select("o_orderkey", T.identifiers([_text("'PMID: ", F.floor(F.col("o_orderkey") / 40) + 1000)]).alias("i"))
    return K.shared_identifiers(o, "o_orderkey", "i")


@query("""WITH e AS (SELECT o_orderkey AS id, 'pmid' AS kind, CAST(o_orderkey // 40 + 1000 AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'doi', '10.1234/all' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'doi', '10.1234/' || o_orderkey FROM orders WHERE o_orderkey % 3 > 0)
SELECT id, kind, value, min(id) OVER w AS class_id, count(*) OVER w - 1 AS links FROM e WINDOW w AS (PARTITION BY kind, value) QUALIFY count(*) OVER w > 1""")
def identifier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name an identifier that others name too, one of them named by a third of all rows."""
    from granary.functions import text as T

    doi = F.when(F.col("o_orderkey") % 3 == 0, "all").otherwise(F.col("o_orderkey").cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", T.identifiers([_text("'PMID: ", F.floor(F.col("o_orderkey") / 40) + 1000, "' see 10.1234/", doi)]).alias("i"))
    return K.identifier_links(o, "o_orderkey", "i")
