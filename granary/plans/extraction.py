"""Queries of facts extracted from READMEs, transcripts, threads and documentation pages, over documents and parts written as such texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as E
from granary.functions import text as T
from granary.plans.registry import query, table

#: A README of a part: an even size has badges, code and a licence, one divisible by three installs by conda as well.
_README = ("# ", "\n\npip install ", "\n", "conda install x\n", "## Usage\n```r\nrun()\n```\n![b](https://b.org/s.svg)\nMIT License, mail ann@x.org\n", "- first ", "\n- second\n| a | b |\n[docs](https://d.org/", ")\n")


def _readme() -> Column:
    name = F.col("p_name")
    even, third = F.when(F.col("p_size") % 2 == 0, F.lit(_README[4])).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.lit(_README[3])).otherwise("")
    return F.concat(F.lit(_README[0]), name, F.lit(_README[1]), F.col("p_type"), F.lit(_README[2]), third, even, F.lit(_README[5]), name, F.lit(_README[6]), F.col("p_partkey").cast("string"), F.lit(_README[7]))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ';Usage' ELSE '' END AS sections, 'pip install ' || p_type || CASE WHEN p_size % 3 = 0 THEN ';conda install x' ELSE '' END AS installs, CASE WHEN p_size % 3 = 0 THEN 'conda' ELSE 'pip' END AS method,
'first ' || p_name || ';second' AS features, CASE WHEN p_size % 2 = 0 THEN 'https://b.org/s.svg' ELSE '' END AS badges, 'https://d.org/' || p_partkey AS links, CASE WHEN p_size % 2 = 0 THEN 'ann@x.org' ELSE '' END AS emails, CASE WHEN p_size % 2 = 0 THEN 'MIT' END AS license,
CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS code_blocks, 1 AS table_rows, round(CASE WHEN p_size % 2 = 0 THEN 0.6 ELSE 0.3 END, 6) AS quality FROM part""")
def readme_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, installs, features, badges, links, contact, licence, code, tables and quality of READMEs."""
    p = table(spark, sf_dir, "part").select("p_partkey", _readme().alias("t")).withColumn("f", E.readme_facts(F.col("t")))
    lists = [F.array_join(f"f.{c}", ";").alias(c) for c in ("sections", "installs", "features", "badges", "links", "emails")]
    return p.select("p_partkey", *lists, "f.method", "f.license", "f.code_blocks", "f.table_rows", F.round(E.readme_quality(F.col("f"), F.length("t")), 6).alias("quality"))


@query("""SELECT p_partkey, '10.1000/' || p_partkey || ';10.2000/x' AS dois, 'v' || p_size AS version, 'run(' || p_name || ');' || 'https://a.org' AS calls FROM part""")
def cited_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, a version and calls named in running text."""
    t = F.concat(F.lit("see doi 10.1000/"), F.col("p_partkey").cast("string"), F.lit(" and 10.2000/x twice 10.2000/x, version: v"), F.col("p_size").cast("string"), F.lit(" run("), "p_name", F.lit(") https://a.org"))
    p = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    dois = F.array_join(E.all_matches(F.col("t"), [r"(10\.\d{4,}/\w+)"]), ";")
    version = E.first_match(F.col("t"), [r"release (v\d+)", r"version: (v\d+)"])
    calls = F.array_join(E.all_matches(F.col("t"), [r"(run\([^)]*\))", r"(https?://\S+)"], most=3), ";")
    return p.select("p_partkey", dois.alias("dois"), version.alias("version"), calls.alias("calls"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'tutorial|guide|how[-\\s]?to|getting[-\\s]?started|quickstart') THEN 'tutorial'
WHEN regexp_matches(t, 'api|reference|specification|interface') THEN 'api'
WHEN regexp_matches(t, 'install|setup|configuration|deploy') THEN 'installation'
WHEN regexp_matches(t, 'concept|overview|introduction|about') THEN 'concept'
WHEN regexp_matches(t, 'faq|frequently[-\\s]?asked|questions') THEN 'faq'
WHEN regexp_matches(t, 'troubleshoot|debug|error|issue|problem') THEN 'troubleshooting'
WHEN regexp_matches(t, 'example|sample|demo|use[-\\s]?case') THEN 'example'
WHEN regexp_matches(t, 'best[-\\s]?practice|recommendation|guideline') THEN 'best_practice'
ELSE 'reference' END AS doc_type,
CASE WHEN CAST(contains(l, 'th') AS INT) + CAST(contains(l, 'sch') AS INT) >= 2 THEN 'advanced' WHEN CAST(contains(l, 'the') AS INT) + CAST(contains(l, 'and') AS INT) >= 2 THEN 'beginner' ELSE 'intermediate' END AS complexity
FROM (SELECT doc_id, lower(source || ' ' || CASE doc_id % 4 WHEN 0 THEN 'guide' WHEN 1 THEN 'faq' WHEN 2 THEN 'api' ELSE '' END || ' ' || substr(text, 1, 1000)) AS t, lower(text) AS l FROM documents)""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a documentation page and how hard it is."""
    k = F.col("doc_id") % 4
    url = F.when(k == 0, "guide").when(k == 1, "faq").when(k == 2, "api").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", E.doc_type(F.col("source"), url, F.col("text")).alias("doc_type"), E.complexity(F.col("text"), ["th", "sch"], ["the", "and"]).alias("complexity"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: true) AS s FROM documents), n AS (SELECT doc_id, list_filter(list_transform(s, lambda x, i: {'i': i - 1, 'x': substr(x, 1, 1000)}), lambda e: length(e.x) > 50)[1:20] AS s FROM p)
SELECT doc_id, len(s) AS segments, coalesce(list_sum(list_transform(s, lambda e: e.i)), 0)::BIGINT AS places, coalesce(list_sum(list_transform(s, lambda e: length(e.x))), 0)::BIGINT AS chars FROM n""")
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a transcript with their places."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.segments(F.replace("text", F.lit(". "), F.lit(".\n\n"))).alias("s"))

    def total(f) -> Column:
        return F.aggregate("s", F.lit(0).cast("long"), lambda acc, e: acc + f(e))

    return d.select("doc_id", F.size("s").cast("long").alias("segments"), total(lambda e: e["index"]).alias("places"), total(lambda e: F.length(e["text"])).alias("chars"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'licens') OR contains(lower(text), 'copyright') THEN 'law' END, CASE WHEN contains(lower(text), 'th') THEN 'english' END, CASE WHEN contains(lower(text), 'sch') THEN 'german' END], lambda x: x IS NOT NULL), ',') AS topics FROM documents""")
def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by any of their words (X11)."""
    words = {"law": ["licens", "copyright"], "english": ["th"], "german": ["sch"]}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.topics(F.col("text"), words), ",").alias("topics"))


@query("""SELECT p_partkey, p_name || ' & <b> "x"' AS cleaned, CASE WHEN contains(p_name, ' ') THEN '"' || p_name || '"' ELSE p_name END AS quoted, lower(p_name || ' ' || p_type || ' ' || p_brand) AS searchable, CASE WHEN length(p_name || p_brand) > 12 THEN substr(p_name || p_brand, 1, 9) || '...' ELSE p_name || p_brand END AS short FROM part""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and entities out, query terms in quotes, one searchable text, and a shortened one."""
    dirty = F.concat(F.lit(" <p>"), "p_name", F.lit(" &amp; &lt;b&gt;\n&quot;x&quot;</p> "))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.clean(dirty).alias("cleaned"), T.quoted(F.col("p_name")).alias("quoted"), T.searchable(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("searchable"), E.shortened(F.concat("p_name", "p_brand"), 12).alias("short"))


@query("""WITH t AS (SELECT conv_id, list(text ORDER BY turn)[1:5] AS b FROM conversations GROUP BY 1), f AS (SELECT conv_id, list_filter(list_transform(b, lambda x: list_filter(list_transform(regexp_split_to_array(x, '[.!?\\n]+'), lambda s: trim(s, ' ')), lambda s: length(s) >= 30)[1]), lambda x: x IS NOT NULL) AS f FROM t)
SELECT conv_id, least(5, len(list_distinct(list_concat(['title'], f)))) AS n FROM f""")
def thread_key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title and the first long sentence of each of the first posts."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    points = E.key_points(F.lit("title"), F.transform("t", lambda x: x["text"]))
    return c.select("conv_id", F.size(points).cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN rpad('d', 60, 'd') ELSE substr(array_to_string(list_filter(list_transform(string_split_regex(replace(replace(replace(substr(text, 1, 2000), '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), '\\x01'), lambda x: trim(x, ' ')), lambda x: length(x) > 0)[1:3], ' '), 1, 500) END AS summary FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description that is long enough, else the first sentences."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return d.select("doc_id", E.summary(F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("d"), F.lit(60))), F.col("text")).alias("summary"))


@query("""SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS x) WHERE length(trim(x, ' ')) > 60) AS sections FROM documents""")
def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a text by its lines."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 60)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("sections"))
