"""Full article records, and files of records read in splits."""

import pytest
from pyspark.sql import functions as F

from granary.sources import articles as A
from granary.sources import readers as R

ONE = """<PubmedArticle><MedlineCitation Status="MEDLINE" IndexingMethod="Manual"><PMID Version="1">77</PMID><DateCompleted><Year>2021</Year><Month>02</Month><Day>3</Day></DateCompleted>
<Article><Journal><ISSN IssnType="Print">1-1</ISSN><JournalIssue><Volume>5</Volume><PubDate><MedlineDate>2023 Nov-Dec</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>On <i>E. coli</i> growth</ArticleTitle><Pagination><StartPage>1</StartPage><EndPage>9</EndPage></Pagination><ELocationID EIdType="doi">10.1/x</ELocationID>
<Abstract><AbstractText Label="AIM">First.</AbstractText><AbstractText>Plain
line &lt;b&gt;bold&lt;/b&gt;.</AbstractText><AbstractText Label="AIM">Last.</AbstractText><AbstractText Label="END"/></Abstract>
<AuthorList><Author EqualContrib="Y"><LastName>Roe</LastName><ForeName>Ann B</ForeName><Identifier Source="ORCID">https://orcid.org/0-1</Identifier><AffiliationInfo><Affiliation>U</Affiliation></AffiliationInfo></Author><Author/><Author><CollectiveName>Team</CollectiveName></Author><Author><LastName>Doe</LastName><Initials>J</Initials></Author></AuthorList>
<Language>fre</Language><ArticleDate DateType="Electronic"><Year>2022</Year><Month>Mar</Month></ArticleDate></Article><ChemicalList><Chemical><RegistryNumber>0</RegistryNumber><NameOfSubstance UI="D9">Salt</NameOfSubstance></Chemical></ChemicalList>
<NumberOfReferences>12</NumberOfReferences></MedlineCitation><PubmedData><History><PubMedPubDate PubStatus="received"><Year>2019</Year></PubMedPubDate><PubMedPubDate PubStatus="received"><Year>2020</Year><Month>1</Month><Day>2</Day></PubMedPubDate></History>
<ArticleIdList><ArticleId IdType="pmc">123</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/other</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"""


def test_all_fields(spark):
    bare = "<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><ArticleTitle>t</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    rows = A.article_records(spark.createDataFrame([(x,) for x in (ONE, "bad", None, "", "<PubmedArticle/>", bare)], "x string"), "x").collect()
    r, empty = sorted(rows, key=lambda r: r.pmid, reverse=True)
    assert len(r) == 37 and len(rows) == 2
    assert (r.id, r.pmc_id, r.doi, r.title, r.year, r.published_date) == ("PMID77", "PMC123", "10.1/x", "On E. coli growth", "2023", "2023-01-01T00:00:00")
    assert r.abstract == "AIM: First. Plain line bold. AIM: Last. END:" and r.abstract_sections == {"AIM": "Last.", "END": ""}
    assert [(a.position, a.name, a.full_name, a.is_collective) for a in r.authors] == [(1, "Roe, Ann B", "Ann B Roe", False), (3, "Team", "Team", True), (4, "Doe J", "Doe J", False)]
    assert r.authors[0].orcid == "0-1" and r.authors[0].affiliation == "U" and r.authors[0].is_equal_contributor and not r.authors[2].is_equal_contributor
    assert (r.electronic_date, r.received_date, r.medline_date, r.print_date, r.pages, r.language, r.reference_count) == ("2022-03-01T00:00:00", "2020-01-02T00:00:00", "2021-02-03T00:00:00", None, "1-9", "fre", 12)
    assert r.chemicals[0].name == "Salt" and r.chemicals[0].ui == "D9" and r.indexing_method == "Manual" and r.has_pmc_full_text
    assert empty.authors == [] and empty.grants == [] and empty.keywords == [] and empty.abstract == "" and empty.abstract_sections == {} and empty.language == "eng" and empty.doi is None and empty.published_date is None and empty.medline_status == "PubMed"


def test_fields_that_are_not_wanted_are_not_parsed(spark):
    bare = "<PubmedArticle><MedlineCitation><PMID>5</PMID><Article/></MedlineCitation></PubmedArticle>"
    rows = spark.createDataFrame([(x,) for x in (ONE, "bad", None, bare)], "x string")
    whole = A.article_records(rows, "x")
    assert tuple(whole.columns) == A.FIELDS
    want = {r.pmid: r for r in whole.collect()}
    for some in (["grants", "has_funding"], ["pmc_url", "author_count"], ["published_date", "journal_info", "doi"], ["url", "language"]):
        got = A.article_records(rows, "x", ["pmid", *some])
        assert got.columns == ["pmid", *some] and {r.pmid: tuple(r) for r in got.collect()} == {k: (k, *(r[f] for f in some)) for k, r in want.items()}
    plan = A.article_records(rows, "x", ["grants"])._jdf.queryExecution().optimizedPlan().toString()
    assert "GrantList" in plan and "AuthorList" not in plan and "PubmedData" not in plan


def test_orders_are_dealt_to_tasks_before_they_are_parsed(spark, monkeypatch):
    from granary.plans import articles as P

    monkeypatch.setattr(P, "TASK_ROWS", 100)
    assert P.article_records(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1500 // 100 + 1  # before: one task a split of the file


@pytest.mark.parametrize(("day", "want"), [(("2020", "3", "4"), "2020-03-04"), (("2020", "Sept", None), "2020-09-01"), (("2020", "Winter", "4"), "2020-01-01"), (("2020", None, "4"), "2020-01-01"), (("2020", "11", ""), "2020-11-01"), ((None, "1", "1"), None), (("", "1", "1"), None)])
def test_days(spark, day, want):
    df = spark.createDataFrame([(day,)], "d struct<Year:string,Month:string,Day:string>")
    assert df.select(A.iso_day(F.col("d"))).first()[0] == (f"{want}T00:00:00" if want else None)


def test_one_file_is_read_in_many_tasks(spark, tmp_path):
    n = 400
    entry = "@article{{k{0},\n  title = {{Title {0} at a@b}},\n  author = {{Roe, Ann and Bob Doe}},\n  year = {{{1}}}\n}}\n\n"
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<PubmedArticleSet>\n' + "\n".join(ONE.replace(">77<", f">{i}<") for i in range(n)) + "\n</PubmedArticleSet>\n")
    (tmp_path / "a.bib").write_text("% a comment\n" + "".join(entry.format(i, 1900 + i % 100) for i in range(n)), newline="\r\n")
    (tmp_path / "a.txt").write_text("\n" + "\n".join(f"PMID- {i}\nTI  - Title {i}\n      goes on\nFAU - Doe, J\n" for i in range(n)))
    (tmp_path / "ids.txt").write_text("".join(f"see PMID: {10000 + i}\nhttps://h.org/{20000 + i}/\n{30000 + i}\n" for i in range(n)))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "8k")
    try:
        xml, tagged = A.article_files(spark, str(tmp_path / "a.xml")), A.tagged_files(spark, str(tmp_path / "a.txt"))
        bib, ids = A.bibliography_files(spark, str(tmp_path / "a.bib")), A.id_files(spark, str(tmp_path / "ids.txt"))
        assert min(xml.rdd.getNumPartitions(), tagged.rdd.getNumPartitions(), bib.rdd.getNumPartitions()) > 2
        assert sorted(int(r.pmid) for r in A.article_records(xml, "value").select("pmid").collect()) == list(range(n))
        records = tagged.select(R.medline(F.col("value")).alias("m")).select("m.pmid", "m.title", "m.authors").collect()
        assert sorted((int(r.pmid), r.title) for r in records) == [(i, f"Title {i} goes on") for i in range(n)] and all(r.authors == ["Doe, J"] for r in records)
        found = sorted((tuple(r[:4]) + (r.year,) for r in bib.collect()), key=str)
        assert found == sorted((tuple(r[:4]) + (r.year,) for r in R.bibliography_of(spark.createDataFrame([("".join(entry.format(i, 1900 + i % 100) for i in range(n)),)], "value string")).collect()), key=str) and len(found) == n
        assert ids.count() == 3 * n
    finally:
        spark.conf.set(size, before)


def test_people_of_full_texts(spark):
    meta = '<contrib contrib-type="author"><name><surname>Roe</surname><given-names>Ann Bea</given-names></name><xref ref-type="aff" rid="a2"/><xref ref-type="aff" rid="a1"><sup>1</sup></xref><xref ref-type="corresp" rid="a1"/></contrib><contrib contrib-type="author"><name/></contrib>'
    text = f'<article><front><article-meta><contrib-group>{meta}</contrib-group><aff id="a1"><label>1</label>Dept &amp; <b>One</b></aff><aff id="a2"/><aff id="a2">\n 2  Two</aff></article-meta></front></article>'
    rows = A.full_text_authors(spark.createDataFrame([(1, text), (2, None), (3, "x"), (4, "<article/>")], "k int, x string"), "k", "x").collect()
    assert [(r.k, r.author.name, r.author.initials) for r in rows] == [(1, "Roe, Ann Bea", "AB")]
    assert "Two" in rows[0].author.affiliation and "One" in rows[0].author.affiliation
