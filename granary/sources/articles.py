"""Full article records (SC9, X8, Z2-Z9, SC31, J17) and files of records that Spark splits (SC9, SC10, SC23-SC25).

A file is cut at the separator of its records by Spark's text source, which finds the first separator after the start of a byte range;
so one large file is read in many tasks, in any store, and no task holds more than a record. All else is Columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import clean
from granary.sources.readers import bibliography_of, ids_of

# The format's elements, tags inside running text, and the addresses of records.
_DAY = "Year:string, Month:string, Day:string"
RECORD = f"""
MedlineCitation struct<_Status:string, _IndexingMethod:string, PMID:string, DateCompleted:struct<{_DAY}>, DateRevised:struct<{_DAY}>,
  Article:struct<
    Journal:struct<ISSN:array<struct<_IssnType:string, _VALUE:string>>, JournalIssue:struct<Volume:string, Issue:string, PubDate:struct<{_DAY}, MedlineDate:string>>, Title:string, ISOAbbreviation:string>,
    ArticleTitle:string, VernacularTitle:string, Pagination:struct<MedlinePgn:string, StartPage:string, EndPage:string>,
    ELocationID:array<struct<_EIdType:string, _VALUE:string>>, Abstract:struct<AbstractText:array<struct<_Label:string, _VALUE:string>>>,
    AuthorList:struct<Author:array<struct<_EqualContrib:string, LastName:string, ForeName:string, Initials:string, CollectiveName:string, Identifier:array<struct<_Source:string, _VALUE:string>>, AffiliationInfo:array<struct<Affiliation:string>>>>>,
    Language:array<string>, GrantList:struct<Grant:array<struct<GrantID:string, Acronym:string, Agency:string, Country:string>>>,
    PublicationTypeList:struct<PublicationType:array<string>>, ArticleDate:array<struct<_DateType:string, {_DAY}>>>,
  MedlineJournalInfo:struct<Country:string, MedlineTA:string, NlmUniqueID:string>,
  ChemicalList:struct<Chemical:array<struct<RegistryNumber:string, NameOfSubstance:struct<_UI:string, _VALUE:string>>>>,
  MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_UI:string, _MajorTopicYN:string, _VALUE:string>, QualifierName:array<struct<_UI:string, _MajorTopicYN:string, _VALUE:string>>>>>,
  NumberOfReferences:string, KeywordList:array<struct<Keyword:array<string>>>>,
PubmedData struct<History:struct<PubMedPubDate:array<struct<_PubStatus:string, {_DAY}>>>, ArticleIdList:struct<ArticleId:array<struct<_IdType:string, _VALUE:string>>>>"""
FULL_TEXT = """
front struct<`article-meta`:struct<`contrib-group`:array<struct<contrib:array<struct<
  `_contrib-type`:string, name:array<struct<surname:string, `given-names`:string>>, collab:array<string>,
  `contrib-id`:array<struct<`_contrib-id-type`:string, _VALUE:string>>, aff:array<string>, xref:array<struct<`_ref-type`:string, _rid:string>>>>>>>>"""
#: The elements that a field of a record is made of, and the field that another is derived from.
_C, _A, _P = "MedlineCitation", "MedlineCitation.Article", "PubmedData"
_PRINTED, _OTHER, _HISTORY, _IDS = f"{_A}.Journal.JournalIssue.PubDate", f"{_A}.ArticleDate", f"{_P}.History", f"{_P}.ArticleIdList"
ELEMENTS = {
    "pmc_id": (_IDS,), "doi": (f"{_A}.ELocationID", _IDS), "vernacular_title": (f"{_A}.VernacularTitle",), "abstract": (f"{_A}.Abstract",), "abstract_sections": (f"{_A}.Abstract",), "authors": (f"{_A}.AuthorList",),
    "journal": (f"{_A}.Journal.Title",), "journal_info": (f"{_A}.Journal.Title", f"{_A}.Journal.ISOAbbreviation", f"{_A}.Journal.ISSN", f"{_C}.MedlineJournalInfo"), "year": (f"{_PRINTED}.Year", f"{_PRINTED}.MedlineDate"),
    "published_date": (_PRINTED, _OTHER, _HISTORY), "electronic_date": (_OTHER,), "print_date": (_OTHER,), "received_date": (_HISTORY,), "accepted_date": (_HISTORY,), "revised_date": (f"{_C}.DateRevised",), "pubmed_date": (_HISTORY,), "medline_date": (f"{_C}.DateCompleted",),
    "volume": (f"{_A}.Journal.JournalIssue.Volume",), "issue": (f"{_A}.Journal.JournalIssue.Issue",), "pages": (f"{_A}.Pagination",), "keywords": (f"{_C}.KeywordList",), "mesh_terms": (f"{_C}.MeshHeadingList",), "publication_types": (f"{_A}.PublicationTypeList",),
    "chemicals": (f"{_C}.ChemicalList",), "language": (f"{_A}.Language",), "grants": (f"{_A}.GrantList",), "reference_count": (f"{_C}.NumberOfReferences",), "medline_status": (f"{_C}._Status",), "indexing_method": (f"{_C}._IndexingMethod",),
}
FIELDS = tuple(
    (
        "id pmid pmc_id doi title vernacular_title abstract abstract_sections authors author_count journal journal_info year published_date electronic_date print_date received_date accepted_date revised_date "
        "pubmed_date medline_date volume issue pages keywords mesh_terms publication_types chemicals language grants has_funding reference_count url medline_status indexing_method has_pmc_full_text pmc_url"
    ).split()
)
DERIVED = {"author_count": "authors", "has_funding": "grants", "has_pmc_full_text": "pmc_id", "pmc_url": "pmc_id"}
INLINE = r"</?(?:i|b|u|sup|sub|sc|em|strong|italic|bold|mml:[A-Za-z]+)(?:\s[^>]*)?/?>"
AFFILIATION_PARTS = r"</?(?:label|institution|institution-wrap|institution-id|addr-line|city|state|country|postal-code|named-content|email|ext-link|break)(?:\s[^>]*)?/?>"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ARTICLE_URL = "https://pubmed.ncbi.nlm.nih.gov/"
FULL_TEXT_URL = "https://www.ncbi.nlm.nih.gov/pmc/articles/"


def _blank(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def _every(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def _named(rows: Column, attribute: str, value: str) -> Column:
    """The elements whose attribute has the value, an empty array for none."""
    return F.coalesce(F.filter(rows, lambda x: x[attribute] == value), F.slice(rows, 1, 0))


def iso_day(day: Column) -> Column:
    """A day of year, month (number or name) and day as text; what is missing is the first, and a month that is none takes its day along."""
    month = _blank(day["Month"])
    number = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(month, F.lit(3)))), F.lit(0)).cast("string")
    month = F.when(month.rlike("^[0-9]+$"), month).otherwise(number)

    def two(part: Column) -> Column:
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    rest = F.when(month.isNull(), "01-01").otherwise(F.concat(two(month), F.lit("-"), F.coalesce(two(_blank(day["Day"])), F.lit("01"))))
    return F.when(_blank(day["Year"]).isNotNull(), F.concat(day["Year"], F.lit("-"), rest, F.lit("T00:00:00")))


def _orcid(identifiers: Column, attribute: str, value: str) -> Column:
    """The first such identifier without its address."""
    return F.substring_index(F.get(_named(identifiers, attribute, value), F.lit(0))["_VALUE"], "orcid.org/", -1)


def _person(position: Column, last: Column, first: Column, initials: Column, group: Column, affiliation: Column, orcid: Column, equal: Column) -> Column:
    """One author; name is null where there is none."""
    last, first, initials, group = (F.coalesce(c, F.lit("")) for c in (last, first, initials, group))
    short = F.when(initials != "", F.concat_ws(" ", last, initials)).otherwise(last)
    name = F.when((last != "") & (first != ""), F.concat_ws(", ", last, first)).when(last != "", short).otherwise(_blank(group))
    full = F.when((last != "") & (first != ""), F.concat_ws(" ", first, last)).otherwise(name)
    return F.struct(
        position.alias("position"), last.alias("last_name"), first.alias("first_name"), initials.alias("initials"), name.alias("name"), full.alias("full_name"),
        ((last == "") & (group != "")).alias("is_collective"), affiliation.alias("affiliation"), orcid.alias("orcid"), equal.alias("is_equal_contributor"),
    )


def _authors(listed: Column) -> Column:
    """Authors with a name, each with its place in the whole list."""

    def one(a: Column, i: Column) -> Column:
        affiliation = F.get(a["AffiliationInfo"], F.lit(0))["Affiliation"]
        return _person((i + 1).cast("int"), a["LastName"], a["ForeName"], a["Initials"], a["CollectiveName"], affiliation, _orcid(a["Identifier"], "_Source", "ORCID"), F.coalesce(a["_EqualContrib"] == "Y", F.lit(False)))

    found = F.filter(F.transform(listed, one), lambda p: p["name"].isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<position:int,last_name:string,first_name:string,initials:string,name:string,full_name:string,is_collective:boolean,affiliation:string,orcid:string,is_equal_contributor:boolean>>"))


def _narrowed(schema: T.StructType, wanted: Sequence[str]) -> T.StructType:
    """The schema with the wanted paths and what lies below them alone."""
    out = T.StructType()
    for f in schema.fields:
        below = [w[len(f.name) + 1 :] for w in wanted if w == f.name or w.startswith(f"{f.name}.")]
        if below:
            out.add(f.name, f.dataType if "" in below else _narrowed(f.dataType, below))
    return out


def article_records(rows: DataFrame, xml: str, fields: Sequence[str] | None = None) -> DataFrame:
    """The 37 fields of each article's XML (SC9, X8, X9, Z2-Z9), or those named: the parser makes only the elements these need, as each costs it more than reading over it.

    Rows that are null, don't parse, or have no citation, id or article are left out. Tags inside running text are taken out first, so that
    titles and abstracts are whole. A doi or full-text id is the article's own, never one of its references. No list is null.
    """
    record = T.StructType.fromDDL(RECORD)
    if fields is not None:
        base = {DERIVED.get(f, f) for f in fields}
        record = _narrowed(record, [f"{_C}.PMID", f"{_A}.ArticleTitle", *(e for f in base for e in ELEMENTS.get(f, ()))])
    # inline keeps filters and fields from parsing again: Spark would copy the parser into each.
    parsed = rows.select(F.inline(F.array(F.from_xml(F.regexp_replace(xml, INLINE, ""), record)))).where("MedlineCitation.PMID <> '' AND MedlineCitation.Article IS NOT NULL")
    parsed = parsed.select(F.col("MedlineCitation").alias("m"), F.col("MedlineCitation.Article").alias("a"), *([F.col("PubmedData").alias("p")] if "PubmedData" in record.names else []))
    m, a, p = F.col("m"), F.col("a"), F.col("p")
    ids = p["ArticleIdList"]["ArticleId"]
    journal, issue, more = a["Journal"], a["Journal"]["JournalIssue"], m["MedlineJournalInfo"]

    def own(rows: Column, attribute: str, value: str) -> Column:
        return F.get(_named(rows, attribute, value), F.lit(0))["_VALUE"]

    def history(status: str) -> Column:  # the last of a status counts
        return iso_day(F.try_element_at(F.filter(_named(p["History"]["PubMedPubDate"], "_PubStatus", status), lambda d: d["Year"] != ""), F.lit(-1)))

    # Sections, journal, dates.
    texts = F.filter(a["Abstract"]["AbstractText"], lambda t: (F.coalesce(t["_Label"], F.lit("")) != "") | (F.coalesce(t["_VALUE"], F.lit("")) != ""))
    labelled = F.filter(texts, lambda t: t["_Label"] != "")
    lines = F.transform(texts, lambda t: F.when(t["_Label"] != "", F.concat(t["_Label"], F.lit(": "), F.coalesce(t["_VALUE"], F.lit("")))).otherwise(t["_VALUE"]))
    # Of sections with one label the last counts: map keys must differ, so earlier ones are left out.
    labels = F.transform(labelled, lambda t: t["_Label"])
    last = F.filter(labelled, lambda t, i: ~F.array_contains(F.slice(labels, i + 2, F.size(labels)), t["_Label"]))
    sections = F.map_from_entries(F.transform(last, lambda t: F.struct(t["_Label"], F.coalesce(t["_VALUE"], F.lit("")))))
    print_day = issue["PubDate"]
    year = F.coalesce(_blank(print_day["Year"]), _blank(F.regexp_extract(F.coalesce(print_day["MedlineDate"], F.lit("")), r"(\d{4})", 1)))
    other = F.get(a["ArticleDate"], F.lit(0))
    electronic = F.coalesce(other["_DateType"], F.lit("Electronic")) == "Electronic"
    electronic_day, paper_day, indexed = F.when(electronic, iso_day(other)), F.when(~electronic, iso_day(other)), history("pubmed")
    published = iso_day(F.struct(year.alias("Year"), print_day["Month"].alias("Month"), print_day["Day"].alias("Day")))
    info = F.struct(
        journal["Title"].alias("title"), journal["ISOAbbreviation"].alias("iso_abbreviation"), F.try_element_at(_named(journal["ISSN"], "_IssnType", "Electronic"), F.lit(-1))["_VALUE"].alias("issn_electronic"),
        F.try_element_at(_named(journal["ISSN"], "_IssnType", "Print"), F.lit(-1))["_VALUE"].alias("issn_print"), more["Country"].alias("country"), more["MedlineTA"].alias("medline_ta"), more["NlmUniqueID"].alias("nlm_unique_id"),
    )

    # Subjects, substances, funding.
    def qualifier(q: Column) -> Column:
        return F.struct(q["_VALUE"].alias("name"), F.coalesce(q["_UI"], F.lit("")).alias("ui"), F.coalesce(q["_MajorTopicYN"] == "Y", F.lit(False)).alias("is_major"))

    def subject(h: Column) -> Column:
        d, q = h["DescriptorName"], F.transform(F.filter(h["QualifierName"], lambda q: q["_VALUE"] != ""), qualifier)
        return F.struct(d["_VALUE"].alias("descriptor_name"), F.coalesce(d["_UI"], F.lit("")).alias("descriptor_ui"), F.coalesce(d["_MajorTopicYN"] == "Y", F.lit(False)).alias("is_major_topic"), F.coalesce(q, F.array().cast("array<struct<name:string,ui:string,is_major:boolean>>")).alias("qualifiers"))

    subjects = F.transform(F.filter(m["MeshHeadingList"]["MeshHeading"], lambda h: h["DescriptorName"]["_VALUE"] != ""), subject)
    substances = F.filter(m["ChemicalList"]["Chemical"], lambda c: c["NameOfSubstance"].isNotNull())
    substances = F.transform(substances, lambda c: F.struct(c["RegistryNumber"].alias("registry_number"), F.coalesce(c["NameOfSubstance"]["_VALUE"], F.lit("")).alias("name"), F.coalesce(c["NameOfSubstance"]["_UI"], F.lit("")).alias("ui")))
    grants = F.transform(F.filter(a["GrantList"]["Grant"], lambda g: g["Agency"] != ""), lambda g: F.struct(g["GrantID"].alias("grant_id"), g["Agency"].alias("agency"), g["Country"].alias("country"), g["Acronym"].alias("acronym")))
    grants = F.coalesce(grants, F.array().cast("array<struct<grant_id:string,agency:string,country:string,acronym:string>>"))
    pages = a["Pagination"]
    pages = F.coalesce(_blank(pages["MedlinePgn"]), F.when(_blank(pages["StartPage"]).isNotNull(), F.concat_ws("-", _blank(pages["StartPage"]), _blank(pages["EndPage"]))))
    full = own(ids, "_IdType", "pmc")
    full = F.when(full.startswith("PMC"), full).otherwise(F.concat(F.lit("PMC"), _blank(full)))
    made = (
        F.concat(F.lit("PMID"), m["PMID"]).alias("id"),
        m["PMID"].alias("pmid"),
        full.alias("pmc_id"),
        F.coalesce(own(a["ELocationID"], "_EIdType", "doi"), own(ids, "_IdType", "doi")).alias("doi"),
        F.coalesce(a["ArticleTitle"], F.lit("")).alias("title"),
        a["VernacularTitle"].alias("vernacular_title"),
        F.coalesce(clean(F.array_join(lines, " ")), F.lit("")).alias("abstract"),
        F.coalesce(sections, F.create_map().cast("map<string,string>")).alias("abstract_sections"),
        _authors(a["AuthorList"]["Author"]).alias("authors"),
        F.size("authors").alias("author_count"),
        F.coalesce(journal["Title"], F.lit("")).alias("journal"),
        info.alias("journal_info"),
        F.coalesce(year, F.lit("")).alias("year"),
        F.coalesce(published, electronic_day, paper_day, indexed).alias("published_date"),
        electronic_day.alias("electronic_date"),
        paper_day.alias("print_date"),
        history("received").alias("received_date"),
        history("accepted").alias("accepted_date"),
        iso_day(m["DateRevised"]).alias("revised_date"),
        indexed.alias("pubmed_date"),
        iso_day(m["DateCompleted"]).alias("medline_date"),
        issue["Volume"].alias("volume"),
        issue["Issue"].alias("issue"),
        pages.alias("pages"),
        _every(F.filter(F.flatten(F.transform(m["KeywordList"], lambda k: _every(k["Keyword"]))), lambda k: k != "")).alias("keywords"),
        F.coalesce(subjects, F.array().cast("array<struct<descriptor_name:string,descriptor_ui:string,is_major_topic:boolean,qualifiers:array<struct<name:string,ui:string,is_major:boolean>>>>")).alias("mesh_terms"),
        _every(F.filter(a["PublicationTypeList"]["PublicationType"], lambda t: t != "")).alias("publication_types"),
        F.coalesce(substances, F.array().cast("array<struct<registry_number:string,name:string,ui:string>>")).alias("chemicals"),
        F.coalesce(_blank(F.get(a["Language"], F.lit(0))), F.lit("eng")).alias("language"),
        grants.alias("grants"),
        (F.size("grants") > 0).alias("has_funding"),
        F.when(m["NumberOfReferences"].rlike("^[0-9]+$"), m["NumberOfReferences"].try_cast("int")).otherwise(0).alias("reference_count"),
        F.concat(F.lit(ARTICLE_URL), m["PMID"], F.lit("/")).alias("url"),
        F.coalesce(m["_Status"], F.lit("PubMed")).alias("medline_status"),
        m["_IndexingMethod"].alias("indexing_method"),
        F.col("pmc_id").isNotNull().alias("has_pmc_full_text"),
        F.concat(F.lit(FULL_TEXT_URL), "pmc_id", F.lit("/")).alias("pmc_url"),
    )
    named = dict(zip(FIELDS, made, strict=True))
    wanted = FIELDS if fields is None else fields
    first = dict.fromkeys(DERIVED.get(f, f) for f in wanted)  # what others are derived from is made once
    return parsed.select(*(named[f] for f in first)).select(*(named[f] if f in DERIVED else f for f in wanted))


def full_text_authors(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key, author: a row for each author of a full text's first group, as in article_records (SC31, J17).

    An affiliation stands in the author, else is looked up by its references among the text's affiliations: their texts without the
    leading mark, joined by "; ". Initials are the first letters of the given names. Authors without any name are left out.
    """
    plain = F.regexp_replace(F.col(xml), INLINE, "")
    known = rf"(?s)<aff\b[^>]*\bid=[\"']([^\"']+)[\"'][^>]*>(.*?)</aff>"
    rows = rows.select(F.col(key), F.from_xml(F.regexp_replace(plain, AFFILIATION_PARTS, " "), FULL_TEXT).alias("t"), F.regexp_extract_all(plain, F.lit(known), F.lit(1)).alias("_ids"), F.regexp_extract_all(plain, F.lit(known), F.lit(2)).alias("_texts"))
    listed = F.filter(F.get(F.col("t.front.article-meta.contrib-group"), F.lit(0))["contrib"], lambda c: c["_contrib-type"] == "author")
    rows = rows.select(key, "_ids", "_texts", F.posexplode(listed).alias("_at", "c"))

    def looked_up(rid: Column) -> Column:
        text = F.get(F.col("_texts"), (F.array_position(F.col("_ids"), rid) - 1).cast("int"))
        return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " ")), r"^[0-9a-z]+\s*", "")

    c = F.col("c")
    inside = _blank(F.trim(F.regexp_replace(F.get(c["aff"], F.lit(0)), r"\s+", " ")))
    wanted = F.filter(c["xref"], lambda x: (x["_ref-type"] == "aff") & F.array_contains(F.col("_ids"), x["_rid"]))
    referred = F.array_join(F.filter(F.transform(wanted, lambda x: looked_up(x["_rid"])), lambda t: t != ""), "; ")
    name = F.get(c["name"], F.lit(0))
    first = F.coalesce(name["given-names"], F.lit(""))
    initials = F.array_join(F.transform(F.filter(F.split(first, r"\s+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), "")
    person = _person((F.col("_at") + 1).cast("int"), name["surname"], first, F.when(name["surname"].isNotNull() & (first == ""), "").otherwise(initials), F.get(c["collab"], F.lit(0)), F.coalesce(inside, _blank(referred)), _orcid(c["contrib-id"], "_contrib-id-type", "orcid"), F.lit(False))
    return rows.select(key, person.alias("author")).where("author.name IS NOT NULL")


def _cut(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value: the parts of files between separators, read in as many tasks as the files have splits."""
    return spark.read.option("lineSep", separator).text(path)


def article_files(spark: SparkSession, path: str) -> DataFrame:
    """value: the XML of each article of files of articles; what stands between articles is left out."""
    start = F.regexp_extract("value", r"(?s)<PubmedArticle(?:\s[^>]*)?>.*", 0)
    return _cut(spark, path, "</PubmedArticle>").select(start.alias("value")).where("value <> ''").select(F.concat("value", F.lit("</PubmedArticle>")).alias("value"))


def bibliography_files(spark: SparkSession, path: str) -> DataFrame:
    """The entries of BibTeX files, as readers.bibliography gives them; a line that begins with @ begins an entry (SC23, SC24)."""
    entry = F.concat(F.lit("@"), F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}?@", ""), "\r\n?", "\n"), F.lit("\n"))
    return bibliography_of(_cut(spark, path, "\n@").select(entry.alias("value")))


def tagged_files(spark: SparkSession, path: str) -> DataFrame:
    """value: each record of files of tagged records, for readers.medline; a line of PMID begins a record (SC10)."""
    record = F.regexp_replace(F.regexp_replace("value", r"^\s*PMID- ", ""), "\r\n?", "\n")
    return _cut(spark, path, "\nPMID- ").select(F.trim(record).alias("value")).where("value <> ''").select(F.concat(F.lit("PMID- "), "value").alias("value"))


def id_files(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of files, line by line (SC25)."""
    return ids_of(spark.read.text(path))
