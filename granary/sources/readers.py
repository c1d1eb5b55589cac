"""Sources (SC1-SC33): tables, files of articles, bibliographies, id lists, HTML pages, XML records, bounded samples.

Each gives a DataFrame with a fixed schema. Whole-file formats are read by Spark's text source and parsed inside
tasks, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "id string, title string, abstract string, year int, journal string, doi string, authors array<string>, keywords array<string>"


def articles_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of a list of articles, or an object with the list under "articles" (SC26)."""
    return articles_of(spark.read.text(path, wholetext=True))


def articles_of(rows: DataFrame) -> DataFrame:
    """The articles of JSON texts (value) (SC26)."""
    listed = F.from_json("value", f"array<struct<{ARTICLE.replace(' ', ':').replace(',:', ',')}>>")
    held = F.from_json("value", f"struct<articles:array<struct<{ARTICLE.replace(' ', ':').replace(',:', ',')}>>>")
    found = F.when(F.ltrim("value").startswith("["), listed).otherwise(held["articles"])
    return rows.select(F.explode(found).alias("a")).select("a.*")


def people(text: Column) -> Column:
    """Names of a list by semicolons or " and "; "Last, First" becomes "First Last" (SC23, AR-3)."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s*;\s*|\s+and\s+", -1), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^([^,]+),\s*(.+)$", "$2 $1"))


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Files of BibTeX entries (SC23, SC24)."""
    return bibliography_of(spark.read.text(path, wholetext=True))


def bibliography_of(rows: DataFrame) -> DataFrame:
    """key, kind, id (pmid, else pubmed, else the key), title, abstract, year, journal, doi, authors, keywords of BibTeX texts (value) (SC23, SC24)."""
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?ms)^@(\w+\{.*?)^\}"), F.lit(1)))
    rows = rows.select(entry.alias("e"))

    def field(name: str) -> Column:
        braced = F.regexp_extract("e", rf"(?is)\b{name}\s*=\s*\{{(.*?)\}}\s*,?\s*$(?m)", 1)
        plain = F.regexp_extract("e", rf"(?im)^\s*{name}\s*=\s*[\{{\"]?(.*?)[\}}\"]?\s*,?\s*$", 1)
        return F.nullif(F.trim(F.regexp_replace(F.when(plain != "", plain).otherwise(braced), r"\s+", " ")), F.lit(""))

    key = F.trim(F.regexp_extract("e", r"^\w+\{\s*([^,]+),", 1))
    return rows.select(
        key.alias("key"),
        F.lower(F.regexp_extract("e", r"^(\w+)\{", 1)).alias("kind"),
        F.coalesce(field("pmid"), field("pubmed"), key).alias("id"),
        field("title").alias("title"),
        field("abstract").alias("abstract"),
        field("year").try_cast("int").alias("year"),
        field("journal").alias("journal"),
        field("doi").alias("doi"),
        people(field("author")).alias("authors"),
        F.filter(F.transform(F.split(F.coalesce(field("keywords"), F.lit("")), r"[;,]", -1), lambda k: F.trim(k)), lambda k: k != "").alias("keywords"),
    )


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of files (SC25)."""
    return ids_of(spark.read.text(path, wholetext=True))


def ids_of(whole: DataFrame) -> DataFrame:
    """Distinct ids of texts (value): after "PMID", in addresses that end in digits, and alone on a line (SC25)."""
    patterns = (r"(?i)PMID:?\s*(\d{4,9})", r"https?://\S+?/(\d{4,9})/?(?=\s|$)", r"(?m)^\s*(\d{4,9})\s*$")
    found = F.concat(*(F.regexp_extract_all("value", F.lit(p), F.lit(1)) for p in patterns))
    return whole.select(F.explode(found).alias("id")).distinct()


RECORD = "PMID string, Title string, Journal string, Year string, Abstract array<string>, Author array<struct<LastName:string, ForeName:string, CollectiveName:string>>"


def xml_records(rows: DataFrame, column: str, row_schema: str = RECORD) -> DataFrame:
    """The fields of one XML record in each row; records that don't parse give nulls (SC8, SC9, SC31)."""
    return rows.select("*", F.from_xml(F.col(column), row_schema).alias("record"))


def record_authors(authors: Column) -> Column:
    """Fore and last name, either alone, or the collective name."""
    return F.transform(authors, lambda a: F.when(a["CollectiveName"].isNotNull(), a["CollectiveName"]).otherwise(F.concat_ws(" ", a["ForeName"], a["LastName"])))


def medline(text: Column) -> Column:
    """Struct of a tagged record's pmid, title, abstract, journal, date, authors and doi (SC10, Z10).

    A field goes on in lines that begin with six spaces. The doi is that of AID, else of LID, else one named in SO.
    """
    t = F.coalesce(text, F.lit(""))

    def every(tag: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(?m)^{tag} *- (.*(?:\n {{6}}.*)*)$"), F.lit(1))
        return F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s*\n\s+", " ")))

    def one(tag: str) -> Column:
        return F.get(every(tag), F.lit(0))

    def doi(tag: str) -> Column:
        found = F.filter(every(tag), lambda x: x.endswith("[doi]"))
        return F.trim(F.regexp_replace(F.get(found, F.lit(0)), r"\[doi\]$", ""))

    named = F.nullif(F.regexp_extract(F.coalesce(one("SO"), F.lit("")), r"doi: (10\.\S+?)\.?(?:\s|$)", 1), F.lit(""))
    return F.struct(one("PMID").alias("pmid"), one("TI").alias("title"), one("AB").alias("abstract"), one("JT").alias("journal"), one("DP").alias("date"), every("FAU").alias("authors"), F.coalesce(doi("AID"), doi("LID"), named).alias("doi"))


class _Page(HTMLParser):
    """Text, title, description, headings, code and links of a page, however broken its markup."""

    SKIP = frozenset({"script", "style", "noscript", "template"})
    HEADS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.description = "", ""
        self.text: list[str] = []
        self.headings: list[tuple[int, str]] = []
        self.code: list[str] = []
        self.links: list[tuple[str, str]] = []
        self._skip = 0
        self._into: list[tuple[str, list[str], str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self._skip += 1
        elif tag == "meta" and dict(attrs).get("name", "").lower() == "description":
            self.description = dict(attrs).get("content") or ""
        elif tag in self.HEADS or tag in ("title", "pre", "a"):
            self._into.append((tag, [], dict(attrs).get("href") or ""))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self._skip = max(0, self._skip - 1)
            return
        for i in range(len(self._into) - 1, -1, -1):
            if self._into[i][0] == tag:
                name, parts, href = self._into.pop(i)
                text = " ".join("".join(parts).split())
                if name == "title":
                    self.title = self.title or text
                elif name == "pre":
                    self.code.append("".join(parts))
                elif name == "a":
                    self.links.append((text, href))
                elif text:
                    self.headings.append((int(name[1]), text))
                return

    def handle_data(self, data):
        if self._skip:
            return
        for _, parts, _ in self._into:
            parts.append(data)
        if not any(name == "title" for name, _, _ in self._into):
            self.text.append(data)


PAGE = "page_id long, url string, title string, description string, content string, n_words int, headings array<struct<level:int, text:string>>, n_code int, links array<struct<text:string, url:string>>"


def html_pages(pages: DataFrame, most_headings: int = 20, most_links: int = 20, least_code: int = 50) -> DataFrame:
    """The parts of each page (SC20, SC21); pages: page_id, url, html. A null page is an empty one."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, html in frame.itertuples(index=False):
                page = _Page()
                page.feed(html or "")
                page.close()
                content = " ".join("".join(page.text).split())
                rows.append((page_id, url, page.title, page.description, content, len(content.split()), page.headings[:most_headings], sum(len(c) > least_code for c in page.code), page.links[:most_links]))
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "description", "content", "n_words", "headings", "n_code", "links"])

    return pages.select("page_id", "url", "html").mapInPandas(parse, PAGE)


def toc_links(text: Column, base: str) -> Column:
    """Absolute addresses of a Markdown table of contents, .md as .html (SC22)."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)#\s]+)\)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(u, "^/+", ""))), r"\.md$", ".html")))


def by_any_id(df: DataFrame, value: str, fields: Sequence[str] = ("id", "url", "pmid")) -> DataFrame:
    """The row whose first such field equals the value, or the value without the PMID prefix (SC2)."""
    bare = re.sub("^PMID:?", "", value)
    rank = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(fields))):
        rank = F.when(F.col(f).cast("string").isin(value, bare), i).otherwise(rank)
    return df.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", fields[0]).limit(1).drop("_rank")


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same on every run (SC5)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def existing_keys(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct non-null values of several id columns (SC6)."""
    return df.select(F.explode(F.array(*(F.col(f).cast("string") for f in fields))).alias("key")).where("key is not null").distinct()


def choose_language(rows: DataFrame, key: str, language: str, value: str, order: Sequence[str]) -> DataFrame:
    """key, value of the first language of the order that there is, else of any, by name (SC15)."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(language)), F.lit(0)), F.lit(len(order) + 1))
    return rows.groupBy(key).agg(F.min_by(value, F.struct(rank, F.col(language))).alias(value))
