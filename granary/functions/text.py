"""Text functions as Columns (X1-X16, X51-X54): normalising, tokens, similarity, identifiers, segments, mentions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def _s(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalised(text: Column) -> Column:
    """Lower case, other characters than letters, digits and underscores to spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_s(text)), r"[^\p{L}\p{N}_]+", " "), r" +", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_s(text)), F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    return F.array_remove(F.split(_s(text), r"[\x20\x09-\x0D]+", -1), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of the two sets of tokens; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def title_of(text: Column) -> Column:
    """The first sentence or line."""
    return F.trim(F.regexp_extract(_s(text), r"^([^.\n]*)", 1))


def fingerprint(source: Column, source_id: Column, title: Column, date: Column, person: Column, own_ids: Sequence[str]) -> Column:
    """md5 of source|source_id for sources whose ids are unique, else of lower title|source|date[:10](|lower person)."""
    by_id = source.isin(*own_ids) & (_s(source_id) != "")
    parts = [F.lower(F.trim(_s(title))), _s(source), F.substring(_s(date.cast("string")), 1, 10)]
    text = F.concat_ws("|", *parts, F.when(_s(person) != "", F.lower(person)))
    return F.md5(F.when(by_id, F.concat_ws("|", source, source_id)).otherwise(text))


#: Fixed patterns of identifiers in running text.
PMID, DOI, URL = r"(?i)PMID:?\s*(\d+)", r"(10\.\d{4,}/[-._;()/:\w]+)", r"(https?://[^\s<>\"{}|\\^`\[\]]+)"


def identifiers(texts: Sequence[Column], pmid: Column | None = None, doi: Column | None = None, url: Column | None = None) -> Column:
    """Struct of sorted distinct pmids, dois and urls in the texts and the direct fields."""
    whole = F.concat_ws("\n", *texts)

    def of(pattern: str, direct: Column | None) -> Column:
        found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(1))
        more = F.array_compact(F.array(direct.cast("string"))) if direct is not None else F.array().cast("array<string>")
        return F.array_sort(F.array_union(found, more))

    return F.struct(of(PMID, pmid).alias("pmids"), of(DOI, doi).alias("dois"), of(URL, url).alias("urls"))


def clean(text: Column) -> Column:
    """Tags out, the five usual entities resolved, line breaks to spaces, trimmed."""
    out = F.regexp_replace(_s(text), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\r\n]+", " "))


def occurrences(text: Column, term: str) -> Column:
    """How often the term occurs, without overlap, whatever the case."""
    low = F.lower(_s(text))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("int")


def category_scores(text: Column, categories: dict[str, Sequence[str]]) -> Column:
    """Array of (category, score) with a positive score, best first: the sum of their keywords' occurrences."""
    each = [F.struct(F.lit(c).alias("category"), reduce(lambda a, b: a + b, [occurrences(text, k) for k in ks]).alias("score")) for c, ks in categories.items()]
    found = F.filter(F.array(*each), lambda s: s["score"] > 0)
    return F.array_sort(found, lambda a, b: F.when(a["score"] != b["score"], (b["score"] - a["score"]).cast("int")).when(a["category"] < b["category"], F.lit(-1)).otherwise(F.lit(1)))


def mentions(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur as whole words, in the order given."""
    low = F.lower(_s(text))
    return F.array_compact(F.array(*(F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){t.lower()}($|[^\p{{L}}\p{{N}}_])"), F.lit(t)) for t in terms)))


def topics(text: Column, topic_words: dict[str, Sequence[str]]) -> Column:
    """The topics of which some word is a substring (X11)."""
    low = F.lower(_s(text))
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in ws]), F.lit(t)) for t, ws in topic_words.items())))


def questions(text: Column, least: int = 10, most: int = 20) -> Column:
    """Sentences that end in a question mark, of more than `least` characters, at most `most`."""
    found = F.transform(F.regexp_extract_all(_s(text), F.lit(r"([^.!?]*\?)"), F.lit(1)), lambda s: F.trim(s))
    return F.slice(F.filter(found, lambda s: F.length(s) > least), 1, most)


def segments(text: Column, least: int = 50, most: int = 20, cap: int = 1000) -> Column:
    """Paragraphs of more than `least` characters as (index, text): their place in the text and at most `cap` characters."""
    parts = F.split(_s(text), r"\n\s*\n|\.  ", -1)
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("index"), F.substring(F.trim(p), 1, cap).alias("text")))
    return F.slice(F.filter(numbered, lambda s: F.length(s["text"]) > least), 1, most)


def sentences(text: Column) -> Column:
    """Sentences without their marks, trimmed, none empty."""
    return F.filter(F.transform(F.split(_s(text), r"[.!?]+", -1), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def quoted(term: Column) -> Column:
    """A query term, in quotes if it has a space."""
    return F.when(term.contains(" "), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def searchable(*parts: Column) -> Column:
    """All parts in one lower-case text."""
    return F.lower(F.concat_ws(" ", *parts))


def reading_minutes(n_words: Column, per_minute: int = 200) -> Column:
    """Whole minutes."""
    return F.floor(n_words / per_minute).cast("int")


def highlighted(text: Column, terms: Sequence[str], size: int | None = None) -> Column:
    """The text, or `size` characters around the first term, with the terms in <em> tags."""
    pattern = "|".join(sorted((t.lower() for t in terms), key=len, reverse=True))
    if size:
        at = F.regexp_instr(F.lower(_s(text)), F.lit(rf"\b({pattern})\b"))
        text = F.substr(_s(text), F.greatest(F.lit(1), at - size // 2), F.lit(size))
    return F.regexp_replace(_s(text), rf"(?i)\b({pattern})\b", "<em>$1</em>")
