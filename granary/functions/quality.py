"""Quality scores by content type as Columns (M-2, M-3, M-5, M-15 to M-18, X17, X44, X49): authority, engagement, upkeep, structure.

A record's fields come as a dict of Columns; a field that is not given, or null, counts as absent (false, 0 or empty).
Names that mark official content are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.scores import ladder

Fields = dict[str, Column]


def _n(fields: Fields, name: str) -> Column:
    return F.coalesce(fields.get(name, F.lit(None)).cast("double"), F.lit(0.0))


def _t(fields: Fields, name: str) -> Column:
    return F.lower(F.coalesce(fields.get(name, F.lit(None)).cast("string"), F.lit("")))


def _yes(fields: Fields, name: str) -> Column:
    return F.coalesce(fields.get(name, F.lit(False)).cast("boolean"), F.lit(False))


def _if(condition: Column, gain: float) -> Column:
    return F.when(condition, F.lit(gain)).otherwise(F.lit(0.0))


def _has(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _sum(base: float, parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(base))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value computed once; Spark computes it anew in each branch of a case."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def by_type(content_type: Column, scores: dict[str, Column], other: float) -> Column:
    """The score of the row's type, at most 1."""
    out = F.lit(other)
    for kind, score in scores.items():
        out = F.when(content_type == kind, score).otherwise(out)
    return F.least(F.lit(1.0), out)


#: Words of journals, channels and owners of standing.
BEST_JOURNALS, GOOD_JOURNALS = ("nature", "science", "lancet", "nejm", "jama"), ("plos", "bmc", "journal", "ieee")
CHANNELS, OWNERS = ("university", "institute", "conference"), ("university", "institute", "lab")


def authority(content_type: Column, fields: Fields, official: str) -> Column:
    """From 0.5, by people, journal, channel, owner, answers or official standing (M-2)."""
    journal, channel, owner = (_t(fields, n) for n in ("journal", "channel", "owner"))
    views, stars, people = (_n(fields, n) for n in ("views", "stars", "n_authors"))
    place = F.when(_has(journal, BEST_JOURNALS), 0.2).when(_has(journal, GOOD_JOURNALS), 0.1).otherwise(0.0)
    scores = {
        "article": _sum(0.5, [_if(people > 3, 0.1), _if(people > 10, 0.1), place]),
        "video": F.when(channel.contains(official), 1.0).when(_has(channel, CHANNELS), 0.8).otherwise(0.5) + ladder(views, [(10000, 0.2), (1000, 0.1)]),
        "repository": F.when(owner == official, 1.0).when(_has(owner, OWNERS), 0.7).otherwise(0.5) + ladder(stars, [(100, 0.3), (10, 0.15)]) + _if(people > 5, 0.1),
        "discussion": _sum(0.5, [_if(_yes(fields, "expert_answered"), 0.3), _if(_yes(fields, "solved"), 0.2), _if(_n(fields, "answers") > 5, 0.1)]),
        "documentation": F.when(_yes(fields, "official") & (_t(fields, "source") == "wiki"), 1.0).when(_yes(fields, "official"), 0.9).otherwise(0.5),
    }
    return by_type(content_type, scores, 0.5)


def engagement(content_type: Column, fields: Fields) -> Column:
    """From 0.3, by citations, views, likes, stars, forks, answers or child pages (M-3)."""
    views, likes, stars, forks = (_n(fields, n) for n in ("views", "likes", "stars", "forks"))
    liked = F.when(views > 0, likes / views).otherwise(0.0)
    scores = {
        "article": _sum(0.3, [ladder(_n(fields, "citations"), [(50, 0.4), (10, 0.2), (0, 0.1)]), _if(views > 100, 0.2), _if(_n(fields, "bookmarks") > 10, 0.1)]),
        "video": _sum(0.3, [ladder(views, [(10000, 0.3), (1000, 0.2), (100, 0.1)]), ladder(liked, [(0.1, 0.2), (0.05, 0.1)])]),
        "repository": _sum(0.3, [ladder(stars, [(100, 0.3), (10, 0.15)]), ladder(forks, [(50, 0.2), (10, 0.1)]), _if(_n(fields, "open_issues") > 0, 0.05)]),
        "discussion": _sum(0.3, [ladder(views, [(1000, 0.2), (100, 0.1)]), ladder(_n(fields, "answers"), [(10, 0.2), (3, 0.1)]), _if(likes > 10, 0.1)]),
        "documentation": _sum(0.3, [_if(views > 1000, 0.2), _if(_n(fields, "n_children") > 5, 0.2)]),
    }
    return by_type(content_type, scores, 0.3)


def classifier_quality(content_type: Column, fields: Fields, official: str) -> Column:
    """The classifier's own quality score, from 0.5 (M-5)."""
    views, stars = _n(fields, "views"), _n(fields, "stars")
    there = lambda name: _t(fields, name) != ""
    longer = lambda name, n: F.length(_t(fields, name)) > n
    scores = {
        "article": _sum(0.5, [_if(there("journal"), 0.1), _if(_n(fields, "n_authors") > 3, 0.1), _if(_n(fields, "n_subjects") > 0, 0.1), _if(there("doi"), 0.1), _if(longer("abstract", 500), 0.1)]),
        "video": _sum(0.5, [ladder(views, [(1000, 0.2), (100, 0.1)]), _if(_n(fields, "duration") > 600, 0.1), _if(there("transcript"), 0.2), _if(_t(fields, "channel").contains(official), 0.2)]),
        "repository": _sum(0.5, [ladder(stars, [(100, 0.2), (10, 0.1)]), _if(longer("content", 1000), 0.15), _if(there("license"), 0.05), _if(_t(fields, "owner") == official, 0.2), _if(there("last_commit"), 0.1)]),
        "discussion": _sum(0.5, [_if(_yes(fields, "solved"), 0.2), _if(_yes(fields, "expert_answered"), 0.2), ladder(_n(fields, "answers"), [(5, 0.1), (0, 0.05)]), _if(there("best_answer"), 0.15)]),
        "documentation": _sum(0.5, [_if(_yes(fields, "official"), 0.3), _if(_yes(fields, "tutorial"), 0.1), _if(longer("content", 2000), 0.1), _if(there("version"), 0.05)]),
    }
    return by_type(content_type, scores, 0.5)


def younger(days: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """The gain of the first step whose number of days is above the age; 0 beyond the last, or without a date."""
    out = F.lit(0.0)
    for most, gain in reversed(steps):
        out = F.when(days < most, F.lit(gain)).otherwise(out)
    return F.coalesce(F.when(days.isNotNull(), out), F.lit(0.0))


def repository_quality(fields: Fields) -> Column:
    """Struct documentation, maintenance, community, code and overall (.3, .3, .2, .2) (M-15). days: since the last push."""
    readme = _t(fields, "readme")
    size = F.length(readme)
    documentation = _sum(0.0, [ladder(size, [(5000, 0.4), (1000, 0.2)]), _if(readme.contains("installation"), 0.1), _if(_has(readme, ("usage", "example")), 0.1), _if(readme.contains("license"), 0.05), _if(readme.contains("contributing"), 0.05), _if(_yes(fields, "wiki"), 0.1), _if(_t(fields, "license") != "", 0.1)])
    upkeep = _sum(0.0, [younger(fields.get("days", F.lit(None)).cast("double"), [(30, 0.5), (90, 0.3), (180, 0.2), (365, 0.1)]), _if(~_yes(fields, "archived"), 0.2), _if(_n(fields, "open_issues") < 50, 0.1)])
    community = _sum(0.0, [ladder(_n(fields, "stars"), [(100, 0.3), (10, 0.15), (0, 0.05)]), ladder(_n(fields, "forks"), [(50, 0.2), (10, 0.1), (0, 0.05)]), ladder(_n(fields, "contributors"), [(10, 0.2), (3, 0.1), (1, 0.05)])])
    code = _sum(0.0, [_if(_yes(fields, "structure"), 0.3), _if(_n(fields, "n_topics") > 0, 0.1), _if(_t(fields, "language") != "", 0.1)])
    overall = documentation * 0.3 + upkeep * 0.3 + community * 0.2 + code * 0.2
    return F.struct(documentation.alias("documentation"), upkeep.alias("maintenance"), community.alias("community"), code.alias("code"), overall.alias("overall"))


def discussion_quality(fields: Fields) -> Column:
    """Struct engagement, activity, content and overall (.4, .3, .3) (M-16). days: since the last post."""
    engaged = _sum(0.0, [ladder(_n(fields, "views"), [(1000, 0.3), (100, 0.15), (10, 0.05)]), ladder(_n(fields, "replies"), [(20, 0.3), (5, 0.15), (0, 0.05)]), ladder(_n(fields, "likes"), [(10, 0.2), (3, 0.1), (0, 0.05)])])
    active = younger(fields.get("days", F.lit(None)).cast("double"), [(7, 0.5), (30, 0.3), (90, 0.2), (365, 0.1)])
    content = _sum(0.0, [_if(_yes(fields, "pinned"), 0.3), _if(_n(fields, "n_tags") > 0, 0.1), ladder(F.length(_t(fields, "excerpt")), [(200, 0.2), (50, 0.1)]), _if(_yes(fields, "relevant"), 0.3)])
    return F.struct(engaged.alias("engagement"), active.alias("activity"), content.alias("content"), (engaged * 0.4 + active * 0.3 + content * 0.3).alias("overall"))


def thread_quality(engaged: Column, facts: Column, relevance: Column, days: Column) -> Column:
    """Engagement, contents (extract.thread_facts), relevance and age, at most 1 (M-18)."""
    content = _sum(0.0, [_if(facts["has_solution"], 0.3), _if(facts["code_snippets"] > 0, 0.2), _if(facts["links"] > 0, 0.1), _if(F.size(facts["tools"]) > 0, 0.2), _if(F.size(facts["concepts"]) > 0, 0.2)])
    age = younger(days.cast("double"), [(7, 0.2), (30, 0.15), (90, 0.1), (365, 0.05)])
    return F.least(F.lit(1.0), engaged * 0.3 + F.least(F.lit(1.0), content) * 0.3 + relevance * 0.2 + age)


#: Types of documentation that say more.
TYPES_OF_PAGES = ("tutorial", "example", "installation")


def page_quality(fields: Fields) -> Column:
    """Struct completeness, structure, code and overall (.4, .3, .3) of a documentation page (M-17)."""
    complete = _sum(0.0, [_if(_t(fields, "title") != "", 0.2), _if(_t(fields, "description") != "", 0.1), ladder(_n(fields, "n_words"), [(500, 0.3), (200, 0.15)]), _if(_n(fields, "n_links") > 0, 0.1), _if(_t(fields, "doc_type").isin(*TYPES_OF_PAGES), 0.2)])
    structure = _sum(0.0, [ladder(_n(fields, "n_headings"), [(5, 0.3), (2, 0.15)]), _if(_yes(fields, "has_h1") & _yes(fields, "has_h2"), 0.2)])
    code = _sum(0.0, [ladder(_n(fields, "n_code"), [(3, 0.3), (0, 0.15)]), _if(_n(fields, "n_code_named") > 0, 0.2)])
    return F.struct(complete.alias("completeness"), structure.alias("structure"), code.alias("code"), (complete * 0.4 + structure * 0.3 + code * 0.3).alias("overall"))


#: Fixed patterns of what documentation has.
INDICATORS = {
    "has_examples": r"example|sample|demo|snippet|usage",
    "has_installation": r"install|setup|configure|deploy|requirement",
    "has_api": r"api|endpoint|method|function|parameter|argument",
    "has_troubleshooting": r"troubleshoot|debug|error|issue|problem|solution",
    "has_tutorial": r"tutorial|guide|walkthrough|step.by.step|how.to",
    "has_reference": r"reference|specification|documentation|manual",
    "has_faq": r"faq|frequently|asked|question",
    "has_glossary": r"glossary|terminology|definition|vocabulary",
}


def _any_of(text: Column, pattern: str) -> Column:
    """Whether any alternative of the pattern, none in brackets, is in the text: plain words are searched as such, which costs a small part of a regular expression."""
    plain = [w for w in pattern.split("|") if re.fullmatch(r"\w+", w)]
    rest = [w for w in pattern.split("|") if w not in plain]
    return reduce(lambda a, b: a | b, [text.contains(w) for w in plain] + [text.contains(re.match(r"\w*", w)[0]) & text.rlike(f"(?d){w}") for w in rest])


def indicators(text: Column) -> Column:
    """Struct of the eight flags of a page's contents."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(*(_any_of(low, p).alias(n) for n, p in INDICATORS.items()))


def documentation_quality(fields: Fields, flags: Column) -> Column:
    """Length, headings, code, flags (indicators()), relevance and type, at most 1."""
    share = reduce(lambda a, b: a + b, [flags[n].cast("int") for n in INDICATORS]) / float(len(INDICATORS))
    kind = _t(fields, "doc_type")
    parts = [
        _once(_n(fields, "n_words"), lambda n: ladder(n, [(1000, 0.15), (500, 0.08)])),
        _if(_t(fields, "description") != "", 0.05),
        _if(_n(fields, "n_headings") > 3, 0.1),
        _if(_n(fields, "n_code") > 0, 0.1),
        _if(_n(fields, "n_code") > 2, 0.1),
        share * 0.2,
        _if(_yes(fields, "relevant"), 0.1),
        _if(_n(fields, "n_mentions") > 0, 0.05),
        F.when(kind.isin("tutorial", "installation", "example", "api"), 0.15).when(kind == "reference", 0.08).otherwise(0.0),
    ]
    return F.least(F.lit(1.0), _sum(0.0, parts))


#: Fixed words of technical speech.
TECHNICAL = ("analysis", "method", "algorithm", "model", "data", "study")


def transcript_quality(text: Column, n_mentions: Column) -> Column:
    """From 0.5, by words, structure, mentions, numbers and technical words; 0 without a text."""
    t = F.coalesce(text, F.lit(""))
    terms = _once(F.lower(t), lambda low: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in TECHNICAL]))
    words = _once(F.size(T.words(text)), lambda n: ladder(n, [(1000, 0.2), (500, 0.1)]))
    score = _sum(0.5, [words, _if(t.contains("\n\n") | t.contains(". "), 0.1), ladder(n_mentions, [(5, 0.2), (2, 0.1)]), _if(t.rlike(r"\b[0-9]+\b"), 0.05), _if(terms > 3, 0.05)])
    return F.when(t == "", 0.0).otherwise(F.least(F.lit(1.0), score))
