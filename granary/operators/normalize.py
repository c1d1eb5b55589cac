"""Normalisers (P2-P8, P14, P17, Z2-Z9): five kinds of raw records to one content schema.

Each is a select over typed columns; source timestamps are kept, and nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.readers import people


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a null of its type where the table doesn't have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _metrics(views: Column, bookmarks: Column, shares: Column, citations: Column) -> Column:
    return F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in (("view_count", views), ("bookmark_count", bookmarks), ("share_count", shares), ("citation_count", citations))))


def _row(df: DataFrame, content_type: str, fields: dict[str, Column]) -> DataFrame:
    common = {"ml_score": _col(df, "ml_score", "double"), "ai_confidence": F.coalesce(_col(df, "ai_confidence", "double"), _col(df, "gpt_score", "double")), "final_score": F.coalesce(_col(df, "final_score", "double"), _col(df, "combined_score", "double")), "approval_status": F.coalesce(_col(df, "approval_status"), F.lit("pending"))}
    return df.select(F.lit(content_type).alias("content_type"), *(c.alias(n) for n, c in (fields | common).items()))


def bare_id(text: Column) -> Column:
    """Without a PMID prefix."""
    return F.regexp_replace(text, "^PMID:?", "")


def articles(df: DataFrame, url: str = "https://example.org/article/") -> DataFrame:
    """id, texts, people, names of subject terms, citation ids with counts, metrics (P3); cited_by and references are id arrays."""
    key = bare_id(F.col("pmid"))
    cited, refs = (F.coalesce(_col(df, n, "array<string>"), F.array().cast("array<string>")) for n in ("cited_by", "references"))
    mesh = F.filter(F.coalesce(_col(df, "mesh_terms", "array<string>"), F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")) != "")
    fields = {
        "id": key,
        "source": F.lit("articles"),
        "title": F.coalesce(_col(df, "title"), F.lit("")),
        "abstract": F.coalesce(_col(df, "abstract"), F.lit("")),
        "content": F.coalesce(_col(df, "abstract"), F.lit("")),
        "url": F.coalesce(F.nullif(_col(df, "url"), F.lit("")), F.concat(F.lit(url), key, F.lit("/"))),
        "authors": people(F.array_join(_col(df, "authors", "array<string>"), ";")),
        "published_date": _col(df, "published_date"),
        "mesh_terms": mesh,
        "citations": F.struct(F.size(cited).alias("cited_by_count"), F.size(refs).alias("references_count"), cited.alias("cited_by_ids"), refs.alias("reference_ids")),
        "metrics": _metrics(_col(df, "view_count", "long"), _col(df, "bookmark_count", "long"), _col(df, "share_count", "long"), F.size(cited)),
    }
    return _row(df, "article", fields)


def videos(df: DataFrame) -> DataFrame:
    """Content is the transcript, else the description; people are channel and presenter."""
    fields = {
        "id": F.col("video_id"),
        "source": F.lit("videos"),
        "title": F.coalesce(_col(df, "title"), F.lit("")),
        "abstract": F.coalesce(_col(df, "description"), F.lit("")),
        "content": F.coalesce(F.nullif(_col(df, "transcript"), F.lit("")), _col(df, "description"), F.lit("")),
        "authors": F.array_compact(F.array(_col(df, "channel_name"), _col(df, "presenter"))),
        "published_date": _col(df, "published_date"),
        "duration": _col(df, "duration", "int"),
        "metrics": _metrics(_col(df, "view_count", "long"), _col(df, "like_count", "long"), F.lit(0), F.lit(0)),
    }
    return _row(df, "video", fields)


def repositories(df: DataFrame) -> DataFrame:
    """People are the owner and the first five contributors; watchers, stars and forks are the metrics (P5)."""
    others = F.slice(F.coalesce(_col(df, "contributors", "array<string>"), F.array().cast("array<string>")), 1, 5)
    fields = {
        "id": F.col("repo_id"),
        "source": F.lit("repositories"),
        "title": F.coalesce(_col(df, "full_name"), _col(df, "name"), F.lit("")),
        "abstract": F.coalesce(_col(df, "description"), F.lit("")),
        "content": F.coalesce(_col(df, "readme"), F.lit("")),
        "authors": F.array_distinct(F.array_compact(F.concat(F.array(_col(df, "owner")), others))),
        "published_date": _col(df, "created_at"),
        "topics": F.coalesce(_col(df, "topics", "array<string>"), F.array().cast("array<string>")),
        "metrics": _metrics(_col(df, "watchers", "long"), _col(df, "stars", "long"), _col(df, "forks", "long"), F.lit(0)),
    }
    return _row(df, "repository", fields)


def discussions(df: DataFrame) -> DataFrame:
    """People are the poster and up to five others; content is the key points, else the first post."""
    poster = _col(df, "poster")
    others = F.slice(F.filter(F.array_distinct(F.coalesce(_col(df, "participants", "array<string>"), F.array().cast("array<string>"))), lambda p: p != F.coalesce(poster, F.lit(""))), 1, 5)
    abstract = F.coalesce(_col(df, "summary"), _col(df, "excerpt"), F.lit(""))
    points = F.array_join(_col(df, "key_points", "array<string>"), "\n")
    fields = {
        "id": F.col("topic_id"),
        "source": F.lit("discussions"),
        "title": F.coalesce(_col(df, "title"), F.lit("")),
        "abstract": F.substring(abstract, 1, 500),
        "content": F.coalesce(F.nullif(points, F.lit("")), F.substring(_col(df, "first_post"), 1, 2000), abstract),
        "authors": F.array_compact(F.concat(F.array(poster), others)),
        "published_date": _col(df, "created_at"),
        "reply_count": F.coalesce(_col(df, "reply_count", "long"), F.lit(0)),
        "metrics": _metrics(_col(df, "views", "long"), _col(df, "like_count", "long"), F.lit(0), F.lit(0)),
    }
    return _row(df, "discussion", fields)


def documentation(df: DataFrame) -> DataFrame:
    """Abstract is the description, else the content's beginning; keywords fall back to the first ten concepts."""
    content = F.coalesce(_col(df, "content"), F.lit(""))
    words = F.coalesce(_col(df, "keywords", "array<string>"), F.transform(F.slice(_col(df, "concepts", "array<string>"), 1, 10), lambda c: F.lower(c)))
    fields = {
        "id": F.col("doc_id"),
        "source": F.lit("documentation"),
        "title": F.coalesce(_col(df, "title"), F.lit("")),
        "abstract": F.coalesce(F.nullif(_col(df, "description"), F.lit("")), F.substring(content, 1, 500)),
        "content": F.substring(content, 1, 5000),
        "url": _col(df, "url"),
        "keywords": words,
        "metrics": _metrics(F.lit(0), F.lit(0), F.lit(0), F.lit(0)),
    }
    return _row(df, "documentation", fields)


KINDS = {"article": articles, "video": videos, "repository": repositories, "discussion": discussions, "documentation": documentation}


def normalise(sources: dict[str, DataFrame]) -> DataFrame:
    """All kinds in one table."""
    unknown = set(sources) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of content: {sorted(unknown)}")
    parts = [KINDS[kind](df).withColumn("id", F.col("id").cast("string")) for kind, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def content_type(df: DataFrame, by_source: dict[str, str], by_field: Sequence[tuple[str, str]]) -> Column:
    """The type by source, else by the first field that has a value, else article."""
    out = F.lit("article")
    for field, kind in reversed(by_field):
        if field in df.columns:
            out = F.when(F.col(field).isNotNull(), kind).otherwise(out)
    for source, kind in by_source.items():
        out = F.when(F.col("source") == source, kind).otherwise(out)
    return out


def mapped_categories(categories: Column, names: dict[str, str]) -> Column:
    """Old category names to new ones, whatever their case; unknown ones go, sorted and distinct."""
    known = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k.lower(), v)))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(categories, lambda c: known[F.lower(c)]))))
