"""Every query of the library by name, with the SQL that must give the same rows."""

from granary.plans import analysis, articles, buckets, documents, extraction, filters, gates, ingestion, learned, linking, outlines, quality, ranking, records, relations, search, text, trees  # noqa: F401  they register their queries
from granary.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
