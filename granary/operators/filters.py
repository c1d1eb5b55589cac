"""Predicates as Columns (F1-F34): membership, ranges, presence, token shares, nested elements, relevance and gates.

Everything here is a plain Column, so Spark pushes it to the scan where the source can use it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import tokens


def everything() -> Column:
    """All rows (F1)."""
    return F.lit(True)


def nothing() -> Column:
    """No row (F2)."""
    return F.lit(False)


def all_of(parts: Sequence[Column]) -> Column:
    """AND; all rows where there are no parts."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    """OR; no rows where there are no parts."""
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def boolean(must: Sequence[Column] = (), should: Sequence[Column] = (), must_not: Sequence[Column] = (), at_least: int | None = None) -> Column:
    """must and filter clauses by AND, should by OR (or a number of them), must_not by NOT (F10, F11). A null clause fails."""
    sure = [F.coalesce(c, F.lit(False)) for c in should]
    wanted = at_least if at_least is not None else (1 if should and not must else 0)
    enough = F.lit(True) if wanted == 0 else any_of(sure) if wanted == 1 else reduce(lambda a, b: a + b, [c.cast("int") for c in sure]) >= wanted
    return all_of([*(F.coalesce(c, F.lit(False)) for c in must), enough, *(~F.coalesce(c, F.lit(False)) for c in must_not)])


def is_value(df: DataFrame, field: str, value: object) -> Column:
    """Exact value; for an array, membership; for a field of an array of structs ("authors.name"), some element."""
    head, _, rest = field.partition(".")
    kind = df.schema[head].dataType
    if isinstance(kind, T.ArrayType) and rest:
        return F.exists(head, lambda e: e[rest] == F.lit(value))
    return F.array_contains(F.col(field), value) if isinstance(kind, T.ArrayType) else F.col(field) == F.lit(value)


def in_values(df: DataFrame, field: str, values: object) -> Column:
    """Any of the values; a single value counts as a list of one."""
    values = list(values) if isinstance(values, (list, tuple, set)) else [values]
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return F.arrays_overlap(F.col(field), F.array(*map(F.lit, values)))
    return F.col(field).isin(values)


def in_range(field: str | Column, gte: object = None, lte: object = None, lt: object = None) -> Column:
    """Inclusive bounds, or an exclusive upper one."""
    c = F.col(field) if isinstance(field, str) else field
    return all_of([*([c >= F.lit(gte)] if gte is not None else []), *([c <= F.lit(lte)] if lte is not None else []), *([c < F.lit(lt)] if lt is not None else [])])


def date_bounds(filters: dict) -> tuple[object, object]:
    """The lower and upper date of a filter dict: date_from before publishedAfter, date_to before publishedBefore."""
    return filters.get("date_from", filters.get("publishedAfter")), filters.get("date_to", filters.get("publishedBefore"))


def since(field: str, as_of: Column, days: int, whole_days: bool = False) -> Column:
    """At or after `days` before as_of, or before that day's start."""
    start = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.col(field) >= (F.date_trunc("day", start) if whole_days else start)


def preset_start(preset: str, as_of: Column) -> Column:
    """The lower bound of day, week, month or year before as_of, by the calendar."""
    steps = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}
    return as_of - F.expr(steps[preset])


def present(df: DataFrame, field: str) -> Column:
    """Not null, and for arrays not empty (F8); its negation is F9."""
    c = F.col(field)
    array = isinstance(df.select(field).schema[0].dataType, T.ArrayType)
    return c.isNotNull() & (F.size(c) > 0) if array else c.isNotNull()


def token_share(text: Column, query: str | Column, share: float) -> Column:
    """At least this share (rounded down, one at least) of the query's tokens is in the text."""
    wanted = F.array_distinct(tokens(F.lit(query) if isinstance(query, str) else query))
    return F.size(F.array_intersect(tokens(text), wanted)) >= F.greatest(F.lit(1), F.floor(F.size(wanted) * share))


def matches(text: Column, query: str | Column) -> Column:
    """Some token in common."""
    return F.arrays_overlap(tokens(text), tokens(F.lit(query) if isinstance(query, str) else query))


def has_citations(*lists: str) -> Column:
    """Some list has an element."""
    return any_of([F.coalesce(F.size(c) > 0, F.lit(False)) for c in lists])


def nested_any(array: str, predicate: Callable[[Column], Column]) -> Column:
    """Some element satisfies the predicate."""
    return F.exists(array, predicate)


def relevant(text: Column, keywords: Sequence[str], least: int = 1) -> Column:
    """At least so many of the keywords are substrings, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("int") for k in keywords], F.lit(0)) >= least


def relevant_parts(texts: Sequence[Column], lists: Sequence[Column], keywords: Sequence[str]) -> Column:
    """Some text, or some element of a list, contains a keyword."""
    of_lists = [F.coalesce(F.exists(x, lambda e: relevant(e, keywords)), F.lit(False)) for x in lists]
    return any_of([*(relevant(t, keywords) for t in texts), *of_lists])


def has_structure(paths: Column, indicators: Sequence[str], least: int = 2) -> Column:
    """At least so many of the indicator paths are there."""
    return F.coalesce(F.size(F.array_intersect(paths, F.array(*map(F.lit, indicators)))), F.lit(0)) >= least


#: Least amounts for a document to be scored at all, by type.
GATES = {"video": ("duration", 30), "repository": ("readme_length", 10), "documentation": ("content_length", 50)}


def passes_gate(content_type: Column, amounts: dict[str, Column]) -> Column:
    """The type's least amount is reached; other types pass."""
    out = F.lit(True)
    for kind, (what, least) in GATES.items():
        if what in amounts:
            out = F.when(content_type == kind, F.coalesce(amounts[what], F.lit(0)) >= least).otherwise(out)
    return out
