"""Every query of the library with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from granary.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (float, Decimal)):
        return str(round(float(v), 6))
    if isinstance(v, dict):
        v = list(v.values())
    return f"[{', '.join(map(value, v))}]" if isinstance(v, (list, tuple)) else str(v)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(value(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    rows = canonical(ours.columns, ours.collect())
    assert rows == canonical(names, theirs.fetchall())
    assert rows, "no row, so nothing was compared"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
