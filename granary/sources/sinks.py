"""Sinks (SK1-SK20, ST4): bibliography and JSON exports, partitioned tables, keyed appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bibtex(key: Column, fields: dict[str, Column]) -> Column:
    """An article entry with the fields that have a value (SK16)."""
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), c.cast("string"), F.lit("}"))) for n, c in fields.items()]
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}"))


def write_lines(rows: DataFrame, line: Column, path: str) -> None:
    rows.select(line.alias("value")).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line (SK19)."""
    rows.write.json(path)


def write_partitioned(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet by the values of columns; rows of one value come from several tasks, so a hot value is no single file."""
    rows.write.partitionBy(*by).mode("append").parquet(path)
