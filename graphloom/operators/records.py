"""Reads and next states of plain tables: what the tables of an application's accounts need beside the graph.

A state is a DataFrame; a change returns the next one, to be written as a new version. Nulls are values: a null condition
finds nulls, and keys match null-safely. Empty tables give empty results and counts of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fits(where: dict) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c).eqNullSafe(F.lit(v)) for c, v in where.items()], F.lit(True))


def find(table: DataFrame, where: dict | None = None, order: list[str | Column] | None = None, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Rows whose columns have the values of where (or one of a list), in order, as many as asked for after those skipped."""
    out = table.where(_fits(where or {}))
    out = out.orderBy(*order) if order else out
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def count(table: DataFrame, where: dict | None = None) -> int:
    return table.where(_fits(where or {})).count()


def updated(table: DataFrame, where: dict, values: dict) -> DataFrame:
    """The table with new values in the columns of the rows that fit."""
    fits = _fits(where)
    return table.select(*(F.when(fits, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema))


def deleted(table: DataFrame, where: dict) -> DataFrame:
    return table.where(~_fits(where))


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows in place of those of the same key; rows must have each key once."""
    fresh = rows.select(*(F.col(c).alias(f"__{c}") for c in key))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    return table.join(fresh, same, "left_anti").unionByName(rows, allowMissingColumns=True).select(*table.columns)
