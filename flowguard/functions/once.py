"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Add columns (SQL text or expressions) as the output of a generator.

    A plain projection is copied into every later use and into pushed-down filters.  With costly
    steps that are used more than once, or that build on each other, the work and the plan would
    multiply; what a generator gives is computed once per row.
    """
    row = F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
