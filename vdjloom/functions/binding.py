"""Evaluate an expression once per row.

The optimizer inlines a computed column into every place that uses it: into
filters pushed below the projection, and into lambdas, where it would run once
per array element.  For expensive expressions that multiplies both the work
and the generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once however often they are used.

    A one-element generator holds them; neither filters nor projections are
    merged through a generator, and it runs inside the same generated stage.
    """
    cell = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, cell.alias("_bound")).select(
        *kept, *[F.col(f"_bound.{n}").alias(n) for n in columns])
