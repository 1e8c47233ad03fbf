"""Annotation fields: ARRAY<STRING> columns, one value per element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("min", "max", "sum", "first", "last", "set", "cat")


def text(field: Column, sep: str = ",") -> Column:
    """A multi-valued field as header text."""
    return F.array_join(field, sep)


def number(value: Column) -> Column:
    """Annotation text as a number; an empty value counts as zero."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(0.0)).otherwise(
        value.try_cast("double")
    )


def compact(x: Column) -> Column:
    """A DOUBLE with up to twelve significant digits and no trailing zeros."""
    sci = F.format_string("%.11e", x)
    magnitude = F.abs(x)
    plain = F.rtrim(
        F.rtrim(sci.cast("double").cast("decimal(38,15)").cast("string"), F.lit("0")),
        F.lit("."),
    )
    scientific = F.regexp_replace(sci, r"\.?0+e", "e")
    whole = (x == F.floor(x)) & (magnitude < 1e12)
    return (
        F.when(whole, x.cast("bigint").cast("string"))
        .when((magnitude >= 1e12) | (magnitude < 1e-4), scientific)
        .otherwise(plain)
    )


def collapse(field: Column, action: str) -> Column:
    """Reduce a multi-valued field; the result is again ARRAY<STRING>."""
    if action not in ACTIONS:
        raise ValueError(f"unknown collapse action {action!r}; use one of {ACTIONS}")
    if action in ("min", "max", "sum"):
        numbers = F.transform(field, number)
        reduced = {
            "min": F.array_min(numbers),
            "max": F.array_max(numbers),
            "sum": F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc + v),
        }[action]
        result = F.array(compact(reduced))
    elif action == "first":
        result = F.slice(field, 1, 1)
    elif action == "last":
        result = F.slice(field, -1, 1)
    elif action == "set":
        result = F.array_distinct(field)
    else:
        result = F.array(F.array_join(field, ""))
    return F.when(field.isNotNull() & (F.size(field) > 0), result)


def merge(*fields: Column) -> Column:
    """Values of several fields, in argument order; absent fields add nothing."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(f, empty) for f in fields])


def to_bool(value: Column) -> Column:
    """Lenient boolean: unknown spellings stay null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "t", "1", "yes"), F.lit(True)).when(
        v.isin("false", "f", "0", "no"), F.lit(False)
    )


def to_int(value: Column) -> Column:
    """Lenient integer: decimals are truncated, other text stays null."""
    return F.trim(value).try_cast("double").cast("bigint")
