"""Annotation (header) operators: plan-only edits of field columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx
from vdjloom.sources.schema import field_names, require_field


def _has(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def _column(df: DataFrame, name: str):
    return F.col(name) if _has(df, name) else F.lit(None).cast("array<string>")


def add_fields(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Add constant fields; an existing field gets the value appended."""
    return df.withColumns({
        k: fx.merge(_column(df, k), F.array(F.lit(str(v)))) for k, v in values.items()
    })


def collapse_fields(df: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Reduce multi-valued fields, one action per field."""
    require_field(df, *actions)
    return df.withColumns({f: fx.collapse(F.col(f), a) for f, a in actions.items()})


def _apply(df: DataFrame, names, actions) -> DataFrame:
    return collapse_fields(df, {n: a for n, a in zip(names, actions or ()) if a})


def copy_fields(df: DataFrame, names: dict[str, str], actions: list[str] | None = None
                ) -> DataFrame:
    """Copy fields to new names, merging into a target that exists."""
    require_field(df, *names)
    for src, dst in names.items():
        df = df.withColumn(dst, fx.merge(_column(df, dst), F.col(src)))
    return _apply(df, names.values(), actions)


def delete_fields(df: DataFrame, names: list[str]) -> DataFrame:
    require_field(df, *names)
    return df.drop(*names)


def expand_field(df: DataFrame, field: str, sep: str = ",", n: int | None = None
                 ) -> DataFrame:
    """Replace ``field`` by FIELD1..FIELDn, one per separated value.

    Without ``n`` one job finds the largest number of values.
    """
    require_field(df, field)
    parts = F.split(fx.text(F.col(field)), f"\\Q{sep}\\E")
    if n is None:
        n = df.agg(F.max(F.size(parts))).first()[0] or 0
    new = {
        f"{field}{i}": F.when(F.size(parts) >= i, F.array(F.get(parts, F.lit(i - 1))))
        for i in range(1, n + 1)
    }
    return df.withColumns(new).drop(field)


def merge_fields(df: DataFrame, names: list[str], name: str, action: str | None = None,
                 delete: bool = False) -> DataFrame:
    """Merge several fields into one; optionally reduce it and drop the sources."""
    require_field(df, *names)
    df = df.withColumn(name, fx.merge(*[F.col(f) for f in names]))
    if action:
        df = collapse_fields(df, {name: action})
    return df.drop(*[f for f in names if f != name]) if delete else df


def rename_fields(df: DataFrame, names: dict[str, str], actions: list[str] | None = None
                  ) -> DataFrame:
    """Rename fields; an existing target receives the values in addition."""
    require_field(df, *names)
    for src, dst in names.items():
        df = df.withColumn(dst, fx.merge(_column(df, dst), F.col(src))).drop(src)
    return _apply(df, names.values(), actions)


def header_table(df: DataFrame, fields: list[str], sep: str = ",") -> DataFrame:
    """Annotation table with the read id first; a repeated ID is dropped."""
    wanted = [f for f in dict.fromkeys(fields) if f.upper() != "ID"]
    require_field(df, *wanted)
    return df.select(
        F.col("read_id").alias("ID"), *[fx.text(F.col(f), sep).alias(f) for f in wanted])


def field_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct values of a field."""
    require_field(df, field)
    return df.select(F.explode(field).alias("value")).distinct()


def flatten_header(df: DataFrame, fields: list[str] | None = None):
    """Header text ``ID|K=V|K=V1,V2``; absent fields are left out."""
    parts = [
        F.when(F.size(F.coalesce(F.col(f), F.array().cast("array<string>"))) > 0,
               F.concat(F.lit(f + "="), fx.text(F.col(f))))
        for f in (field_names(df) if fields is None else fields)
    ]
    return F.concat_ws("|", F.col("read_id"), *parts)
