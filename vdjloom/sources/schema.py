"""The canonical reads schema.

read_id  STRING           identifier before the first '|'
seq      STRING           bases
qual     ARRAY<TINYINT>   Phred scores, NULL for FASTA
seq_no   BIGINT           input order, used only to settle ties
mate     TINYINT          1 or 2, absent after assembly
<FIELD>  ARRAY<STRING>    one column per annotation field
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN = "plain_id"  # metadata of read_id: it is the coordinate itself, no '|' is in it

CORE = ("read_id", "seq", "qual", "seq_no", "mate", "header")


def field_names(df: DataFrame) -> list[str]:
    """Annotation columns of a reads DataFrame, in column order."""
    return [
        c for c, t in df.dtypes
        if c not in CORE and not c.startswith("_") and t == "array<string>"
    ]


def require_field(df: DataFrame, *names: str) -> None:
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n and n.lower() not in have]
    if missing:
        raise ValueError(f"reads have no field(s) {missing}; fields: {field_names(df)}")


def require_quality(df: DataFrame) -> None:
    if "qual" not in df.columns:
        raise ValueError("this operator needs quality scores (a 'qual' column)")


def plain_id(df: DataFrame) -> DataFrame:
    """``df`` with the mark that its read_id holds no '|', so that joins on coordinates need not cut it."""
    return df.withColumn("read_id", F.col("read_id").alias("read_id", metadata={PLAIN: True}))


def is_plain_id(df: DataFrame) -> bool:
    return bool(df.schema["read_id"].metadata.get(PLAIN))
