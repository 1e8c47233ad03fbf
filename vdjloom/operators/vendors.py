"""Convert sequencer and database headers to annotation fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions.binding import bind
from vdjloom.operators.filters import split_on

# Header layouts of the supported formats.
LAYOUTS = {
    "454": r"^(\S+)(?: .*)?\slength=(\d+)",
    "genbank_old": r"^gi\|(\d+)\|(\w+)\|([^|]+)\|\s*(.*)$",
    "genbank": r"^([^\s|]+)\s+(.+)$",
    "illumina": r"^(\S+)\s+([12]):[YN]:\d+:?(\S*)$",
    "illumina_old": r"^(\S+)#([^/\s]+)/([12])$",
    "migec": r"^MIG UMI:([A-Za-z]+):(\d+)",
    "sra": r"^(\w+\.\d+)(?:[./][12])?\s+(.+)$",
}

VENDORS = ("generic", "454", "genbank", "illumina", "imgt", "migec", "sra")


def _clean(text: Column) -> Column:
    """Text without the characters that delimit annotations."""
    return F.regexp_replace(F.trim(text), r"[|=,\s]+", "_")


def _value(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(_clean(text)))


def _groups(header: Column, layout: str, count: int) -> list[Column]:
    fits = header.rlike(LAYOUTS[layout])
    return [F.when(fits, F.regexp_extract(header, LAYOUTS[layout], i + 1)) for i in range(count)]


def _parts(header: Column, vendor: str, simple: bool) -> tuple[Column, dict[str, Column]]:
    """(read id, fields); the id is NULL when the header does not fit."""
    if vendor == "generic":
        first = F.regexp_extract(header, r"^(\S+)", 1)
        rest = F.regexp_extract(header, r"^\S+\s+(.*)$", 1)
        return F.when(first != "", _clean(first)), {"DESC": _value(rest)}
    if vendor == "454":
        name, length = _groups(header, "454", 2)
        return name, {"LENGTH": _value(length)}
    if vendor == "genbank":
        gi, source, accession, desc = _groups(header, "genbank_old", 4)
        new_id, new_desc = _groups(header, "genbank", 2)
        old = gi.isNotNull()
        return F.when(old, accession).otherwise(new_id), {
            "DESC": _value(F.when(old, desc).otherwise(new_desc)),
            "GI": _value(gi), "SOURCE": _value(source)}
    if vendor == "illumina":
        name, read, index = _groups(header, "illumina", 3)
        old_name, old_index, old_read = _groups(header, "illumina_old", 3)
        return F.coalesce(name, old_name), {
            "READ": _value(F.coalesce(read, old_read)),
            "INDEX": _value(F.coalesce(index, old_index))}
    if vendor == "imgt":
        cells = F.split(header, r"\|")
        allele = F.when(F.size(cells) >= 5, F.get(cells, F.lit(1)))
        if simple:
            return allele, {}

        def cell(i):
            return _value(F.get(cells, F.lit(i)))

        return allele, {"SPECIES": cell(2), "REGION": cell(4), "FUNCTIONALITY": cell(3),
                        "PARTIAL": cell(13), "ACCESSION": cell(0)}
    if vendor == "migec":
        umi, count = _groups(header, "migec", 2)
        return umi, {"UMI": _value(umi), "COUNT": _value(count)}
    if vendor == "sra":
        name, desc = _groups(header, "sra", 2)
        return name, {"DESC": _value(desc)}
    raise ValueError(f"unknown vendor {vendor!r}; use one of {VENDORS}")


def convert_headers(df: DataFrame, vendor: str, simple: bool = False, keep: str = "pass"
                    ) -> DataFrame:
    """Replace ``read_id`` and add the fields the vendor's header holds.

    Headers that do not fit the layout fail.  ``simple`` (imgt) keeps the
    allele name only.
    """
    source = "header" if "header" in df.columns else "read_id"
    name, values = _parts(F.col(source), vendor, simple)
    bound = bind(df, {"_id": name, **values})
    out = split_on(bound, F.col("_id").isNotNull(), keep)
    return out.withColumn("read_id", F.coalesce("_id", "read_id")).drop("_id")
