"""Sidecars of contigs that come with more than one table.

A sidecar keeps, beside each record, everything its sources say about it.  The
sources differ in columns, so each becomes a table of its own with an id, and
``cells.merge_annotations`` unites them by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjloom.operators import cells
from vdjloom.sources.text import first_present

Sources = list[tuple[DataFrame, str]]


def _prefixed(table: DataFrame, prefix: str) -> list:
    return [F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in table.columns if c != "seq_no"]


def _headers(fasta: DataFrame, name: str) -> tuple[DataFrame, str]:
    return fasta.select("sequence_id", F.col("header").alias(name), "seq_no"), "sequence_id"


def assembler_sources(annot: DataFrame, report: DataFrame | None = None, airr: DataFrame | None = None,
                      named: DataFrame | None = None) -> Sources:
    """Header of the assembled contig as ``annot_header``, the rows that place it with their columns prefixed.

    A row of the barcode report belongs to every contig that one of its chain
    fields names (``barcode_report.``), a row of the AIRR table with a cell to
    its contig (``barcode_airr.``).  Rows that name no assembled contig or no
    cell add nothing.  ``named`` is what ``cells.named_contigs`` says of the report, if it is written.
    """
    ids = annot.select("sequence_id").distinct()
    sources = [_headers(annot, "annot_header")]
    if report is not None:
        named = (cells.named_contigs(report, ids) if named is None else named).select(
            F.col("contig").alias("sequence_id"), F.col("place.seq_no").alias("seq_no")).distinct()
        rows = report.select("seq_no", *_prefixed(report, "barcode_report"))
        sources.append((named.join(rows, "seq_no"), "sequence_id"))
    if airr is not None:
        placed = airr.filter(first_present(airr, ["cell_id"]).isNotNull()).select(
            first_present(airr, ["sequence_id"]).alias("sequence_id"), "seq_no", *_prefixed(airr, "barcode_airr"))
        sources.append((placed.join(ids, "sequence_id", "left_semi"), "sequence_id"))
    return sources


def fasta_sources(fasta: DataFrame, mapping: DataFrame | None = None) -> Sources:
    """Header of the record as ``fasta_header`` and all columns of its row in the map.

    Of several rows of one id the last one counts as a whole, as it does for the
    cell.  The map's id column itself is left out, whatever its case.
    """
    sources = [_headers(fasta, "fasta_header")]
    if mapping is not None:
        columns = [c for c in mapping.columns if c.lower() not in ("seq_no", "sequence_id")]
        row = F.struct(F.col("seq_no"), *[F.col(f"`{c}`") for c in columns])
        last = mapping.select(first_present(mapping, ["sequence_id"]).alias("sequence_id"), "seq_no", row.alias("_row"))
        last = last.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.max_by("_row", "seq_no").alias("_row"))
        sources.append((last.select("sequence_id", "_row.*"), "sequence_id"))
    return sources


def assembler_annotations(records: DataFrame, annot: DataFrame, report: DataFrame | None = None,
                          airr: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """The sidecar of ``cells.from_assembler``: one row per record."""
    return cells.source_annotations(records, assembler_sources(annot, report, airr, named))


def fasta_annotations(records: DataFrame, fasta: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The sidecar of ``cells.from_fasta``: one row per record."""
    return cells.source_annotations(records, fasta_sources(fasta, mapping))
