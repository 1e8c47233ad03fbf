"""Single-cell V(D)J contigs normalised to one record schema.

Records have sequence_id, sequence, cell_id, umi_count, read_count, is_cell,
high_confidence, productive.  A value the source lacks stays NULL, and no cell
is ever invented: rows without one are left out and counted by reason.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx
from vdjloom.functions.durable import checkpoint, stored
from vdjloom.operators.filters import first_by_id, valid_sequence
from vdjloom.sources.text import first_present

RECORD = ("sequence_id", "sequence", "cell_id", "umi_count", "read_count", "is_cell",
          "high_confidence", "productive")

# Columns that carry annotation calls and are left out of records.
ANNOTATION_COLUMNS = (
    r".*_call$", r".*_identity$", r".*_alignment$", r".*_cigar$",
    r"^v_gene$", r"^d_gene$", r"^j_gene$", r"^c_gene$",
    r"^junction(_aa)?$", r"^cdr3(_nt|_aa)?$", r"^fwr[1-4](_aa)?$", r"^cdr[12](_nt|_aa)?$",
    r"^chain$", r"^rev_comp$", r"^productive$",
)

# Barcode columns, chain column prefixes and the marks for "no
# chain" in an assembler's barcode report.
REPORT_BARCODES = ["#barcode", "barcode", "cell_barcode"]
CHAIN_PREFIXES = ("chain", "secondary_chain")
NO_CHAIN = ("*", "-", "")

#: A token of the barcode report that occurs so often is held by every task, see ``_rare_tokens``.
OFTEN = 100
#: So many of them at most, found by a sketch of so many tokens.
MOST_OFTEN, SKETCHED = 1_000, 10_000


class UnresolvedCells(ValueError):
    """Records whose cell is missing or ambiguous; the run stops."""


_ANNOTATION = re.compile("|".join(f"(?:{p})" for p in ANNOTATION_COLUMNS), re.IGNORECASE)


def strip_annotation_columns(df: DataFrame) -> DataFrame:
    """Only the columns that state nothing about genes, regions or alignments."""
    return df.select([F.col(f"`{c}`") for c in df.columns if not _ANNOTATION.match(c)])


def _record(sequence_id, sequence, cell_id, umis=None, reads=None, is_cell=None,
            high_confidence=None, productive=None) -> list[Column]:
    none_int, none_bool = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")

    def flag(c):
        return none_bool if c is None else fx.to_bool(c)

    def number(c):
        return none_int if c is None else fx.to_int(c)

    values = (sequence_id, sequence, cell_id, number(umis), number(reads), flag(is_cell),
              flag(high_confidence), flag(productive))
    return [v.alias(n) for n, v in zip(RECORD, values)]


def _latest(fasta: DataFrame) -> DataFrame:
    """One sequence per id, the last one in the file."""
    return fasta.groupBy("sequence_id").agg(
        F.max_by("sequence", "seq_no").alias("sequence"))


# -- contig table and AIRR table ------------------------------------------------------

def contig_rows(fasta: DataFrame, table: DataFrame) -> DataFrame:
    """Annotation rows with their sequence and the reason they are left out
    (NULL for those that become records)."""
    seqs = _latest(fasta).select(
        F.col("sequence_id").alias("_id"), F.col("sequence").alias("_sequence"))
    rows = table.withColumn("_id", first_present(table, ["contig_id"]))
    # Rows without an id cannot match; they skip the join's shuffle key.
    joined = rows.join(seqs, "_id", "left")
    reason = (
        F.when(F.col("_id").isNull(), F.lit("rows_without_contig_id"))
        .when(F.col("_sequence").isNull(), F.lit("rows_without_fasta_sequence"))
        .when(first_present(table, ["barcode"]).isNull(), F.lit("rows_without_barcode")))
    return joined.withColumn("_reason", reason)


def from_contigs(fasta: DataFrame, table: DataFrame, allow_productive: bool = False
                 ) -> DataFrame:
    """Records from a contig FASTA and its annotation table."""
    rows = contig_rows(fasta, table).filter(F.col("_reason").isNull())
    return rows.select(*_record(
        F.col("_id"), F.col("_sequence"), first_present(table, ["barcode"]),
        first_present(table, ["umis"]), first_present(table, ["reads"]),
        first_present(table, ["is_cell"]), first_present(table, ["high_confidence"]),
        first_present(table, ["productive"]) if allow_productive else None), "seq_no")


def contig_report(fasta: DataFrame, table: DataFrame) -> DataFrame:
    """One row of counts: input, records written, rows left out by reason."""
    reasons = ("rows_without_contig_id", "rows_without_barcode", "rows_without_fasta_sequence")
    rows = contig_rows(fasta, table).agg(
        F.count("*").alias("annotation_rows"),
        *[F.count_if(F.col("_reason") == r).alias(r) for r in reasons],
        F.count_if(F.col("_reason").isNull()).alias("records_written"))
    ids = _latest(fasta).select("sequence_id")
    named = table.select(first_present(table, ["contig_id"]).alias("sequence_id")).filter(
        "sequence_id IS NOT NULL").distinct().withColumn("_named", F.lit(True))
    files = ids.join(named, "sequence_id", "left").agg(
        F.count("*").alias("fasta_records"),
        F.count_if(F.col("_named").isNull()).alias("fasta_records_without_annotation"))
    return files.withColumn("_one", F.lit(1)).join(
        rows.withColumn("_one", F.lit(1)), "_one").drop("_one")


def airr_rows(table: DataFrame) -> DataFrame:
    missing = first_present(table, ["sequence_id"]).isNull() | first_present(
        table, ["sequence"]).isNull()
    reason = F.when(missing, F.lit("rows_without_sequence")).when(
        first_present(table, ["cell_id"]).isNull(), F.lit("rows_without_barcode"))
    return table.withColumn("_reason", reason)


def from_airr(table: DataFrame, allow_productive: bool = False) -> DataFrame:
    """Records from an AIRR rearrangement table.

    In these exports ``duplicate_count`` counts UMIs and ``consensus_count``
    reads.
    """
    rows = airr_rows(table).filter(F.col("_reason").isNull())
    return rows.select(*_record(
        first_present(table, ["sequence_id"]), first_present(table, ["sequence"]),
        first_present(table, ["cell_id"]),
        first_present(table, ["umi_count", "duplicate_count"]),
        first_present(table, ["read_count", "reads", "consensus_count"]),
        first_present(table, ["is_cell"]), first_present(table, ["high_confidence"]),
        first_present(table, ["productive"]) if allow_productive else None), "seq_no")


def airr_report(table: DataFrame) -> DataFrame:
    return airr_rows(table).agg(
        F.count("*").alias("airr_rows"),
        *[F.count_if(F.col("_reason") == r).alias(r)
          for r in ("rows_without_sequence", "rows_without_barcode")],
        F.count_if(F.col("_reason").isNull()).alias("records_written"))


# -- plain FASTA with a barcode map --------------------------------------------------

def resolve_fasta(fasta: DataFrame, mapping: DataFrame | None = None,
                  regex: str | None = None) -> DataFrame:
    """FASTA records with the cell found for each (NULL when there is none).

    The map wins (its last row per id), the header expression is the
    fallback: its first group, or the whole match without groups.
    """
    if mapping is None and not regex:
        raise ValueError("give a barcode map or a header expression; without one no cell "
                         "can be recovered")
    rows = fasta
    if mapping is not None:
        kept = strip_annotation_columns(mapping)
        keyed = kept.select(
            first_present(kept, ["sequence_id"]).alias("sequence_id"),
            F.struct(*[first_present(kept, [n]).alias(n)
                       for n in ("cell_id", "umi_count", "read_count")]).alias("_m"), "seq_no")
        last = keyed.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(
            F.max_by("_m", "seq_no").alias("_m"))
        rows = rows.join(last, "sequence_id", "left")
    else:
        rows = rows.withColumn("_m", F.lit(None).cast(
            "struct<cell_id:string,umi_count:string,read_count:string>"))
    found = F.col("_m.cell_id")
    if regex:
        groups = re.compile(regex).groups
        hit = F.regexp_extract("header", regex, 1 if groups else 0)
        found = F.coalesce(found, F.nullif(hit, F.lit("")))
    return rows.withColumn("_cell", found)


def from_fasta(fasta: DataFrame, mapping: DataFrame | None = None, regex: str | None = None,
               check: bool = True) -> DataFrame:
    """Records from a FASTA; a record without a cell stops the run."""
    rows = resolve_fasta(fasta, mapping, regex)
    if check:
        lost = rows.filter(F.col("_cell").isNull())
        names = [r[0] for r in lost.select("sequence_id").limit(5).collect()]
        if names:
            raise UnresolvedCells(f"no cell for {lost.count()} sequences, e.g. {names}")
    return rows.filter(F.col("_cell").isNotNull()).select(*_record(
        F.col("sequence_id"), F.col("sequence"), F.col("_cell"), F.col("_m.umi_count"),
        F.col("_m.read_count")), "seq_no")


def fasta_report(fasta: DataFrame, mapping: DataFrame | None = None, regex: str | None = None
                 ) -> DataFrame:
    return resolve_fasta(fasta, mapping, regex).agg(
        F.count("*").alias("fasta_records"),
        F.count_if(F.col("_m.cell_id").isNotNull()).alias("barcodes_from_map"),
        F.count_if(F.col("_cell").isNull()).alias("records_without_barcode"),
        F.count_if(F.col("_cell").isNotNull()).alias("records_written"))


# -- assembler output ------------------------------------------------------------------

def _chains(report: DataFrame) -> list[str]:
    return [c for c in report.columns if c.lower().startswith(CHAIN_PREFIXES)]


def _is_filled(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.trim(value).isin(*NO_CHAIN), F.lit(False))


def chain_fields(report: DataFrame) -> DataFrame:
    """(cell, place, tokens): one row per chain field of the barcode report."""
    cells = F.posexplode(F.array(*[F.col(f"`{c}`") for c in _chains(report)]))
    rows = report.withColumn("_cell", first_present(report, REPORT_BARCODES)).filter(
        F.col("_cell").isNotNull()).select("_cell", "seq_no", cells.alias("_at", "_value"))
    filled = rows.filter(_is_filled(F.col("_value")))
    return filled.select(
        F.col("_cell").alias("cell"), F.struct("seq_no", "_at").alias("place"),
        F.transform(F.split("_value", ","), lambda t: F.trim(t)).alias("tokens"))


def _rare_tokens(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """``tokens`` without the most frequent ones that are no contig.

    Genes, marks and the like stand in most chain fields; a task meets each of
    them once to count it, and no single task joins all places of one.
    """
    # The tokens with a share of one in some thousands are all among them; a sketch finds them without moving a token.
    found = tokens.agg(F.call_function("approx_top_k", F.col("token"), F.lit(MOST_OFTEN), F.lit(SKETCHED)).alias("top"))
    often = found.select(F.explode("top").alias("top")).select("top.item", "top.count").filter(
        (F.col("count") >= OFTEN) & F.col("item").isNotNull()).select(F.col("item").alias("token"))
    often = F.broadcast(checkpoint(often))
    contigs = ids.join(often, ids["sequence_id"] == often["token"], "left_semi").distinct()
    others = often.join(F.broadcast(checkpoint(contigs)), often["token"] == F.col("sequence_id"), "left_anti")
    return tokens.join(F.broadcast(others), "token", "left_anti")


def named_contigs(report: DataFrame, ids: DataFrame) -> DataFrame:
    """(place, cell, contig, reads) of the chain fields that name a contig: the first
    of the field's tokens that is a known one; the token before it is the read count."""
    tokens = chain_fields(report).select(
        "cell", "place", F.xxhash64("tokens").alias("field"), F.posexplode(F.transform(
            "tokens", lambda t, i: F.struct(t.alias("token"), F.get("tokens", i - 1).alias("before")))).alias("at", "t"))
    tokens = tokens.select("cell", "place", "field", "at", F.col("t.token").alias("token"), F.col("t.before").alias("before"))
    known = _rare_tokens(tokens, ids).join(ids.select(F.col("sequence_id").alias("token")), "token", "left_semi")
    first = known.groupBy("place", "cell", "field").agg(F.min(F.struct("at", "token", "before")).alias("t"))
    return first.select("place", "cell", F.col("t.token").alias("contig"), fx.to_int(F.col("t.before")).alias("reads"))


def _mappings(annot: DataFrame, report: DataFrame | None, airr: DataFrame | None,
              named: DataFrame | None = None) -> DataFrame:
    """(contig, cell, n_cells, mappings, read_count, others): ``others`` counts the
    mappings to another cell than the first one given."""
    if report is None and airr is None:
        raise ValueError("give a barcode report or an AIRR table")
    ids = annot.select("sequence_id").distinct()
    found = []
    if report is not None:
        found.append((named_contigs(report, ids) if named is None else named).select(
            "contig", "cell", "reads", F.struct(F.lit(0).alias("source"), F.col(
                "place.seq_no").alias("row"), F.col("place._at").alias("at")).alias("order")))
    if airr is not None:
        rows = _airr_cells(airr).select("contig", "cell", F.lit(None).cast("bigint").alias("reads"), F.struct(
            F.lit(1).alias("source"), F.col("seq_no").alias("row"), F.lit(0).alias("at")).alias("order"))
        found.append(rows.join(ids.withColumnRenamed("sequence_id", "contig"), "contig", "left_semi"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    by_cell = every.groupBy("contig", "cell").agg(
        F.count("*").alias("k"), F.min("order").alias("order"),
        F.min(F.when(F.col("reads").isNotNull(), F.struct("order", "reads"))).alias("read"))
    return by_cell.groupBy("contig").agg(
        F.min_by("cell", "order").alias("cell"), F.count("*").alias("n_cells"),
        F.sum("k").alias("mappings"), F.min("read")["reads"].alias("read_count"),
        (F.sum("k") - F.min_by("k", "order")).alias("others"))


def _airr_cells(airr: DataFrame) -> DataFrame:
    return airr.select(
        first_present(airr, ["sequence_id"]).alias("contig"),
        first_present(airr, ["cell_id"]).alias("cell"), "seq_no").filter(
        "contig IS NOT NULL AND cell IS NOT NULL")


def contig_cells(annot: DataFrame, report: DataFrame | None = None, airr: DataFrame | None = None,
                 named: DataFrame | None = None) -> DataFrame:
    """(contig, cell, n_cells, mappings, read_count) over all sources.

    Rows that agree are duplicates; the first read count given for the contig
    is kept.  ``n_cells`` above 1 is a conflict.  ``named`` is what
    ``named_contigs`` says of the report, if the caller has written it.
    """
    return _mappings(annot, report, airr, named).drop("others")


def from_assembler(annot: DataFrame, report: DataFrame | None = None,
                   airr: DataFrame | None = None, check: bool = True,
                   named: DataFrame | None = None) -> DataFrame:
    """Records from assembled contigs.

    Contigs of no cell are left out.  With ``check``, a contig of two cells
    stops the run, and so does a source that places no contig at all.
    """
    cells = contig_cells(annot, report, airr, named)
    if check:
        cells = stored(cells)
        torn = cells.filter("n_cells > 1")
        names = [r[0] for r in torn.select("contig").limit(5).collect()]
        if names:
            raise UnresolvedCells(
                f"{torn.count()} contigs belong to more than one cell, e.g. {names}")
        if cells.isEmpty():
            raise UnresolvedCells("no contig is placed in a cell; are the tables of one run?")
    seqs = annot.groupBy("sequence_id").agg(
        F.max_by("sequence", "seq_no").alias("sequence"), F.min("seq_no").alias("seq_no"))
    rows = seqs.join(cells, seqs["sequence_id"] == cells["contig"])
    return rows.select(*_record(
        F.col("sequence_id"), F.col("sequence"), F.col("cell"), None,
        F.col("read_count").cast("string")), "seq_no")


def mapping_report(annot: DataFrame, report: DataFrame | None = None,
                   airr: DataFrame | None = None) -> DataFrame:
    """One row of counts over the mappings of contigs to cells from all sources.

    A mapping after a contig's first one is a duplicate if it names the same
    cell, else a conflict; records and cells are those of contigs without one.
    """
    clear = F.col("others") == 0
    counts = _mappings(annot, report, airr).agg(
        F.coalesce(F.sum(F.col("mappings") - 1 - F.col("others")), F.lit(0)).alias("duplicate_mappings"),
        F.coalesce(F.sum("others"), F.lit(0)).alias("conflicting_mappings"),
        F.count_if(clear).alias("records_written"),
        F.count_distinct(F.when(clear, F.col("cell"))).alias("cells"))
    if airr is None:
        return counts.withColumns({
            "airr_rows": F.lit(0).cast("bigint"), "airr_rows_with_cell_id": F.lit(0).cast("bigint")})
    known = annot.select(F.col("sequence_id").alias("contig")).distinct()
    rows = airr.agg(F.count("*").alias("airr_rows"))
    placed = _airr_cells(airr).join(known, "contig", "left_semi").agg(
        F.count("*").alias("airr_rows_with_cell_id"))
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(rows.select("*", one), "_one").join(
        placed.select("*", one), "_one").drop("_one")


def assembler_report(annot: DataFrame, report: DataFrame) -> DataFrame:
    """One row of counts over a barcode report; see ``mapping_report`` for all sources."""
    ids = annot.select("sequence_id").distinct()
    named = stored(named_contigs(report, ids))  # counted, and united by contig
    one = F.lit(1).alias("_one")
    parsed = named.agg(F.count("*").alias("report_chain_fields_parsed"))
    barcode, filled = first_present(report, REPORT_BARCODES), F.lit(0)
    for c in _chains(report):
        filled += _is_filled(F.col(f"`{c}`")).cast("int")
    rows = report.agg(
        F.count("*").alias("report_rows"), F.count_if(barcode.isNull()).alias("report_rows_without_barcode"),
        F.coalesce(F.sum(F.when(barcode.isNotNull(), filled)), F.lit(0)).alias("_fields"))
    counts = parsed.select("*", one).join(rows.select("*", one), "_one").select(
        "report_chain_fields_parsed",
        (F.col("_fields") - F.col("report_chain_fields_parsed")).alias("report_chain_fields_unmatched"),
        "report_rows", "report_rows_without_barcode", "_one")
    cells = contig_cells(annot, report, named=named)
    placed = ids.join(cells, ids["sequence_id"] == cells["contig"], "left").agg(
        F.count("*").alias("annot_contigs"),
        F.count_if(F.col("n_cells") > 1).alias("conflicting_contigs"),
        F.count_if(F.col("contig").isNull()).alias("contigs_not_in_cell_report"),
        F.count("contig").alias("contigs_placed"))
    return counts.join(placed.select("*", one), "_one").drop("_one")


# -- validation and sidecar ----------------------------------------------------------

def validate_records(records: DataFrame, check: bool = True) -> DataFrame:
    """Drop invalid sequences and repeated ids (the first stays)."""
    good = first_by_id(valid_sequence(records, "sequence"), "sequence_id")
    if check:
        # Records are made once: the check reads what the result reads.
        good = checkpoint(good)
        if good.isEmpty():
            raise ValueError("no valid sequences remained after validation")
    return good


def validation_report(records: DataFrame) -> DataFrame:
    valid = valid_sequence(records, "sequence", keep="both")
    return valid.agg(
        F.count("*").alias("records"), F.count_if(~F.col("_pass")).alias("invalid"),
        (F.count_if("_pass") - F.count_distinct(
            F.when(F.col("_pass"), F.col("sequence_id")))).alias("duplicates"))


def count_cells(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"),
                       F.count_distinct("cell_id").alias("cells"))


def merge_annotations(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """One row per id with every column of every source as text.

    Sources are (table, id column).  Columns keep their first-seen order; for
    a cell named more than once the last non-empty value stays.
    """
    order: list[str] = []
    parts = []
    for number, (table, id_col) in enumerate(sources):
        columns = [c for c in table.columns if c not in ("seq_no", "sequence_id")
                   and not c.startswith("_")]
        order += [c for c in columns if c not in order]
        parts.append(table.select(
            F.nullif(F.col(f"`{id_col}`"), F.lit("")).alias("sequence_id"),
            F.struct(F.lit(number).alias("source"), F.col("seq_no").alias("row")).alias("_o"),
            *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]
        ).filter("sequence_id IS NOT NULL"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    # Rows move once, as they are, and are read in order: an aggregate would write each column with an order of its own.
    ordered = Window.partitionBy("sequence_id").orderBy("_o")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = every.select("sequence_id", F.lead(F.lit(1)).over(ordered).alias("_more"), *[
        F.last(F.nullif(F.col(f"`{c}`"), F.lit("")), True).over(so_far).alias(c) for c in order])
    return seen.filter("_more IS NULL").select(
        "sequence_id", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in order])


def source_annotations(records: DataFrame, sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """The sidecar: per record, every source column as it was read."""
    merged = merge_annotations(sources)
    columns = [c for c in merged.columns if c != "sequence_id"]
    joined = records.select("sequence_id").join(merged, "sequence_id", "left")
    return joined.select("sequence_id", *[
        F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
