"""Benchmark decontamination by winnowing.

Of every 6 consecutive 5-word grams the one with the smallest hash is kept,
in training and test texts alike.  Any 10 words that both share hold 6 such
grams, so both keep the same one of them: joining on kept grams and comparing
up to 5 words to either side finds every shared span of 10 words or more, and
only such spans, since the words themselves are compared.

Items of fewer than 10 words are one window each; there every gram of that
many words is looked up, as winnowing promises nothing for short spans.

A bit table of the benchmark's kept grams, whose size is bounded, goes to the
scan of the documents; only grams found in it are written and joined, so the
shuffle follows the number of hits and not the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjloom.llm.bits import bit_table, may_hold
from vdjloom.llm.shared import free_name, written
from vdjloom.llm.words import Words, grams, scan

WINDOW = 10
GRAM = 5
KEEP = WINDOW - GRAM + 1

_HITS = T.ArrayType(T.StructType().add("fp", "long").add("size", "integer").add("pos", "integer").add(
    "words", T.ArrayType(T.StringType())).add("at", "integer"))


def _kept(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the grams that winnowing keeps; the last of equal minima."""
    g = grams(h, GRAM)
    n = len(g) - KEEP + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, KEEP):
        other = g[j:j + n]
        less = other <= best
        np.copyto(best, other, where=less)
        at[less] = np.flatnonzero(less) + j
    whole = row[:n] == row[WINDOW - 1:WINDOW - 1 + n]
    return np.unique(at[whole])


def _context(words: Words, bounds: np.ndarray, pos: int, size: int) -> tuple[list[str], int]:
    """Words from 5 before a kept gram to 5 after it within its row, and where the gram is.

    A gram of a short item (negative size) stands alone.
    """
    if size < 0:
        return [words.word(i) for i in range(pos, pos - size)], 0
    row = words.row[pos]
    side = WINDOW - GRAM
    low, high = max(bounds[row], pos - side), min(bounds[row + 1], pos + GRAM + side)
    return [words.word(i) for i in range(low, high)], int(pos - low)


def _fingerprints(words: Words, short: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(gram size, positions, hashes): the kept grams, and all grams of the short sizes.

    A short item of 5 words is told from a kept gram by its size, given as -5.
    """
    at = _kept(words.hash, words.row)
    found = [(GRAM, at, grams(words.hash, GRAM)[at])]
    for size in short:
        g = grams(words.hash, size)
        whole = np.flatnonzero(words.row[:len(g)] == words.row[size - 1:size - 1 + len(g)])
        with np.errstate(over="ignore"):
            found.append((-size, whole, g[whole] + np.uint64(size)))
    return found


def _item_grams(benchmark: DataFrame) -> DataFrame:
    """item, fp, size, words, at: of whole items below 10 words, else of kept grams."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"item": [], "fp": [], "size": [], "words": [], "at": []}
            ids = batch.column(0)
            for words in scan(batch.column(1)):
                bounds = words.bounds()
                lengths = np.diff(bounds)
                for size, at, fps in _fingerprints(words, sorted({int(n) for n in lengths if 0 < n < WINDOW})):
                    for pos, fp in zip(at.tolist(), fps.astype(np.int64).tolist(), strict=True):
                        row = words.row[pos]
                        if size < 0 and lengths[row] != -size:
                            continue
                        text, inside = _context(words, bounds, pos, size)
                        for name, value in zip(out, (ids[words.first + int(row)].as_py(), fp, size, text, inside), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item"], pa.string()), pa.array(out["fp"], pa.int64()), pa.array(out["size"], pa.int32()),
                 pa.array(out["words"], pa.list_(pa.string())), pa.array(out["at"], pa.int32())], list(out))

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(
        run, "item string, fp bigint, size int, words array<string>, at int")


def _scan_documents(docs: DataFrame, key: list[Column], table, shift: int, short: list[int]) -> DataFrame:
    """Per row: its key columns, the number of words, and its grams that may be in the benchmark."""
    keyed = docs.select(*key, "text")
    names = keyed.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    struct = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()),
                        ("words", pa.list_(pa.string())), ("at", pa.int32())])

    def run(batches):
        bits = shared.value
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)]
            for words in scan(batch.column(len(names))):
                bounds = words.bounds()
                counts[words.first:words.last] = np.diff(bounds)
                for size, at, fps in _fingerprints(words, short):
                    for i in np.flatnonzero(may_hold(bits, shift, fps)).tolist():
                        pos = int(at[i])
                        row = int(words.row[pos])
                        text, inside = _context(words, bounds, pos, size)
                        hits[words.first + row].append(
                            {"fp": int(fps[i].astype(np.int64)), "size": size, "pos": pos - int(bounds[row]), "words": text, "at": inside})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(counts), pa.array(hits, pa.list_(struct))],
                [*names, "n_words", "hits"])

    return keyed.mapInArrow(run, T.StructType(keyed.schema.fields[:-1]).add("n_words", "long").add("hits", _HITS))


def _same(step: int) -> Column:
    """Words in a row that are equal on both sides, going left (-1) or right (1) of the gram."""
    size = F.abs("size")
    here, there = (F.col("at"), F.col("b_at")) if step < 0 else (F.col("at") + size, F.col("b_at") + size)
    left = F.least(here, there)
    right = F.least(F.size("words") - here, F.size("b_words") - there)
    span = left if step < 0 else right
    differs = F.filter(
        F.sequence(F.lit(1), F.lit(WINDOW)),
        lambda i: (i <= span) & ~F.get("words", here + (-i if step < 0 else i - 1)).eqNullSafe(
            F.get("b_words", there + (-i if step < 0 else i - 1))))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, span)


def spans(hits: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared spans (rid, ctx, from_word, to_word exclusive), and the items of each ctx.

    A context that several items share is joined once; it is expanded to its
    items only per distinct (row, context).
    """
    context = F.sha2(F.concat_ws(" ", "words", F.array(F.col("at").cast("string"))), 256)
    held = items.withColumn("ctx", context)
    contexts = held.groupBy("fp", "size", "ctx").agg(
        F.first("words").alias("b_words"), F.first("at").alias("b_at"))
    size = F.abs("size")
    gram = lambda w, at: F.slice(w, F.col(at) + 1, size)
    met = (
        hits.join(contexts, ["fp", "size"])
        .where(gram("words", "at") == gram("b_words", "b_at"))
        .select("rid", "size", "pos", "ctx", _same(-1).alias("_l"), _same(1).alias("_r"))
        .where((F.col("size") < 0) | (F.col("_l") + F.col("_r") + GRAM >= WINDOW))
        .select("rid", "ctx", (F.col("pos") - F.when(F.col("size") > 0, F.col("_l")).otherwise(0)).alias("from_word"),
                (F.col("pos") + size + F.when(F.col("size") > 0, F.col("_r")).otherwise(0)).alias("to_word"))
    )
    return written(met, "spans"), held.select("ctx", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlap of every row of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside a shared window), n_items,
    items_sha256 (of the sorted item ids, comma-joined; of the empty text if
    there are none) and contaminated.  Null text has no words; a null item text
    has no window; a null item_id is left out of the list of items; repeated rows of either table each count as
    they stand; other columns are ignored.
    """
    return _overlap(docs, benchmark, [F.col("doc_id")]).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _overlap(docs: DataFrame, benchmark: DataFrame, key: list[Column]) -> DataFrame:
    items = written(_item_grams(benchmark), "bench-grams")
    short = sorted(-r["size"] for r in items.where("size < 0").select("size").distinct().collect())
    table, shift = bit_table(items.select("fp"))
    scanned = _scan_documents(docs, key, table, shift, short)
    scanned = written(scanned.withColumn("rid", F.monotonically_increasing_id()), "doc-grams")
    hits = scanned.where(F.size("hits") > 0).select("rid", F.inline("hits"))
    met, ctx_items = spans(hits, items)
    named = met.select("rid", "ctx").distinct().join(ctx_items, "ctx").select("rid", "item").distinct()
    listed = named.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    # Union of the spans of a row: each adds what lies beyond all that began before it.
    covered = met.select("rid", "from_word", "to_word").distinct().groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_spans")).select(
        "rid", F.aggregate(
            "_spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("edge")),
            lambda acc, s: F.struct(
                (acc["n"] + F.greatest(F.lit(0), s["to_word"] - F.greatest(s["from_word"], acc["edge"]))).alias("n"),
                F.greatest(acc["edge"], s["to_word"]).alias("edge")), lambda acc: acc["n"]).alias("n_hit"))
    found = covered.join(listed, "rid", "left")
    none = F.array().cast("array<string>")
    out = scanned.drop("hits").join(found, "rid", "left").withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("bigint"),
        "n_items": F.coalesce(F.size(F.coalesce("_items", none)), F.lit(0)).cast("bigint"),
        "items_sha256": F.sha2(F.array_join(F.coalesce("_items", none), ","), 256)})
    return out.drop("rid", "_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with all their columns."""
    tag = free_name(docs, "text_md5")
    marks = _overlap(docs, benchmark, [F.md5(F.coalesce("text", F.lit(""))).alias(tag)])
    dirty = marks.where("n_hit > 0").select(tag).distinct()
    return docs.withColumn(tag, F.md5(F.coalesce("text", F.lit("")))).join(dirty, tag, "left_anti").select(docs.columns)
