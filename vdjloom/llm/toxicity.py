"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and word beginnings, hashed to a fixed number of
terms.  The machine adds a weight per term and, for every pair of terms, the
product of their factors, so that two terms can matter together that do not
matter alone.  It is trained with numpy on a bounded sample of labelled rows;
its size is fixed, so it travels to the tasks that score every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.llm.words import prefix_hashes, scan

#: Terms: 2 to this power.
BITS = 20
#: Labelled rows that are learned from, at most.
SAMPLE = 16_000
FACTORS = 8
#: Bytes of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 6)
#: A term is learned if it is in so many sampled texts; those whose share among toxic
#: texts differs by so many standard deviations are learned first, the others with them after that.
LEAST_TEXTS, LEAST_Z = 5, 4.0
#: Terms of one training text, at most: those with the smallest hashes. Texts that are scored are whole.
TEXT_TERMS = 4_000
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.05, 1e-3
#: Rounds with all terms, and the squared gradient the late terms start with: the more, the smaller their steps.
LATE_EPOCHS, LATE_START = 8, 1e-4
PREDICT = 0.3


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # of each term: its row in the arrays below, or -1
    weight: np.ndarray
    factor: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probability for each of ``rows`` texts; (doc, term) are its distinct terms, in order of doc."""
        at = self.slot[term]
        known = at >= 0
        doc, at = doc[known], at[known]
        z = np.full(rows, self.bias)
        if len(doc):
            here, start = np.unique(doc, return_index=True)
            z[here] += np.add.reduceat(self.weight[at], start)
            v = self.factor[at]
            total = np.add.reduceat(v, start, axis=0)
            z[here] += 0.5 * (total ** 2 - np.add.reduceat(v ** 2, start, axis=0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms(column, keep: np.ndarray | None = None):
    """For pieces of a text column: first row, rows, and the distinct (row, term) pairs in order.

    ``keep`` marks the terms that matter; the others are left out early.
    """
    for words in scan(column):
        hashes = [words.hash, *(prefix_hashes(words, n) ^ np.uint64(n) for n in BEGINNINGS)]
        term = np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes])
        row = np.tile(words.row, len(hashes))
        if keep is not None:
            mask = keep[term]
            term, row = term[mask], row[mask]
        pair = np.unique((row << BITS) | term)
        yield words.first, words.rows, pair >> BITS, pair & ((1 << BITS) - 1)


def train(lists: list[np.ndarray], label: np.ndarray, seed: int = 7) -> Machine:
    """Fit a machine to texts given as arrays of distinct terms, by mini-batches with adaptive steps."""
    label = label.astype(np.float64)
    slot = np.full(1 << BITS, -1, np.int32)
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3) if len(label) else 1e-3
    bias = float(np.log(rate / (1 - rate)))
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    seen = np.bincount(flat, minlength=1 << BITS)
    toxic = np.bincount(flat, weights=label[owner], minlength=1 << BITS)
    spread = np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    often = seen >= LEAST_TEXTS
    alone = often & (np.abs(toxic - seen * rate) >= LEAST_Z * spread)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(0), np.zeros((0, FACTORS))
    gw2, gv2, gb2 = np.zeros(0), np.zeros((0, FACTORS)), 1e-6
    for chosen, epochs, start in ((alone, EPOCHS, 1e-6), (often & ~alone, LATE_EPOCHS, LATE_START)):
        new = np.flatnonzero(chosen)
        slot[new] = len(w) + np.arange(len(new), dtype=np.int32)
        w, v = np.r_[w, np.zeros(len(new))], np.r_[v, rng.normal(0, 0.02, (len(new), FACTORS))]
        gw2, gv2 = np.r_[gw2, np.full(len(new), start)], np.r_[gv2, np.full((len(new), FACTORS), start)]
        at = slot[flat]
        known = at >= 0
        at = at[known]
        bounds = np.searchsorted(owner[known], np.arange(len(lists) + 1))
        for _ in range(epochs if len(new) else 0):
            for part in np.array_split(rng.permutation(len(lists)), max(1, len(lists) // BATCH)):
                idx = np.concatenate([at[bounds[i]:bounds[i + 1]] for i in part])
                doc = np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part])
                total = np.stack([np.bincount(doc, v[idx, f], len(part)) for f in range(FACTORS)], axis=1)
                square = np.bincount(doc, (v[idx] ** 2).sum(axis=1), len(part))
                z = bias + np.bincount(doc, w[idx], len(part)) + 0.5 * ((total ** 2).sum(axis=1) - square)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
                gw = np.bincount(idx, g[doc], len(w)) + DECAY * w / len(w)
                pull = g[doc][:, None] * (total[doc] - v[idx])
                gv = np.stack([np.bincount(idx, pull[:, f], len(w)) for f in range(FACTORS)], axis=1) + DECAY * v / len(w)
                gb = g.sum()
                gw2, gv2, gb2 = gw2 + gw ** 2, gv2 + gv ** 2, gb2 + gb ** 2
                w, v, bias = w - RATE * gw / np.sqrt(gw2), v - RATE * gv / np.sqrt(gv2), bias - RATE * gb / np.sqrt(gb2)
    return Machine(float(bias), slot, w, v)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` labelled rows that are not held out, chosen by hash of their id.

    A row without label, id or text is not learned from; of several labels of
    one id the larger counts.
    """
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    share = min(1.0, 1.2 * sample / max(1, usable.count()))
    key = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = usable.where(F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(key, "doc_id").limit(sample)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(
        F.broadcast(picked), "doc_id")  # no more than ``sample`` pairs of numbers

    def run(batches):
        for batch in batches:
            for first, rows, row, term in terms(batch.column(1)):
                bounds = np.searchsorted(row, np.arange(rows + 1))
                few = np.arange(len(row)) - bounds[row] < TEXT_TERMS  # terms are hashes, in order within a text
                row, term = row[few], term[few]
                bounds = np.searchsorted(row, np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(2).slice(first, rows),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(term.astype(np.int32)))],
                    ["doc_id", "toxic", "terms"])

    got = texts.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        run, "doc_id bigint, toxic int, terms array<int>")
    # Rows that share an id count once, so that no more than ``sample`` texts reach the driver.
    got = got.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("terms"), "toxic", "terms")).alias("t")).select(
        "doc_id", "t.toxic", "t.terms").toArrow().sort_by("doc_id")
    lists = [x.values.to_numpy() for x in got["terms"]]
    return train(lists, got["toxic"].to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); null text counts as empty."""
    # Plain arrays: a broadcast class would have to be importable on the executors.
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.slot, machine.weight, machine.factor))

    def run(batches):
        m = Machine(*shared.value)
        keep = m.slot >= 0
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, rows, row, term in terms(batch.column(1), keep):
                out[first:first + rows] = m.score(row, term, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= PREDICT).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on ``labels`` (doc_id, toxic) and score all ``docs`` (doc_id, text); other columns are ignored.

    Without a usable label the score is the same low value for every text.
    """
    return score(docs, fit(docs, labels, sample))
