"""Similarity join on word 5-grams by chosen paths.

Texts become sets of 5-word grams; equal sets are joined once and carry their
number of documents.  A set's sample is the smallest member under each of 128
hash orders.  From the root of a run, a node chooses one or two of the orders
(1.25 on average, one over the threshold), and each set goes to the child of
its member there: similar sets share members and so paths.  A node of few sets
is a bucket; a larger one is split again, up to a depth.  Runs repeat until a
pair at the threshold is met with the wanted recall.

Buckets are brute-forced on sketches (8 bits per order) into candidate groups.
Every group then meets once with its whole gram sets, and all pairs inside it
are compared exactly, so links are neither missed inside a group nor counted
twice, and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.llm.bits import bit_table, may_hold
from vdjloom.llm.components import components
from vdjloom.llm.shared import parts, written
from vdjloom.llm.words import Words, grams, mix, scan

GRAM = 5
THRESHOLD = 0.8
ORDERS = 128
RECALL = 0.99

#: Sets of a node that is compared as a bucket; splits of a node at most; sets of a block of a larger bucket or group.
LEAF, DEPTH, BUCKET_BLOCK, GROUP_BLOCK = 200, 6, 4096, 512
#: One node in so many chooses a second order: 1 + 1/4 = 1 / 0.8.
SECOND = 4

_SEEDS = mix(np.arange(1, 2 * ORDERS + 1, dtype=np.uint64))
_XOR = (_SEEDS[:ORDERS] >> np.uint64(32)).astype(np.uint32)
_ODD = (_SEEDS[ORDERS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair still shares a path after ``depth`` splits of one run."""
    lost = 0.0
    for _ in range(depth):
        apart = 1 - similarity * (1 - lost)
        lost = (1 - 1 / SECOND) * apart + apart ** 2 / SECOND
    return 1 - lost


def runs_for(recall: float, similarity: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold is missed with a chance of 1 - recall at most, even at full depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, DEPTH)))


def gram_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes, sorted within each row, and the bounds of the rows.

    A row of fewer words than a gram, but not none, has one gram of them all.
    """
    g = grams(words.hash, GRAM)
    row = words.row[:len(g)]
    whole = row == words.row[GRAM - 1:GRAM - 1 + len(g)]
    g, row = g[whole], row[whole]
    bounds = words.bounds()
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < GRAM))
    if len(short):
        extra = np.array([grams(words.hash[bounds[r]:bounds[r + 1]], int(bounds[r + 1] - bounds[r]))[0] for r in short], np.uint64)
        g, row = np.r_[g, extra], np.r_[row, short]
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[first], row[first]
    return g, np.searchsorted(row, np.arange(words.rows + 1))


def _fingerprints(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's grams: equal for equal sets."""
    with np.errstate(over="ignore"):
        return tuple(
            np.diff(np.r_[np.uint64(0), np.cumsum(mix(g ^ np.uint64(salt)), dtype=np.uint64)][bounds]).astype(np.int64)
            for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F))


def _signatures(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Smallest value of each non-empty row under each order: rows x ORDERS, 32 bits."""
    low = (g >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, ORDERS), np.uint32)
    if len(full):
        starts = bounds[:-1][full]
        with np.errstate(over="ignore"):
            for i in range(ORDERS):
                out[full, i] = np.minimum.reduceat((low ^ _XOR[i]) * _ODD[i], starts)
    return out


def _profile(docs: DataFrame) -> DataFrame:
    """doc_id, own (hash of the text), n, f1, f2, sig of every row: the size, fingerprint and samples of its gram set."""

    def run(batches):
        for batch in batches:
            for words in scan(batch.column(1)):
                g, bounds = gram_sets(words)
                f1, f2 = _fingerprints(g, bounds)
                sig = _signatures(g, bounds).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, sig.size + 1, ORDERS, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.rows), batch.column(2).slice(words.first, words.rows),
                     pa.array(np.diff(bounds).astype(np.int64)), pa.array(f1), pa.array(f2), lists],
                    ["doc_id", "own", "n", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text")).mapInArrow(
        run, "doc_id bigint, own bigint, n bigint, f1 bigint, f2 bigint, sig array<int>")


def _children(path: Column, sig: str) -> Column:
    """Paths of a node's children: its hash chooses one or two orders."""
    order = lambda j: F.pmod(F.xxhash64(path, F.lit(j)), F.lit(ORDERS)).cast("int")
    child = lambda j: F.xxhash64(path, order(j), F.get(sig, order(j)))
    return F.when(F.pmod(F.xxhash64(path), F.lit(SECOND)) == 0, F.array(child(1), child(2))).otherwise(F.array(child(1)))


def buckets(sets: DataFrame, runs: int) -> DataFrame:
    """path, vid, blocks: the buckets of ``sets`` (vid, sig); ``blocks`` is 1 but for those that no split makes small."""
    roots = F.flatten(F.array(*[_children(F.xxhash64(F.lit(r)), "sig") for r in range(runs)]))
    rows = sets.select("vid", F.explode(roots).alias("path"))
    out = []
    for depth in range(1, DEPTH + 1):
        rows = written(rows, "paths")
        counts = rows.groupBy("path").count().where("count > 1")
        met = written(rows.join(counts, "path"), "nodes")
        done = met if depth == DEPTH else met.where(F.col("count") <= LEAF)
        out.append(done.select("path", "vid", F.when(F.col("count") <= LEAF, 1).otherwise(
            F.ceil(F.col("count") / BUCKET_BLOCK)).cast("int").alias("blocks")))
        large = met.where(F.col("count") > LEAF)
        if depth == DEPTH or large.isEmpty():
            break
        rows = large.join(sets, "vid").select("vid", F.explode(_children(F.col("path"), "sig")).alias("path"))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def _cells(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Deal the rows of a group to cells of two blocks (i <= j): adds cell, i, j and block."""
    block = F.pmod(F.xxhash64("vid", F.lit(7)), blocks).cast("int")
    return rows.withColumn("block", block).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({
        "i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).withColumn(
        "cell", F.xxhash64(group, "i", "j")).drop("_o")


def _by_cell(batches, columns: list[str]) -> Iterator[pa.Table]:
    """Whole cells from batches sorted by (cell, i, j, group): some cells at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([table[c].to_numpy() for c in columns])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if not len(change):
            rest = table
            continue
        yield table.slice(0, int(change[-1]))
        rest = table.slice(int(change[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(table: pa.Table, columns: list[str]) -> np.ndarray:
    keys = np.stack([table[c].to_numpy() for c in columns])
    return np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, table.num_rows]


def _forest(n: int, near) -> np.ndarray:
    """Smallest row of each row's component; ``near(x, rest)`` marks the rows of ``rest`` that x links to."""
    root, rest = np.arange(n), np.arange(n)
    while len(rest) > 1:
        pivot, rest = rest[0], rest[1:]
        queue = [pivot]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            found = rest[hit]
            root[found] = pivot
            queue += found.tolist()
            rest = rest[~hit]
    return root


def _candidates(met: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Edges a, b between sets of a bucket whose sketches agree in ``least`` orders or more, enough to connect them."""

    def run(batches):
        for table in _by_cell(batches, ["cell", "path"]):
            bounds = _bounds(table, ["cell", "path"])
            vid = table["vid"].to_numpy()
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, ORDERS)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= least]
            a, b = [vid[two]], [vid[two + 1]]
            for low, high in zip(bounds[:-1][size > 2], bounds[1:][size > 2], strict=True):
                s = sketch[low:high]
                root = _forest(high - low, lambda x, rest, s=s: (s[rest] == s[x]).sum(axis=1) >= least)
                hung = np.flatnonzero(root != np.arange(high - low))
                a.append(vid[low + root[hung]])
                b.append(vid[low + hung])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    sketch = F.unhex(F.concat_ws("", F.transform("sig", lambda v: F.lpad(F.hex(v.bitwiseAND(255)), 2, "0"))))
    rows = _cells(met, "path", F.col("blocks")).join(sets.select("vid", sketch.alias("sketch")), "vid").select(
        "cell", "path", "vid", "sketch")
    return (rows.repartition(parts(met.sparkSession), "cell").sortWithinPartitions("cell", "path")
            .mapInArrow(run, "a bigint, b bigint"))


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets, as products of 0/1 blocks."""
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    kept, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(kept), 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        x = np.zeros((len(sets), min(4096, len(kept) - low)), np.float32)
        x[owner[a:b], code[a:b] - low] = 1
        out += x[left] @ x[right].T
    return out


def _links(cells: DataFrame, threshold: float) -> DataFrame:
    """vid, root, links: exact links of each set inside its cell, counted in documents, and its component there."""

    def one(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = table["grams"].to_pylist()
        once = list({(v, s): k for k, (v, s) in enumerate(zip(table["vid"].to_pylist(), raw, strict=True))}.values())
        vid, times, block = (table[c].to_numpy()[once] for c in ("vid", "times", "block"))
        sets = [np.frombuffer(raw[k], np.uint64) for k in once]
        n = np.array([len(s) for s in sets])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = _overlaps(sets, left, right)
        near = common.astype(np.float64) * (1 + threshold) >= threshold * (n[left][:, None] + n[right][None]) - 1e-6
        near &= left[:, None] != right[None]
        links = np.zeros(len(vid), np.int64)
        links[left] += near @ times[right]
        if i != j:
            links[right] += near.T @ times[left]
        full = np.zeros((len(vid), len(vid)), bool)
        full[np.ix_(left, right)] = near
        full |= full.T
        root = _forest(len(vid), lambda x, rest: full[x, rest])
        return vid, vid[root], links

    def run(batches):
        for table in _by_cell(batches, ["cell", "component", "i", "j"]):
            bounds = _bounds(table, ["cell", "component", "i", "j"])
            found = [one(table.slice(a, b - a)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["vid", "root", "links"])

    return (cells.repartition(parts(cells.sparkSession), "cell").sortWithinPartitions("cell", "component", "i", "j")
            .mapInArrow(run, "vid bigint, root bigint, links bigint"))


def _gram_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The gram sets of the wanted sets (vid, first, f1, f2, ...), from the text of the first document of each.

    A bit table of the wanted names tells the scan which texts may be needed;
    the others' gram sets are neither made nor shuffled.
    """
    table, shift = bit_table(wanted.select(F.xxhash64("first")))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            named = may_hold(shared.value, shift, batch.column(2).to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(named))
            for words in scan(batch.column(1)):
                g, bounds = gram_sets(words)
                f1, f2 = _fingerprints(g, bounds)
                raw = pa.array([g[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.rows), pa.array(f1), pa.array(f2), raw], ["first", "f1", "f2", "grams"])

    first = F.col("doc_id").cast("bigint")
    made = docs.where("doc_id IS NOT NULL").select(first.alias("first"), "text", F.xxhash64(first)).mapInArrow(
        run, "first bigint, f1 bigint, f2 bigint, grams binary")
    return made.join(wanted, ["first", "f1", "f2"])


def _classes(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(profile of every row, the sets f1, f2, n with times, links, class and first, own: the smallest id and its text).

    A set is named by a number of its own (vid), not by a document: rows of
    different texts may share an id.
    """
    profile = written(_profile(docs), "profiles")
    named = profile.where("n > 0 AND doc_id IS NOT NULL")
    sets = written(named.groupBy("f1", "f2", "n").agg(
        F.min(F.struct("doc_id", "own")).alias("f"), F.count("*").alias("times"), F.first("sig").alias("sig")).select(
        F.monotonically_increasing_id().alias("vid"), "f1", "f2", "n", F.col("f.doc_id").alias("first"), "f.own", "times", "sig"), "sets")
    met = buckets(sets.select("vid", "sig"), runs_for(recall, threshold))
    # Three standard deviations of a sketch below the threshold, for pairs at the threshold.
    least = math.floor(ORDERS * (threshold - 3 * math.sqrt(threshold * (1 - threshold) / ORDERS)))
    groups = components(_candidates(met, sets.select("vid", "sig"), least))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    wanted = sets.select("vid", "first", "f1", "f2", "times").join(groups.withColumnRenamed("node", "vid"), "vid").join(
        sizes, "component").select("vid", "first", "f1", "f2", "times", "component", "size")
    rows = _gram_rows(docs, written(wanted, "wanted")).select("vid", "times", "component", "size", "grams")
    cells = _cells(rows, "component", F.ceil(F.col("size") / GROUP_BLOCK).cast("int")).drop("size")
    linked = written(_links(cells, threshold), "links")
    found = components(linked.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    return profile, (
        sets.drop("sig").join(linked.groupBy("vid").agg(F.sum("links").alias("links")), "vid", "left")
        .join(found.withColumnRenamed("node", "vid"), "vid", "left")
        .select("f1", "f2", "n", "first", "own", "times", F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("component", "vid").alias("class")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their 5-word grams is
    ``threshold`` or more; n_links counts the other documents linked to this
    one, copies included, and class_id is the smallest doc_id that links lead
    to.  Null or wordless texts link to nothing, texts of fewer than 5 words to
    texts of the same words.  Rows that share a doc_id are judged by their own
    texts, and each counts as a copy; a null doc_id takes no part: class_id
    null, no links.  Other columns are ignored.
    """
    profile, sets = _classes(docs, threshold, recall)
    sets = written(sets, "classes")
    smallest = sets.groupBy("class").agg(F.min("first").alias("class_id"))
    of_set = sets.join(smallest, "class").select(
        "f1", "f2", "n", "class_id", (F.col("links") + F.col("times") - 1).alias("n_links"))
    alone = profile.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return profile.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "f1", "f2", "n").join(of_set, ["f1", "f2", "n"]).select(
        "doc_id", "class_id", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of every class: the one with the smallest doc_id, ties by the text's hash; of wholly equal rows one.

    Null and wordless texts are in no class and stay.  Of rows without a doc_id
    one stays for each text that no row with an id has.
    """
    profile, sets = _classes(docs, threshold, recall)
    kept = sets.groupBy("class").agg(F.min(F.struct("first", "own")).alias("k")).select(
        F.col("k.first").alias("_id"), F.col("k.own").alias("_text"))
    held = profile.where("n > 0 AND doc_id IS NOT NULL").select(F.col("own").alias("_text")).distinct()
    lone = profile.where("n > 0 AND doc_id IS NULL").select(F.col("own").alias("_text")).distinct().join(
        held, "_text", "left_anti").select(F.lit(None).cast("bigint").alias("_id"), "_text")
    # The rows as they are, beside names that none of their columns can clash with.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))
    wordless = ~F.coalesce(F.col("row.text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    chosen = packed.where(~wordless).join(written(kept.unionByName(lone), "kept"), same)
    once = F.row_number().over(Window.partitionBy("id", "text").orderBy("id"))
    return (chosen.withColumn("once", once).where("once = 1").select("row.*")
            .unionByName(packed.where(wordless).select("row.*")))
