"""Hard negatives by threshold joins over inverted indexes with suffix-norm bounds.

Candidates lie in blocks of bounded size.  For a threshold, a block's index is
built dimension by dimension, strongest first: a row is left out of the lists
of its last dimensions once the norm of what is left there, times the largest
anchor norm, can no longer reach the threshold alone.  An anchor walks the
lists, partial scores accumulate, and a row leaves when its partial score plus
the product of the remaining norms stays below the anchor's threshold; only
survivors are scored in full, over the dimensions left out as well.

An anchor's positives are found first, over the blocks of its own label.  Each
of them opens a window of scores for negatives.  The join over the other blocks
starts with high thresholds; anchors with a window that is not full come again
with a lower one, down to the bottom of their windows, so the result is exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjloom.llm.shared import parts, written

#: Candidates of a block and anchors of a chunk, at most (about: rows are dealt by hash).
BLOCK, ANCHORS = 16_384, 4_096
#: Dimensions whose lists are walked between two rounds of pruning.
STEP = 8
#: Pairs go on alone, instead of as a matrix, once they are less than this share.
SPARSE = 0.15
#: Rows that first thresholds are guessed from (a fixed, bounded sample; guesses never decide a result).
SAMPLE = 2_048
#: Joins with lowered thresholds before one goes to the bottom of the windows.
ROUNDS = 3
_CHUNK = 128

_BYTES = ["ids", "rows", "labels", "vectors", "least", "tops"]
_LOWEST, _HIGHEST = -(2 ** 63), 2 ** 63 - 1


def usable(vectors: DataFrame, scale: int, flip: int) -> DataFrame:
    """row, id, label, dim, v of the rows that take part; ``row`` tells repeated rows apart."""
    x = F.col("embedding")
    label = F.col("label").cast("bigint")
    ok = F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(ok).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"),
        F.when(F.col("vec_id") % flip == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.size(x).alias("dim"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _pack(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: what its rows hold, as bytes; numbers in the smallest type that fits.

    ``rows`` has row, id, label, v and, for anchors, least and tops (arrays of one length).
    """
    asks = "tops" in rows.columns

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort([table["row"].to_numpy(), table["id"].to_numpy()])
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        v = flat("v")[order]
        low, high = int(v.min(initial=0)), int(v.max(initial=0))
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        held = {"ids": table["id"].to_numpy()[order], "rows": table["row"].to_numpy()[order],
                "labels": table["label"].to_numpy()[order], "vectors": v.astype(kind)}
        if asks:
            held |= {"least": table["least"].to_numpy()[order], "tops": flat("tops")[order]}
        return pa.table({n: table[n].slice(0, 1) for n in keys} | {"kind": pa.array([np.dtype(kind).itemsize], pa.int32())} | {
            n: pa.array([np.ascontiguousarray(held[n]).tobytes() if n in held else None], pa.binary()) for n in _BYTES})

    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in keys] + ["kind int"] + [f"{n} binary" for n in _BYTES])
    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _unpack(cell: dict, dim: int) -> dict[str, np.ndarray]:
    out = {n: np.frombuffer(cell[n], np.int64) for n in ("ids", "rows", "labels", "least", "tops") if cell[n] is not None}
    n = len(out["ids"])
    return out | {"vectors": np.frombuffer(cell["vectors"], f"i{cell['kind']}").reshape(n, dim).astype(np.int64)} | (
        {"tops": out["tops"].reshape(n, -1)} if "tops" in out else {})


def floats_are_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every sum of products of the two is a whole number that a double holds."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return most < 2 ** 50


def over_threshold(anchors: np.ndarray, block: np.ndarray, least: np.ndarray):
    """(anchor, row, score) of all pairs with score >= least[anchor], some anchors at a time."""
    if not floats_are_exact(anchors, block):  # numbers too large for a double: exact, and without bounds
        for i, a in enumerate(anchors.astype(object)):
            scores = [min(max(sum(x * y for x, y in zip(a.tolist(), r, strict=True)), _LOWEST), _HIGHEST) for r in block.tolist()]
            hit = np.array([s >= least[i] for s in scores], dtype=bool)
            yield np.full(hit.sum(), i), np.flatnonzero(hit), np.array([s for s in scores if s >= least[i]], dtype=object)
        return
    n, dims = block.shape
    energy = (block.astype(np.float64) ** 2).sum(axis=0) * (anchors.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-energy, kind="stable")
    x, q = block[:, order].astype(np.float64), anchors[:, order].astype(np.float64)
    cuts = [*range(0, dims, STEP), dims]
    slack = 1 + 1e-9  # norms are rounded; a bound must never be too small
    rest = np.stack([np.sqrt((x[:, d:] ** 2).sum(axis=1)) for d in cuts]) * slack
    q_rest = np.stack([np.sqrt((q[:, d:] ** 2).sum(axis=1)) for d in cuts]) * slack
    for low in range(0, len(q), _CHUNK):
        part, t = q[low:low + _CHUNK], least[low:low + _CHUNK]
        floor = float(t.min())
        # Lists a row is in: up to the first cut behind which no anchor of the chunk reaches the threshold.
        strongest = q_rest[:, low:low + _CHUNK].max(axis=1, initial=0)
        covered = rest * strongest[:, None] < floor - 0.5
        listed = np.where(covered.any(axis=0), covered.argmax(axis=0), len(cuts) - 1)
        by = np.argsort(-listed, kind="stable")
        rows, length = x[by], [int((listed > g).sum()) for g in range(len(cuts) - 1)]
        if not length or not length[0]:
            if floor <= 0:  # vectors without dimensions, or all zero
                who, row = np.nonzero(np.zeros((len(part), n)) >= t[:, None])
                yield who + low, row, np.zeros(len(who))
            continue
        row_rest, ask_rest = rest[:, by], q_rest[:, low:low + _CHUNK]
        score = np.zeros((len(part), length[0]))
        # What a row can still gain; it stays as it is from the row's last list on.
        bound = np.full(score.shape, np.inf)
        who = row = value = gain = None
        for g in range(len(cuts) - 1):
            a, b, m = cuts[g], cuts[g + 1], length[g]
            if who is None:
                score[:, :m] += part[:, a:b] @ rows[:m, a:b].T
                bound[:, :m] = ask_rest[g + 1][:, None] * row_rest[g + 1][:m]
                alive = score + bound >= t[:, None] - 0.5
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    who, row = np.nonzero(alive)
                    value, gain = score[who, row], bound[who, row]
            else:
                on = row < m
                value[on] += np.einsum("ij,ij->i", part[who[on], a:b], rows[row[on], a:b])
                gain[on] = ask_rest[g + 1][who[on]] * row_rest[g + 1][row[on]]
                keep = value + gain >= t[who] - 0.5
                who, row, value, gain = who[keep], row[keep], value[keep], gain[keep]
        if who is None:
            who, row = np.nonzero(alive)
        for k in range(0, len(who), 1 << 18):
            w, r = who[k:k + (1 << 18)], row[k:k + (1 << 18)]
            full = np.rint(np.einsum("ij,ij->i", part[w], rows[r]))
            hit = full >= t[w]
            yield w[hit] + low, by[r[hit]], full[hit]


def _first(who: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Indices of each anchor's first k by score, ties by id, then row."""
    order = np.lexsort([row, ids, -score, who])
    start = np.searchsorted(who[order], who[order], side="left")
    return order[np.arange(len(order)) - start < k]


def _search(cells: DataFrame, keys: list[str], k: int, same: bool) -> DataFrame:
    """Rows of a cell's block that may be among the first k of an anchor's window, at or over its threshold.

    A cell (one value of ``keys``) is a chunk of anchors beside one or more blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        found = [np.zeros((6, 0), np.int64)]
        cell = table.to_pylist()
        chunk = next((r for r in cell if r["tops"] is not None), None)
        for row in cell if chunk else ():
            if row["tops"] is not None:
                continue
            c, asks = _unpack(row, row["dim"]), _unpack(chunk, row["dim"])
            if not same:  # a block is of one label
                other = asks["labels"] != c["labels"][0]
                asks = {n: x[other] for n, x in asks.items()}
            for who, at, score in over_threshold(asks["vectors"], c["vectors"], asks["least"]):
                if same:
                    others = c["rows"][at] != asks["rows"][who]
                    who, at, score = who[others], at[others], score[others]
                score = score.astype(np.int64)
                for w in range(asks["tops"].shape[1]):
                    inside = score <= asks["tops"][who, w]
                    a, r, v = who[inside], at[inside], score[inside]
                    best = _first(a, v, c["ids"][r], c["rows"][r], k)
                    a, r, v = a[best], r[best], v[best]
                    found.append(np.stack([asks["rows"][a], asks["ids"][a], np.full(len(a), w), c["rows"][r], c["ids"][r], v]))
        return pa.table(dict(zip(["anchor", "a_id", "window", "row", "id", "score"], np.concatenate(found, axis=1), strict=True)))

    hits = cells.groupBy(*keys).applyInArrow(run, "anchor bigint, a_id bigint, window bigint, row bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sample(rows: DataFrame) -> list:
    """At most SAMPLE rows, by hash, to guess thresholds from."""
    return rows.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select("row", "label", "dim", "v").collect()


def _guess(anchors: DataFrame, sample: list, nth: int, tops: bool) -> DataFrame:
    """Adds guess: for each of ``tops`` the nth best sampled score of other labels up to it, null without one.

    Without ``tops``: the nth best sampled score of the anchor's own label; so many rows do reach it.
    """
    known = {}
    for dim in {r["dim"] for r in sample}:
        here = [r for r in sample if r["dim"] == dim]
        known[dim] = (np.array([r["row"] for r in here], np.int64), np.array([r["label"] for r in here], np.int64),
                      np.array([r["v"] for r in here], np.int64).reshape(len(here), dim))
    shared = anchors.sparkSession.sparkContext.broadcast(known)  # SAMPLE rows at most
    names = ["row", "label", "dim", "v"] + ["tops"] * tops

    def run(batches):
        for batch in batches:
            out = []
            for a in batch.select(names).to_pylist():
                row, label, v = shared.value.get(a["dim"], (np.zeros(0, np.int64),) * 2 + (np.zeros((0, a["dim"]), np.int64),))
                q = np.array(a["v"], np.int64)
                if not floats_are_exact(q[None], v):
                    out.append([None] * (len(a["tops"]) if tops else 1))
                    continue
                scores = np.rint(v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
                ranked = np.sort(scores[label != a["label"] if tops else (label == a["label"]) & (row != a["row"])])[::-1]
                below = [ranked[ranked <= t] for t in a["tops"]] if tops else [ranked]
                out.append([int(b[nth - 1]) if len(b) >= nth else None for b in below])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "guess"])

    return anchors.mapInArrow(run, T.StructType([*anchors.schema.fields, T.StructField("guess", T.ArrayType(T.LongType()))]))


def _copies(count) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _windows(near: DataFrame, asked: DataFrame, positives: int) -> DataFrame:
    """Anchors with p (their positives), and the top and bottom of the window of each, padded to one length."""
    per = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # ``positives`` at most
    tops = F.concat(F.transform("p", lambda p: p["score"]), F.array_repeat(F.lit(_LOWEST), F.lit(positives) - F.size("p")))
    # The least whole n with 100 n >= 80 p is p less the fifth part of p, rounded down; over p if p is negative.
    return asked.join(per, asked["row"] == per["anchor"]).drop("anchor").withColumn("tops", tops).withColumn(
        "bottoms", F.expr("transform(p, x -> x.score - (x.score - pmod(x.score, 5)) div 5)")).withColumn(
        "bottoms", F.concat("bottoms", F.array_repeat(F.lit(_HIGHEST), F.lit(positives) - F.size("p"))))


def hard_negatives(vectors: DataFrame, k: int = 5, positives: int = 5, scale: int = 256, every: int = 100, flip: int = 7) -> DataFrame:
    """Negatives for every anchor (a row whose vec_id is divisible by ``every``) and each of its positives.

    ``vectors`` has vec_id, embedding and label.  Where vec_id is divisible by
    ``flip``, label becomes (label + 1) % 10; a component x counts as
    floor(scale * x); scores are integer inner products, higher first, ties by
    smaller vec_id.  Positives are the first ``positives`` other rows of the
    anchor's label, negatives the first ``k`` rows of other labels with
    80 * p <= 100 * n <= 100 * p, p and n the scores.  Returns anchor_id,
    positive_id, rank from 1, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part; vectors of different lengths don't meet.  Rows that share an id
    are rows of their own, as anchors and as candidates.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, scale, flip), "vectors")
    total = rows.count()
    asked = rows.where(F.col("id") % every == 0)
    # A label is dealt to as many blocks as its rows need.
    sizes = rows.groupBy("dim", "label").agg(F.count("*").alias("n")).withColumn("blocks", F.greatest(
        F.ceil(F.col("n") / BLOCK), F.least(F.lit(parts(spark)), F.floor(F.col("n") / 1024)), F.lit(1)).cast("int"))
    dealt = rows.join(sizes.drop("n"), ["dim", "label"])
    blocks = written(_pack(dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "dim", "label", "block"),
                     "candidate-blocks")
    sample = _sample(rows)

    # Positives: chunks of anchors of one label meet the blocks of that label.
    asks = asked.groupBy("dim", "label").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("chunks"))
    own = dealt.where(F.col("id") % every == 0).join(asks, ["dim", "label"])
    own = _guess(own, sample, positives, tops=False).withColumns({
        "tops": F.array(F.lit(_HIGHEST)), "least": F.coalesce(F.get("guess", F.lit(0)), F.lit(_LOWEST)),
        "chunk": F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")})
    chunks = _pack(own, "dim", "label", "chunk", "blocks").withColumn("block", _copies(F.col("blocks"))).drop("blocks")
    beside = blocks.join(asks, ["dim", "label"]).withColumn("chunk", _copies(F.col("chunks"))).drop("chunks")
    near = written(_search(chunks.unionByName(beside), ["dim", "label", "block", "chunk"], positives, same=True), "positives")

    # Negatives: chunks of all anchors meet all blocks, dealt to as many places.
    todo = _guess(_windows(near, asked, positives), sample, max(1, round(2 * k * len(sample) / max(1, total))), tops=True)
    empty, aim = lambda z: z["bottoms"] > z["tops"], lambda z: F.greatest(z["bottoms"], F.coalesce(z["guess"], z["bottoms"]))
    todo = written(todo.withColumn("aim", F.transform(
        F.arrays_zip("tops", "bottoms", "guess"), lambda z: F.when(empty(z), F.lit(_HIGHEST)).otherwise(aim(z)))).drop("guess"), "anchors")
    places, done = max(1, blocks.count()), []
    placed = blocks.withColumn("place", F.pmod(F.xxhash64("dim", "label", "block"), F.lit(places)).cast("int")).drop("label", "block")
    for turn in range(ROUNDS + 1):
        # A window with the aim _HIGHEST is settled.
        todo = todo.withColumn("least", F.array_min("aim")).where(F.col("least") < _HIGHEST)
        n = todo.count()
        if not n:
            break
        if turn == ROUNDS:
            todo = todo.withColumn("least", F.array_min(F.transform(
                F.arrays_zip("aim", "bottoms"), lambda z: F.when(z["aim"] < _HIGHEST, z["bottoms"]))))
        count = -(-n // ANCHORS)
        asking = todo.withColumn("tops", F.transform(F.arrays_zip("tops", "aim"), lambda z: F.when(
            z["aim"] < _HIGHEST, z["tops"]).otherwise(F.lit(_LOWEST))))
        chunks = _pack(asking.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")), "dim", "chunk").withColumn(
            "place", _copies(F.lit(places)))
        hits = written(_search(chunks.unionByName(placed.withColumn("chunk", _copies(F.lit(count)))), ["dim", "place", "chunk"], k, same=False),
                       "negatives")
        # A window is full with k rows at or over the threshold: all that is unseen is below it.
        full = hits.groupBy("anchor", "window").count().where(F.col("count") >= k).groupBy("anchor").agg(
            F.collect_list("window").alias("full"))  # ``positives`` at most
        settled = F.transform(F.arrays_zip("aim", "bottoms"), lambda z, w: (z["aim"] < _HIGHEST) & (
            F.array_contains(F.coalesce("full", F.array().cast("array<bigint>")), w.cast("bigint")) | (F.col("least") <= z["bottoms"])))
        state = written(todo.join(full, todo["row"] == full["anchor"], "left").withColumn("settled", settled).drop("anchor", "full"), "windows")
        windows = state.select(F.col("row").alias("anchor"), F.posexplode(F.arrays_zip("settled", "p", "bottoms")).alias("window", "w")).where(
            "w.settled").select("anchor", F.col("window").cast("bigint").alias("window"), "w.p", "w.bottoms")
        done.append(hits.join(windows, ["anchor", "window"]).where("score >= bottoms"))
        todo = written(state.withColumn("aim", F.transform(F.arrays_zip("aim", "bottoms", "settled"), lambda z: F.when(
            z["settled"] | (z["aim"] == _HIGHEST), F.lit(_HIGHEST)).otherwise(
            z["bottoms"] + F.shiftright(z["aim"] - z["bottoms"], 2)))).drop("settled", "least"), "anchors")
    if not done:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, done).select(
        F.col("a_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS a, q.vec_id AS anchor_id, c.r AS b, c.vec_id, q.label = c.label AS same,
         list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(q.v) = len(c.v)),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.vec_id, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
