"""Exact top-k by inner product: columnar branch and bound.

Vectors lie in vertical blocks, a row per dimension.  A query meets a block
dimension group by dimension group: partial products accumulate, the norms of
what is left bound each candidate from both sides, and candidates whose upper
bound is below the k-th best lower bound leave; the survivors are compacted
before the next group.  Nothing is approximate: bounds only ever widen, and
scores are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.llm.shared import parts, written

#: Vectors of a candidate block and of a query block, at most (about: ids are dealt by hash).
BLOCK, QUERIES = 16_384, 4_096
#: Dimensions that are added between two rounds of pruning.
STEP = 8
#: Survivors are compacted once they are less than this share of the block.
COMPACT = 0.5
_CHUNK = 256


def _blocks(vectors: DataFrame, column: str, count: int) -> DataFrame:
    """Packed blocks of (row, id, v): column, dim, rows, ids and vectors as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table[column][0].as_py()
        ids = table["id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), dim)
        order = np.lexsort([table["row"].to_numpy(), ids])
        ids, v, rows = ids[order], v[order], table["row"].to_numpy()[order]
        return pa.table({column: pa.array([block], pa.int32()), "dim": pa.array([dim], pa.int32()),
                         "rows": pa.array([rows.tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()),
                         "vectors": pa.array([np.ascontiguousarray(v.T).tobytes()], pa.binary())})

    dealt = vectors.withColumn(column, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return dealt.groupBy("dim", column).applyInArrow(pack, f"{column} int, dim int, rows binary, ids binary, vectors binary")


def _exact_type(a: np.ndarray, b: np.ndarray):
    """The fastest type in which every product sum is exact and a bound is off by less than a quarter."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[0])
    return np.float32 if most < 2 ** 20 else np.float64 if most < 2 ** 50 else object


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort([ids[near], -scores[near]])[:k]]


def search_block(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query index, candidate indices, scores) for vertical q and c; a query's own row is no candidate."""
    kind = _exact_type(q, c)
    dims = c.shape[0]
    if kind is object:  # numbers too large for a float: exact, and without bounds
        for i in range(len(q_rows)):
            scores = sum((c[d].astype(object) * int(q[d, i]) for d in range(dims)), np.zeros(len(c_ids), dtype=object))
            others = np.flatnonzero(c_rows != q_rows[i])
            order = sorted(others.tolist(), key=lambda j: (-scores[j], c_ids[j]))[:k]
            yield i, np.array(order, dtype=np.int64), [int(scores[j]) for j in order]
        return
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1) * (q.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    c, q = np.ascontiguousarray(c[order].astype(kind)), np.ascontiguousarray(q[order].astype(kind))
    cuts = [*range(0, dims, STEP), dims]
    rest = lambda x: [np.sqrt((x[d:].astype(np.float64) ** 2).sum(axis=0)).astype(np.float32) * np.float32(1 + 1e-5)
                      for d in cuts]
    c_rest, q_rest = rest(c), rest(q)
    # A first bound from a few whole candidates; the query itself may be one of them.
    seed = q.T @ c[:, :1024]
    enough = seed.shape[1] > k
    floor = np.partition(seed, seed.shape[1] - k - 1, axis=1)[:, seed.shape[1] - k - 1] if enough else None
    for low in range(0, len(q_rows), _CHUNK):
        first = q[:cuts[1], low:low + _CHUNK].T @ c[:cuts[1]] if dims else np.zeros((min(_CHUNK, len(q_rows) - low), len(c_ids)), kind)
        for j in range(first.shape[0]):
            i = low + j
            score, alive, block = first[j], None, c
            least = floor[i] if enough else -np.inf
            ids, rows = c_ids, c_rows
            for g in range(1, len(cuts) - 1):
                bound = c_rest[g] if alive is None else c_rest[g][alive]
                bound = bound * q_rest[g][i]
                if len(score) > 4 * k:
                    lower = score - bound
                    least = max(least, np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1])
                keep = score + bound >= least - 0.5  # scores are whole numbers
                n = np.count_nonzero(keep)
                if n < COMPACT * len(score):
                    chosen = np.flatnonzero(keep)
                    alive = chosen if alive is None else alive[chosen]
                    score, ids, rows, block = score[chosen], ids[chosen], rows[chosen], np.ascontiguousarray(block[:, chosen])
                score = score + q[cuts[g]:cuts[g + 1], i] @ block[cuts[g]:cuts[g + 1]]
            others = np.flatnonzero(rows != q_rows[i])
            best = others[_best(score[others].astype(np.float64), ids[others], k)]
            yield i, best if alive is None else alive[best], score[best].astype(np.int64).tolist()


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """The k best of all rows for every row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding; a component x counts as floor(scale * x).
    Returns query_id, rank from 1, vec_id and score (integer inner product), ties
    to the smaller vec_id, never the query's own id.  Rows whose id or vector is
    null, or that hold a null or non-finite component, take no part; vectors of
    different lengths don't meet; rows that share an id are rows of their own, as
    queries and as candidates; other columns are ignored.
    """
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"),
        F.size(x).alias("dim"))
    whole = written(whole, "vectors")  # row numbers must not change
    asked = whole.where(F.col("id") % every == 0)
    n, m = whole.count(), asked.count()
    width = parts(vectors.sparkSession)
    c_blocks = max(1, min(width, n // 1024), -(-n // BLOCK))
    q_blocks = max(1, -(-m // QUERIES))
    c = written(_blocks(whole, "c", c_blocks), "vector-blocks")
    q = written(_blocks(asked, "q", q_blocks), "query-blocks")
    # Every query block meets every candidate block once; both are of bounded size.
    cells = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("asks", F.lit(False)).unionByName(
        q.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).withColumn("asks", F.lit(True)))

    def meet(table: pa.Table) -> pa.Table:
        sides = {}
        for row in table.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            sides[row["asks"]] = np.frombuffer(row["rows"], np.int64), ids, np.frombuffer(row["vectors"], np.int64).reshape(row["dim"], len(ids))
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(sides) == 2:
            (q_rows, q_ids, qv), (c_rows, c_ids, cv) = sides[True], sides[False]
            for i, best, scores in search_block(q_rows, qv, c_rows, c_ids, cv, k):
                out["query_row"] += [int(q_rows[i])] * len(scores)
                out["query_id"] += [int(q_ids[i])] * len(scores)
                out["vec_id"] += c_ids[best].tolist()
                out["score"] += scores
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = cells.groupBy("dim", "c", "q").applyInArrow(
        meet, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.n <> q.n AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
