"""Prefix trie of conversations by fixed-length block hashing.

A turn at position p is hashed together with p; the exclusive or of the first
d hashes (two lanes of 64 bits) names the sequence of d turns, so a prefix sum
over slices of a conversation names all its prefixes and no conversation is
ever gathered.  Conversations are first grouped by the name at the end of each
block of BLOCK turns.  Where a prefix goes on in one block only, the turns of
that block are the trie's nodes as they are; only blocks that diverge from a
sibling are taken apart and grouped again turn by turn.

Each node belongs to its smallest conversation, and the nodes of one owner
form a chain.  Sums over subtrees are suffix sums along chains, plus what the
chains hanging from them send up, level by level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.llm.shared import parts, written

#: Turns of a block.
BLOCK = 4
#: Conversations take their first turns from the one whose id is the next smaller multiple of this.
FAMILY = 20
#: Ids of one piece of a node's list: 2 to this power at most.
PIECE_BITS = 14
#: Depths of a chain that are summed in one window.
SLAB = 1024
WORD = r"[^\x20\x09-\x0D]+"

_KEY = ["depth", "x", "y"]


def _slim(conversations: DataFrame) -> DataFrame:
    """conv, slice, turn, digest, words: a line per turn; slices are ranges of (conv, turn, digest)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("w"))
    ranged = turns.repartitionByRange(parts(conversations.sparkSession), "c", F.col("turn").asc_nulls_first(), "digest")
    return written(ranged.withColumn("slice", F.spark_partition_id()), "turns")


def _numbered(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their position i, (c, slice, start, n) for the slices of each conversation)."""
    before = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = written(slim.groupBy("c", "slice").agg(F.count("*").alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0))), "slices")
    inside = Window.partitionBy("c", "slice").orderBy(F.col("turn").asc_nulls_first(), "digest")
    local = slim.withColumn("i", F.row_number().over(inside) - 1)
    return written(local.join(slices.select("c", "slice", "start"), ["c", "slice"]).select(
        "c", "slice", (F.col("start") + F.col("i")).alias("i"), "digest", "w"), "numbered"), slices


def _lanes(position) -> list:
    return [F.xxhash64(F.lit(lane), position.cast("bigint"), "digest") for lane in (1, 2)]


def rebuilt(conversations: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation got the first turns of its family's.

    turns: c, p (position), x, y (name of the prefix ending here), qx, qy (of
    the prefix before), w (words), last.  conversations: c, n (turns).
    """
    numbered, slices = _numbered(_slim(conversations))
    base = F.col("c") - F.col("c") % family
    lengths = slices.groupBy("c").agg(F.sum("n").alias("own")).withColumn("base", base).withColumn(
        "h", (F.crc32(F.col("c").cast("string").cast("binary")) % 4).cast("int"))
    first = numbered.where((F.col("c") % family == 0) & (F.col("i") < 3)).groupBy(F.col("c").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("i").cast("bigint").alias("p"), "digest", "w"))).alias("head"))  # three at most
    none = F.array().cast("array<struct<p:bigint,digest:binary,w:bigint>>")
    convs = lengths.join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), 1, F.col("h"))).withColumn(
        "n_head", F.size("head")).withColumn("n", F.col("n_head") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = written(convs.select("c", "h", "head", "n_head", "n"), "conversations")

    heads = convs.select("c", "n", F.explode("head").alias("t")).select("c", "n", "t.*")
    a, b = _lanes(F.col("p"))
    upto = Window.partitionBy("c").orderBy("p")  # three rows at most
    heads = heads.withColumns({"a": a, "b": b}).withColumns({
        "x": F.expr("bit_xor(a)").over(upto), "y": F.expr("bit_xor(b)").over(upto)})
    heads = written(heads.select("c", "n", "p", "a", "b", "x", "y", "w"), "heads")
    led = heads.groupBy("c").agg(F.expr("bit_xor(a)").alias("hx"), F.expr("bit_xor(b)").alias("hy"))

    # What each slice needs to know of its conversation, so that a long one is joined slice by slice.
    knows = slices.select("c", "slice").join(convs.select("c", "h", "n_head", "n").join(led, "c", "left"), "c")
    a, b = _lanes(F.col("p"))
    own = numbered.join(knows, ["c", "slice"]).where("i >= h").withColumn("p", F.col("n_head") + F.col("i") - F.col("h")).withColumns(
        {"a": a, "b": b})
    along = Window.partitionBy("c", "slice").orderBy("p")
    own = own.withColumns({"x": F.expr("bit_xor(a)").over(along), "y": F.expr("bit_xor(b)").over(along)})
    own = written(own.select("c", "slice", "n", "p", "a", "b", "w", *[
        F.col(v).bitwiseXOR(F.coalesce(h, F.lit(0))).alias(v) for v, h in (("x", "hx"), ("y", "hy"))]), "own")
    # Only a conversation at the end of a range goes on in the next: no more rows here than twice the slices.
    cut = slices.withColumn("k", F.count("*").over(Window.partitionBy("c"))).where("k > 1").select("c", "slice")
    earlier = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = own.join(F.broadcast(cut), ["c", "slice"]).groupBy("c", "slice").agg(
        F.expr("bit_xor(a)").alias("sa"), F.expr("bit_xor(b)").alias("sb")).select(
        "c", "slice", F.expr("bit_xor(sa)").over(earlier).alias("sx"), F.expr("bit_xor(sb)").over(earlier).alias("sy"))
    own = own.join(F.broadcast(shift), ["c", "slice"], "left").withColumns({
        "x": F.col("x").bitwiseXOR(F.coalesce("sx", F.lit(0))), "y": F.col("y").bitwiseXOR(F.coalesce("sy", F.lit(0)))})
    cols = ["c", "n", F.col("p").cast("bigint").alias("p"), "a", "b", "x", "y", "w"]
    turns = own.select(cols).unionByName(heads.select(cols)).select(
        "c", "p", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("qx"), F.col("y").bitwiseXOR(F.col("b")).alias("qy"), "w",
        (F.col("p") == F.col("n") - 1).alias("last"))
    return written(turns, "prefixes"), convs.select("c", "n")


def grouped(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie's nodes: depth, x, y, qx, qy (the parent's x, y), k (members), m (smallest member), w."""
    blocks = turns.groupBy("c", F.floor(F.col("p") / block).alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("p", "x", "y", "qx", "qy", "w"))).alias("turns"))  # ``block`` at most
    end, start = F.get("turns", F.size("turns") - 1), F.get("turns", F.lit(0))
    same = blocks.select("c", "b", "turns", F.size("turns").alias("n"), end["x"].alias("ex"), end["y"].alias("ey")).groupBy(
        "b", "n", "ex", "ey").agg(F.count("*").alias("k"), F.min("c").alias("m"), F.first("turns").alias("turns"))
    same = written(same.withColumns({"sx": start["qx"], "sy": start["qy"]}), "blocks")
    # First blocks all hang from the root and are taken apart anyway; they need no look at their siblings.
    later = same.where("b > 0")
    siblings = later.groupBy("b", "sx", "sy").count().where("count > 1").select("b", "sx", "sy", F.lit(True).alias("split"))
    marked = later.join(siblings, ["b", "sx", "sy"], "left").select("k", "m", "turns", F.col("split").isNotNull().alias("split"))
    opened = marked.unionByName(same.where("b = 0").select("k", "m", "turns", F.lit(True).alias("split"))).select(
        "k", "m", "split", F.explode("turns").alias("t")).select(
        (F.col("t.p") + 1).alias("depth"), "t.x", "t.y", "t.qx", "t.qy", "k", "m", "t.w", "split")
    refined = opened.where("split").groupBy(_KEY).agg(
        F.min("qx").alias("qx"), F.min("qy").alias("qy"), F.sum("k").alias("k"), F.min("m").alias("m"), F.min("w").alias("w"))
    root = convs.agg(F.min("c").alias("m"), F.count("*").alias("k")).where("k > 0").select(
        F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(v) for v in ("x", "y", "qx", "qy")],
        "k", "m", F.lit(0).cast("bigint").alias("w"))
    return written(refined.unionByName(opened.where(~F.col("split")).drop("split")).unionByName(root), "nodes")


def _related(nodes: DataFrame) -> DataFrame:
    """Nodes with up (the parent's owner; null at the root) and kids (number of children)."""
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("qx").alias("x"), F.col("qy").alias("y")).agg(
        F.count("*").alias("kids"))
    known = nodes.join(above, _KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    top = nodes.where("depth = 0").select("m").head()
    owner = nodes.where("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("m").alias("up"))
    deep = known.where("depth > 1").join(owner, ["depth", "qx", "qy"])
    # Every first turn hangs from the root: its owner is one number.
    shallow = known.where("depth <= 1").withColumn("up", F.when(F.col("depth") == 1, F.lit(top["m"] if top else None).cast("bigint")))
    return written(deep.unionByName(shallow), "related")


def _sums(nodes: DataFrame) -> DataFrame:
    """m, depth, leaves, saved: sums over each node's subtree."""
    own = nodes.select("m", "depth", F.when(F.col("kids") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
                       ((F.col("k") - 1) * F.col("w")).alias("saved"))
    hangs = nodes.where("up <> m").select("m", "up", (F.col("depth") - 1).alias("at"))  # one row a chain
    add = [F.sum(v).alias(v) for v in ("leaves", "saved")]
    moving = written(own.groupBy("m").agg(*add).join(hangs, "m"), "chains")
    values = own
    while not moving.isEmpty():
        values = values.unionByName(moving.groupBy(F.col("up").alias("m"), F.col("at").alias("depth")).agg(*add))
        moving = written(moving.groupBy(F.col("up").alias("m")).agg(*add).join(hangs, "m"), "chains")
    slab = F.floor(F.col("depth") / SLAB)
    points = written(values.groupBy("m", "depth").agg(*add).withColumn("slab", slab), "points")
    deeper = Window.partitionBy("m").orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    rest = points.groupBy("m", "slab").agg(*add).select(
        "m", "slab", *[F.sum(v).over(deeper).alias(f"_{v}") for v in ("leaves", "saved")]).where("_leaves IS NOT NULL")
    inside = Window.partitionBy("m", "slab").orderBy(F.desc("depth"))
    within = points.withColumns({v: F.sum(v).over(inside) for v in ("leaves", "saved")})
    return within.join(rest, ["m", "slab"], "left").select(
        "m", "depth", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in ("leaves", "saved")])


def _ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, x, y, ends: digest of the ids of the conversations that end in a node.

    Lists are made in pieces of bounded size by ranges of ids; a node of several pieces
    passes through one hash, piece by piece.
    """
    zero = F.lit(0).cast("bigint")
    ends = turns.where("last").select("c", (F.col("p") + 1).alias("depth"), "x", "y").unionByName(
        convs.where("n = 0").select("c", zero.alias("depth"), zero.alias("x"), zero.alias("y")))
    pieces = written(ends.groupBy(*_KEY, F.shiftright("c", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")), "pieces")
    count = pieces.groupBy(_KEY).agg(F.count("*").alias("pieces"), F.min("piece").alias("first"))
    one = pieces.join(count.where("pieces = 1").select(_KEY), _KEY).select(*_KEY, F.sha2("ids", 256).alias("ends"))
    several = pieces.join(count.where("pieces > 1").select(_KEY), _KEY).repartition(*_KEY).sortWithinPartitions(*_KEY, "piece")

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *here, _, ids in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if here != key:
                    if key is not None:
                        done.append([*key, state.hexdigest()])
                    key, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done, strict=True)], [*_KEY, "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [*key, state.hexdigest()]], [*_KEY, "ends"])

    long = several.select(*_KEY, "piece", "ids").mapInArrow(digest, "depth bigint, x bigint, y bigint, ends string")
    return one.unionByName(long)


def trie(conversations: DataFrame, family: int = FAMILY, block: int = BLOCK) -> DataFrame:
    """The prefix trie of rebuilt ``conversations`` (conv_id, turn, role, text), one row a node.

    Turns are in order of turn, null first, ties by the SHA-256 of role and text;
    null role or text counts as empty, repeated rows are turns of their own, rows
    without a conv_id take no part, other columns are ignored.  Every conversation
    c starts with the first crc32(c) % 4 turns of c - c % family (all if it has
    fewer) and goes on with its own after as many.  Returns conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256; an empty table has no nodes.
    """
    turns, convs = rebuilt(conversations, family)
    nodes = _related(grouped(turns, convs, block))
    out = nodes.join(_sums(nodes), ["m", "depth"]).join(_ends(turns, convs), _KEY, "left")
    return out.select(
        F.col("m").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("k").alias("n_convs"),
        F.col("kids").cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS l,
         list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ord(b), 0, 0, 0, 0, 0, 0, 0]))),
                     lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)) AS s
  FROM t GROUP BY c),
full_ AS (
  SELECT a.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.l[1:a.h] END, a.l[a.h + 1:]) AS r
  FROM (SELECT *, xor(s, 4294967295) % 4 AS h FROM conv) a LEFT JOIN conv b ON b.c = a.c - a.c % 20),
pre AS (SELECT c, len(r) AS n, unnest(range(0, len(r) + 1)) AS d, r FROM full_),
node AS (
  SELECT d, r[1:d] AS p, min(c) AS m, count(*) AS k, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS e
  FROM pre GROUP BY d, r[1:d]),
kin AS (
  SELECT a.d, a.p, a.m, a.k, a.e, b.m AS up,
         CASE WHEN a.d = 0 THEN 0 ELSE (a.k - 1) * len(regexp_extract_all(a.p[a.d].t, '[^\x20\x09-\x0D]+')) END AS saved,
         (SELECT count(*) FROM node x WHERE x.d = a.d + 1 AND x.p[1:a.d] = a.p) AS kids
  FROM node a LEFT JOIN node b ON b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]),
steps AS (SELECT unnest(range(0, d + 1)) AS up_d, p, saved, kids FROM kin),
under AS (SELECT up_d AS d, p[1:up_d] AS p, sum(saved) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM steps GROUP BY up_d, p[1:up_d])
SELECT k.m AS conv_id, k.d::BIGINT AS depth, k.up AS parent_conv_id, k.k AS n_convs, k.kids AS n_children, u.leaves AS n_leaves,
       u.saved::BIGINT AS saved_tokens, sha256(k.e) AS ends_sha256
FROM kin k JOIN under u ON u.d = k.d AND u.p = k.p
"""
