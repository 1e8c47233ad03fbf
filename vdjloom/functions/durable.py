"""Cut lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 100_000  # rows of a small table that every task may hold


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a test session sets its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, written at once, that survives executor loss."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet, for wide rows; the files stay in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/vdjloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` written once; marked for broadcast if it has at most ``most`` rows.

    Its keys are then looked up where the other table's rows lie, so a key that
    very many rows share is no single task.
    """
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def may_hold(kept: DataFrame, name: str, value: Column) -> Column:
    """Whether ``value`` may be among the whole numbers ``name`` of a written table; False is sure.

    A table of bits, at most 8 MB, that a filter looks into: unlike a join it is asked
    before the other columns of a row are made.  A full table only lets more rows pass.
    """
    words = 1 << min(20, max(10, (kept.count() // 4).bit_length()))  # 16 bits a number and more

    def slot(x: Column) -> Column:
        return F.xxhash64(x).bitwiseAND(F.lit(words * 64 - 1))

    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot(F.col(name)).bitwiseAND(F.lit(63)).cast("int"))
    set_ = kept.groupBy(F.shiftright(slot(F.col(name)), 6).alias("_w")).agg(F.bit_or(one).alias("_b"))
    table = kept.sparkSession.range(words).join(set_, F.col("id") == F.col("_w"), "left").agg(F.sort_array(
        F.collect_list(F.struct("id", F.coalesce("_b", F.lit(0)).alias("b"))))["b"].alias("bits")).scalar()
    word = F.get(table, F.shiftright(slot(value), 6).cast("int"))
    return F.call_function("bit_get", word, slot(value).bitwiseAND(F.lit(63)).cast("int")) == 1
