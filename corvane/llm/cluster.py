"""Helpers that hold for every operator: lineage cuts, input columns, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many are sent to every executor (at most about 64 MB of whole numbers); more go by shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of one key that meet in one task of ``hot_join``.
KEY_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, shared by all executors. A folder of this machine stands in for it in local mode only."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from there: lost executors lose nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    """SQL name of a column's type: ids may be of any type that has an order."""
    return df.schema[name].dataType.simpleString()


def few(ids: DataFrame) -> DataFrame:
    """ids marked for broadcast if they are at most ``BROADCAST_IDS``."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", key_rows: int = KEY_ROWS) -> DataFrame:
    """left joined with right, which has one row per key and, in ``n``, the number of left's rows of that key.

    A key of more than ``key_rows`` rows is split by a hash of left's column
    ``spread``. Such keys number at most left's rows / key_rows, which bounds
    what is broadcast.
    """
    parts = F.ceil(F.col("n") / F.lit(key_rows)).cast("int")
    hot = right.where(F.col("n") > key_rows).select(*keys, parts.alias("__parts"))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "__part"], how).drop("__part", "n")


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in gone (doc_id); all columns stay, whatever their names, and rows with a null id too."""
    key = "__corvane_gone"
    while key in docs.columns:
        key += "_"
    return docs.join(few(gone.select(F.col("doc_id").alias(key)).distinct()), F.col(f"`{id_col}`") == F.col(key), "left_anti")


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds; rows with a null first column go."""
    return docs.select(*[F.col(f"`{n}`") for n in names]).where(F.col(f"`{names[0]}`").isNotNull())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node of the edges; root is the least id of its component.

    Alternates large-star and small-star steps over distinct edges until a step
    changes nothing; each step is two grouped joins, so no task holds more than
    one node's edges in a spillable window.
    """
    from pyspark.sql import Window as W

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least("u", F.min("v").over(W.partitionBy("u")))
        big = both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(W.partitionBy("u"))
        near = big.withColumn("m", low)
        small = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    # At the fixed point every node has one edge, to the root.
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
