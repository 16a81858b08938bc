"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

import gc
import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: rows of an Arrow batch: texts are long, and a Python worker holds a batch at a time
BATCH_ROWS = 1000


def checkpoint_dir(spark) -> None:
    """Make sure that a checkpoint folder is set and that Arrow batches are small enough for long texts.

    The folder is the one the cluster names; only in local mode, where driver and executors share it, one under /tmp
    stands in. The batch size is lowered for the session, never raised.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")


def release(spark) -> None:
    """Between phases of a long job: let Spark drop the shuffle files of finished ones.

    They stay until the driver's JVM collects the plans that refer to them, which otherwise may be long after. The files
    are deleted by a thread of their own, so the next phase waits a moment for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the smallest node number it is linked to.

    Each step replaces the edges by ones towards smaller nodes and is a minimum per node (summed up before the
    shuffle) and one join back, so a node with very many edges is no bottleneck. Loops and repeated edges do no harm;
    edges with a null end are dropped. Every round is cut by a checkpoint. Ends when no edge changes;
    raises if that takes more than `rounds`.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    kind = T.LongType()
    e = edges.select(F.greatest("a", "b").cast(kind).alias("u"), F.least("a", "b").cast(kind).alias("v"), (F.col("a") != F.col("b")).alias("d"))
    e = e.filter("d").select("u", "v").distinct().checkpoint()
    total = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and itself are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == tuple(state):
            e = new
            break
        total, e = tuple(state), new
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
