"""Row numbers in a global order without sorting in one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; one under /tmp only in local mode, where driver and executors share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")


def number_rows(df: DataFrame, order: list[str | Column], name: str = "seq", start: int = 0) -> DataFrame:
    """Add `name`: consecutive numbers from `start` in the given order, which should be total.

    Rows are range-partitioned and sorted within partitions; the row counts of the partitions (one row each) give
    every partition its offset. The sorted rows are checkpointed, so that both uses see the same partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", (F.coalesce(before, F.lit(0)) + start).alias("_offset"))
    rows = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_offset")
