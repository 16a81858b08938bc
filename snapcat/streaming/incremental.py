"""Incremental deduplication over a stream of scanned files.

New snapshots arrive as Parquet files of entries in a folder; each micro-batch is resolved against the index so far and
only objects that are new go on, which is what repeated pack runs do. The index is a Parquet folder that grows by one
sub-folder per batch, named by the batch, so a batch that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog as ops

ROW = T.StructType(
    [T.StructField(n, k) for n, k in (("seq", T.LongType()), ("path", T.StringType()), ("size", T.LongType()), ("mtime_sec", T.LongType()), ("mtime_nsec", T.IntegerType()), ("dev", T.LongType()), ("ino", T.LongType()), ("sha256", T.StringType()))]
)


def _index(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    schema = T.StructType([*ROW.fields, T.StructField("object_id", T.StringType()), T.StructField("batch", T.LongType())])
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).filter(F.col("batch") < batch)


def pack_increment(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Resolve one micro-batch against the index of earlier ones and append its new objects."""
    spark = batch.sparkSession
    index = _index(spark, folder, batch_id)
    first = ops.inodes(batch)
    missed = ops.fast_dedup(first, index).filter("object_id is null")
    missed = ops.hash_dedup(missed, index).filter("object_id is null")
    new = ops.assign_ids(missed, ops.next_id_of(index))
    new.select(*[f.name for f in ROW.fields], "object_id").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stream_increments(spark: SparkSession, snapshots: str, index: str, checkpoint: str) -> StreamingQuery:
    """Pack all snapshots that have arrived, one file per micro-batch, then stop."""
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(snapshots)
    return stream.writeStream.foreachBatch(lambda df, k: pack_increment(df, k, index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
