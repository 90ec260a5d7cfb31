"""Keyed state over a stream of event files, and the same fold in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import shared_folder


def _fold(events: DataFrame) -> DataFrame:
    """Per user: events, failures, and the type of the event with the largest id. All three combine before the shuffle."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max_by("event_type", "event_id").alias("last_type"))


def batch_states(events: DataFrame) -> DataFrame:
    return _fold(events)


#: Bytes of files that a micro-batch takes; a larger file is one of its own.
BATCH_BYTES = 256 << 20


def files_stream(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of a Parquet table, a file or a folder, as a stream. A micro-batch opens and commits the state of every partition, so it takes as many files as batch_bytes allows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes)
    if files.getFileStatus(where).isFile():  # a stream watches a folder
        return reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))
    return reader.parquet(path)


def stream_states(spark: SparkSession, path: str) -> DataFrame:
    """The fold over all files at path as a stream: micro-batches of files until none is left, state in the shared folder.

    Every batch writes the keys that changed, with the batch's number; the result is each key's last version.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = files_stream(spark, path)

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("version", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    query = _fold(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    changed = spark.read.parquet(f"{base}/out")
    return changed.groupBy("user_id").agg(F.max_by(F.struct("events", "failures", "last_type"), "version").alias("s")).select("user_id", "s.*")
