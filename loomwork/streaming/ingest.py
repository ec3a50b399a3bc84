"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.snapshots import latest_per_key
from loomwork.session import shared_dir


def drain(spark: SparkSession, path: str, keys: list[str], order: list[str], checkpoint: str | None = None, files_per_batch: int = 16) -> DataFrame:
    """The latest row a key of all parquet files under `path`, read as a stream until drained.

    Each micro-batch keeps its latest row a key and is written to a folder of its own, named by batch, so a
    retried batch overwrites itself; the batches are merged on reading. Called again with the same `checkpoint`, only
    new files are read. Null keys form a group.
    """
    base = checkpoint or f"{shared_dir(spark)}/loomwork-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def keep(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{base}/batches/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return latest_per_key(spark.read.schema(schema).parquet(f"{base}/batches/*"), keys, order)


def windowed_counts(spark: SparkSession, path: str, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, key, n): events by tumbling window and key of a drained stream, with a watermark.

    Events later than `late` behind the newest of earlier batches are dropped, as in any watermarked stream; within
    one drained batch none is. Null times are dropped.
    """
    base = f"{shared_dir(spark)}/loomwork-stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    counts = timed.groupBy(F.window("__t", width), F.col(key)).agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("window_start"), key, "n").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("window_start", key).agg(F.max_by("n", "batch").alias("n"))
