"""The query log as a stream: lines appended to it are counted in event-time windows. An extension; the batch log stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorequarry import schemas


def read_log(spark: SparkSession, root: str, files_a_batch: int = 1000) -> DataFrame:
    """New lines of the log, with ts as a timestamp (null where it cannot be read)."""
    rows = spark.readStream.schema(schemas.QUERY_LOG).option("maxFilesPerTrigger", files_a_batch).json(f"{root}/query-log.jsonl")
    return rows.withColumn("ts", F.try_to_timestamp("ts"))


def windowed(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, profile, queries, empty (without a result). Works on a stream and on a batch; lines later than late are left out of a stream."""
    rows = log.where("ts is not null")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", window).alias("w"), "profile").agg(F.count("*").alias("queries"), F.sum(F.when(F.size("result_page_ids") > 0, 0).otherwise(1)).alias("empty"))
    return found.select(F.col("w.start").alias("window_start"), "profile", "queries", "empty")


def follow(log: DataFrame, out: str, checkpoint: str, window: str = "1 hour", late: str = "2 hours", once: bool = True) -> StreamingQuery:
    """Append closed windows to Parquet below out; checkpoint holds offsets and state, so a restart neither loses nor repeats a window."""
    writer = windowed(log, window, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
