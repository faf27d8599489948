"""An inbox of photos as a stream: files are taken as they arrive, results appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def preflight_inbox(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """A stream of (path, length, sha256) of the files that come into a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Hand all that has arrived to ``sink`` in micro-batches and stop; the checkpoint keeps what is done."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress_counts(results: DataFrame, watermark: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Succeeded and failed results of a stream (at, status) by time window, late rows up to the watermark."""
    w = results.withWatermark("at", watermark).groupBy(F.window("at", size))
    return w.agg(F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
