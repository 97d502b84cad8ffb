"""Streams: counts by time window, a hot folder of files, and first sightings of a content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone is to be UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def window_counts(events: DataFrame, *, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", column: str = "ts", key: str = "event_type") -> DataFrame:
    """Events by window and key, for batches and streams alike."""
    timed = event_time(events, column)
    if events.isStreaming:
        timed = timed.withWatermark(column, late)
    counted = timed.groupBy(F.window(column, width, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return the table it made, which is written beside the checkpoint.

    A batch that runs again writes its own part again, so nothing is doubled; in
    complete mode the latest batch is the table.
    """
    path = f"{checkpoint}-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def hot_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as they arrive, with their digest."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return arriving.withColumn("sha256", F.sha2("content", 256))


def first_sightings(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once; its state is dropped when the watermark has passed it, as a cache's time to live would."""
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])
