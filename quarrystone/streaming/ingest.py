"""Streams: new text files become paragraphs, events become windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone.operators.records import paragraphs
from quarrystone.sources.files import format_of, texts


def ingest_folder(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Paragraphs (id: the path) of every new txt or md file below folder, once each, then stops.

    A batch that is run again overwrites its own folder of the target, so lost drivers repeat no rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        paragraphs(texts(batch).select(F.col("path").alias("id"), "text")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    wanted = files.where(format_of(F.col("path")).isin("txt", "md"))
    return wanted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """events: ts, event_type, value (a stream or a table) -> start, event_type, n, total; rows later than ``late`` are left out of a stream."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
