"""Incremental ingest: pictures that arrive in a folder go through the batch transforms, each once.

An extension: the chains themselves are batch. A trigger of availableNow takes what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema: str = "path string, modificationTime timestamp, length long, content binary"):
    """Run ``transform`` on new files (chart_id, content) and append its rows to ``out``; ends when no file is left."""
    new = spark.readStream.format("binaryFile").schema(schema).load(folder)
    charts = new.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("chart_id"), "content")

    def append(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("append").parquet(out)

    q = charts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Detections by kind and time window, for streams (with a watermark) and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
