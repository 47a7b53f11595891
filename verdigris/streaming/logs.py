"""Streams: a run log as it grows, without repeats; arriving items checked against a reference set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators import similarity
from verdigris.sources.readers import RUN_LOG


def tail(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Runs appended to a folder of JSON lines, the first of each (method, K, seed) within the watermark; a run's time is its file's."""
    rows = spark.readStream.schema(RUN_LOG).json(path).withColumn("seen", F.col("_metadata.file_modification_time"))
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["method", "variant", "K", "seed"])


def running_means(runs: DataFrame) -> DataFrame:
    """n and mean macro-F1 of each method and size so far (complete or update mode)."""
    return runs.groupBy("method", "K").agg(F.count("*").alias("n"), F.avg("macro_f1").alias("macro_f1"))


def event_windows(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of each event type in tumbling windows, final once the watermark has passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def check_arrivals(items: DataFrame, reference: DataFrame, least: float, put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch of items, those with a cosine of least or more to the bounded reference set go to put(rows, batch)."""

    def each(batch: DataFrame, number: int) -> None:
        put(similarity.nearest(batch, reference).filter(F.col("cos") >= least), number)

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
