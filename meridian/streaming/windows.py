"""Windowed totals of a stream of events, and their last state as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path


def daily_totals(events: DataFrame, late: str | None = None) -> DataFrame:
    """day, event_type, n, total of events (ts, event_type, value). With `late`, what comes later than that behind the newest event of earlier batches is left out, so
    that an endless stream's state stays bounded; without it every event counts, as a table that is read to its end needs."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = (timed.withWatermark("ts", late) if late else timed).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def caught_up(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Run the stream over what is there and return the last row of each key. Every batch is written with its number, so a batch that is repeated after a failure replaces itself."""
    spark = totals.sparkSession
    path, state = new_path(spark, "stream"), new_path(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = totals.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(totals.schema.add("batch", "long")).parquet(path)
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "batch")
