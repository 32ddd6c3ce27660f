"""Structured Streaming: windowed road-state cells and keyed deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waymark.plans.scratch import new_path


def state_cells(stream: DataFrame, ts: str, key: list[str], value: str, width: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Count, sum and non-null count per key and half-open window; a boundary event belongs to the next one."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, width), *key)
            .agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count(value).alias("valid"))
            .select(F.col("window.start").alias("window_start"), *key, "n", "total", "valid"))


def two_stage_means(stream: DataFrame, ts: str, trip: str, key: list[str], value: str, width: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Mean per window and key of the trips' means in it, with the trips and rows behind it: two aggregations chained in one stream.

    One watermark on event time closes both: a trip's mean leaves with its window, carries the window's time on, and the cell's mean closes after it.
    """
    trips = (stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), trip, *key)
             .agg(F.avg(value).alias("_m"), F.count("*").alias("_n")).withColumn("_at", F.window_time("_w")))
    return (trips.groupBy(F.window("_at", width).alias("window"), *key).agg(F.avg("_m").alias("mean"), F.count("*").alias("trips"), F.sum("_n").alias("n"))
            .select(F.col("window.start").alias("window_start"), *key, "mean", "trips", "n"))


def same_day_counted(stream: DataFrame, start: str, end: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that end on their own calendar day, and per micro-batch what was read, kept, dropped as crossing a day and dropped without a time (R2).

    The counts are metrics observed on the very rows that are written, so they cost no second read. Both go below a folder of the
    batch's number, which a repeated batch overwrites: each row counts once. Runs on what is available.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, name), new_path(spark, f"{name}-state")
    same = F.to_date(start) == F.to_date(end)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        watched = batch.observe(seen, F.count("*").alias("read"), F.count_if(same).alias("kept"), F.count_if(~same).alias("cross_day"), F.count_if(same.isNull()).alias("no_time"))
        watched.where(same).write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        counts = seen.get
        spark.createDataFrame([(counts["read"], counts["kept"], counts["cross_day"], counts["no_time"])], "read long, kept long, cross_day long, no_time long").write.mode(
            "overwrite").parquet(f"{path}/counts/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return (spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/kept").drop("batch"),
            spark.read.schema("read long, kept long, cross_day long, no_time long, batch long").parquet(f"{path}/counts"))


def same_day(stream: DataFrame, start: str, end: str) -> DataFrame:
    """Drop events that end on another calendar day (R2)."""
    return stream.where(F.to_date(start) == F.to_date(end))


def deduplicate(stream: DataFrame, ts: str, key: list[str], late: str = "1 day") -> DataFrame:
    """One row per identity within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def gate_windows(stream: DataFrame, ts: str, gates: dict[str, Column], width: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Rows that pass each gate and those before it, per window."""
    counts, passed = [], F.lit(True)
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), *counts)
            .select(F.col("window.start").alias("window_start"), "n", *gates))


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available in append mode into Parquet files of the shared folder, and return a reader of them.

    Windows leave when the watermark passes their end, so the last ones wait for later events.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, name), new_path(spark, f"{name}-state")
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
