"""Structured Streaming: stations that arrive as files, and request rates over event time.

Both are extensions of the batch operators: the same expressions, with watermarks that bound the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.profile import finite, sampling, to_ms2
from lodestone.sources.tables import shared_dir

STATIONS = "station_id string, ts timestamp, x_m double, y_m double, z_m double, g double, unit string"


def read_stations(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """CSV files with a header as they arrive."""
    return spark.readStream.schema(STATIONS).option("header", "true").option("maxFilesPerTrigger", files_per_batch).csv(folder)


def valid_stations(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows with finite coordinates, a known unit and a time, g in m/s2; a place that repeats within `delay` counts once."""
    good = rows.where(finite(F.col("x_m")) & finite(F.col("z_m")) & finite(F.col("g")) & F.col("ts").isNotNull())
    good = good.withColumn("g_ms2", to_ms2(F.col("g"), F.trim("unit"))).where(F.col("g_ms2").isNotNull())
    return good.withColumn("y_m", F.coalesce("y_m", F.lit(0.0))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["x_m", "y_m", "z_m"])


def profile_of(stations: DataFrame) -> DataFrame:
    """One row: count, extent, mean and deviation, from partial sums."""
    span = lambda c: F.max(c) - F.min(c)
    size = sampling(F.count("*"), span("x_m"), span("z_m"))
    return stations.agg(F.count("*").alias("n"), span("x_m").alias("x_span"), span("z_m").alias("z_span"), size["area_km2"].alias("area_km2"), F.avg("g_ms2").alias("g_mean"), F.stddev_pop("g_ms2").alias("g_std"))


def keep_profiled(stations: DataFrame, table: str, checkpoint: str):
    """A query that appends each batch to the Parquet folder `table`, under the batch's number, so a batch that is redone replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_windows(events: DataFrame, width: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """window_start, event_type, requests in event time; rows later than `delay` are left out by the watermark."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count("*").alias("requests"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "requests", "total")


def run_to_table(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and reads back the last result. In complete mode nothing waits for a watermark."""
    spark = result.sparkSession
    path = f"{shared_dir(spark)}/lodestone-streams/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    query = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/result")
