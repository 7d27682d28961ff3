"""Kernels that are kept: batches of sensors, written once, found again by the fingerprint of grid, sensors and parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _digest(df: DataFrame, columns: list[str]) -> list:
    """Aggregates that tell two sets of rows apart, in any order."""
    return [F.count("*").alias("_n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("_sum")]


def batch_prints(sensors: DataFrame, cells: DataFrame, parameters: str, batches: int) -> DataFrame:
    """batch, print, sensors, cells, grid, parameters: one row for each batch of sensors (obs_id modulo `batches`)."""
    grid = cells.agg(*_digest(cells, ["voxel_id", "x", "y", "z"])).select(F.col("_n").alias("cells"), F.sha2(F.concat_ws(",", "_n", "_sum"), 256).alias("grid"))
    own = sensors.groupBy(F.pmod("obs_id", F.lit(batches)).cast("int").alias("batch")).agg(*_digest(sensors, ["obs_id", "x_m", "y_m", "z_m"]))
    both = own.join(F.broadcast(grid)).withColumn("parameters", F.lit(parameters))  # the grid is one row
    return both.select("batch", F.sha2(F.concat_ws(",", "_n", "_sum", "grid", "parameters", F.lit(batches)), 256).alias("print"), F.col("_n").alias("sensors"), "cells", "grid", "parameters")


def kept_kernel(sensors: DataFrame, cells: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], path: str, parameters: str, batches: int = 64) -> tuple[DataFrame, list[int]]:
    """The kernel make(sensors, cells) from the store at path, and the batches that had to be made.

    A batch is a folder batch=k/print=p; its fingerprint p is of its sensors, the grid and the parameters, so a changed
    sensor makes its own batch anew and a changed grid all of them. What was made is entered in a manifest, which also
    holds the grid's size and fingerprint, after its folder is complete. Readers take the folders that they need and
    prune the others; with no batch to make, no kernel join is planned.
    """
    spark = sensors.sparkSession
    wanted = [tuple(r) for r in batch_prints(sensors, cells, parameters, batches).collect()]  # a row for each batch
    manifest, folder = f"{path}/manifest", f"{path}/batches"
    schema = "batch int, print string, sensors long, cells long, grid string, parameters string"
    known = {(r.batch, r.print) for r in spark.read.schema(schema).parquet(manifest).select("batch", "print").distinct().collect()} if _exists(spark, manifest) else set()
    missing = sorted(r for r in wanted if r[:2] not in known)
    if missing:
        prints = F.create_map(*[F.lit(x) for r in missing for x in r[:2]])
        batch = F.pmod("obs_id", F.lit(batches)).cast("int")
        made = make(sensors.where(batch.isin([r[0] for r in missing])), cells).select("obs_id", "voxel_id", "val", batch.alias("batch"), F.element_at(prints, batch).alias("print"))
        made.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "print").parquet(folder)
        spark.createDataFrame(missing, schema).coalesce(1).write.mode("append").parquet(manifest)
    if not _exists(spark, folder):
        return make(sensors, cells).select("obs_id", "voxel_id", "val"), [r[0] for r in missing]
    stored = spark.read.schema("obs_id long, voxel_id long, val double, batch int, print string").parquet(folder)
    return stored.where(F.col("batch").isin([r[0] for r in wanted]) & F.col("print").isin([r[1] for r in wanted])).drop("batch", "print"), [r[0] for r in missing]
