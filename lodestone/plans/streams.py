"""Queries on streams, run over what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources import adapters as A
from lodestone.streaming import stations as S


@query("stream_request_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS requests, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_request_windows(spark, sf_dir):
    schema = A.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.run_to_table(S.request_windows(events, "1 hour"), "request-windows")
    return out.withColumn("total", F.round("total", 4))
