"""Streaming forms of the incremental export and of the time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracewright.streaming import keyed


def export_new(stream: DataFrame, out: str, state: str, exported: DataFrame | None = None) -> DataStreamWriter:
    """Writes the rows (session_id, ts, ...) whose session is unseen or has moved on by a second. What has been exported is keyed
    state (see keyed.unseen, also for the settings): no batch reads what was written, and a restart does not repeat one."""
    return keyed.unseen(stream, exported=exported).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)


def buckets(stream: DataFrame, ts: str, width: str, late: str, value: str, *tags: str) -> DataFrame:
    """Sums and counts by bucket and tags; a bucket is final once the watermark has passed it."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *tags).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *tags, "sum", "n")
