"""Streaming jobs run to the end of what is there, twice."""

from pyspark.sql import functions as F

from tests.test_keyed_export import store  # noqa: F401
from tracewright.streaming import jobs

SCHEMA = "session_id string, ts timestamp, value double"


def test_export_new(spark, store, tmp_path):  # noqa: F811
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:05", 2.0), ("b", "2024-01-01 00:00:00", 3.0)]
    make = lambda r: spark.createDataFrame(r, "session_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))

    def run():
        jobs.export_new(spark.readStream.schema(SCHEMA).parquet(source), out, state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session_id, r.value) for r in spark.read.parquet(out).collect())

    make(rows).write.parquet(source)
    assert run() == [("a", 2.0), ("b", 3.0)]
    make([("a", "2024-01-01 00:00:05", 4.0), ("b", "2024-01-01 00:00:09", 5.0), ("c", "2024-01-01 00:00:00", 6.0)]).write.mode("append").parquet(source)
    assert run() == [("a", 2.0), ("b", 3.0), ("b", 5.0), ("c", 6.0)]


def test_buckets(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:00:00", None)], "session_id string, ts string, value double")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    out = jobs.buckets(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "ts", "1 hour", "10 minutes", "value", "session_id")
    out.writeStream.format("memory").queryName("bucketed").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r.bucket), r.session_id, r.sum, r.n) for r in spark.table("bucketed").collect())
    assert got == [("2024-01-01 00:00:00", "a", 3.0, 2), ("2024-01-01 01:00:00", "b", None, 0)]
