"""Packed runs: a manifest line and a line for each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars


def inflate(spark: SparkSession, path: str) -> DataFrame:
    """task_id, conversation, result (JSON) of the task lines; bad lines and unsafe ids are left out."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where(F.try_variant_get("v", "$.type", "string") == "task")
    part = lambda p: F.to_json(F.try_variant_get("v", p, "variant"))
    return rows.select(F.try_variant_get("v", "$.task_id", "string").alias("task_id"), part("$.conversation").alias("conversation"), part("$.result").alias("result")).where(scalars.is_safe_id(F.col("task_id")))


def pack(tasks: DataFrame, name: str) -> DataFrame:
    """value: the manifest (ord 0) and the task lines (ord 1) of tasks (task_id, conversation, result as JSON)."""
    line = F.to_json(F.struct(F.lit("task").alias("type"), "task_id", F.try_parse_json("conversation").alias("conversation"), F.try_parse_json("result").alias("result")))
    manifest = tasks.agg(F.count("*").alias("task_count")).select(F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("manifest").alias("type"), F.lit(name).alias("benchmark_name"), "task_count")).alias("value"))
    return manifest.unionByName(tasks.select(F.lit(1).alias("ord"), line.alias("value")))
