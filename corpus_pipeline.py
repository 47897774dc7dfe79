"""A corpus from raw documents: toxic documents go, one of each near-duplicate group stays, benchmark passages go, personal
data is sanitised, and sources are mixed to their weights."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, mixing, pii, simhash, toxicity
from tracewright.llm.common import read, shared_folder


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


STAGES = [("toxicity", toxic_out), ("simhash_near_dedup", near_duplicates_out), ("decontamination", benchmark_out), ("pii", personal_data_out), ("mixing", mixed)]

#: The first stages are a trained classifier and XXH64 fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is a table in the shared checkpoint folder that the next one reads."""
    folder, docs = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
