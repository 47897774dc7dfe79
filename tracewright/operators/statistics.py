"""Descriptive statistics with the sample conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.evaluation import percentiles, values_at


def describe(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, extremes, range, sum, sample variance and deviation, standard error; skewness and excess kurtosis over
    the sample deviation, 0 below 3 and 4 values."""
    x, n = F.col(value), F.col("n")
    out = rows.where(x.isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stddev"), F.skewness(x).alias("__s"), F.kurtosis(x).alias("__k"))
    out = out.join(percentiles(rows, value, group, {"median": 0.5}), F.col(group).eqNullSafe(F.col("__key")))
    shrink = (n - 1) / n
    return out.select(group, "n", "mean", "median", "min", "max", (F.col("max") - F.col("min")).alias("range"), "sum", "variance", "stddev", (F.col("stddev") / F.sqrt(n.cast("double"))).alias("std_error"), F.when(n < 3, 0.0).otherwise(F.col("__s") * F.pow(shrink, F.lit(1.5))).alias("skewness"), F.when(n < 4, 0.0).otherwise((F.col("__k") + 3) * shrink * shrink - 3).alias("kurtosis"))


def index_quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """q1 and q3 as the values at n // 4 and 3n // 4 of the sorted list, and the number beyond 1.5 ranges of them.

    The places are looked for in ranges of the values, so that no task orders a group; what lies beyond is counted in a scan."""
    at = values_at(rows, value, group, lambda n: [F.floor(n / 4), F.floor(3 * n / 4)])
    places = at.select("__key", F.col("__n").alias("n"), F.get("__at", F.lit(0)).alias("q1"), F.get("__at", F.lit(1)).alias("q3"))
    joined = rows.where(F.col(value).isNotNull()).select(group, value).join(places, F.col(group).eqNullSafe(F.col("__key")))
    width = 1.5 * (F.col("q3") - F.col("q1"))
    return joined.groupBy(group, "n", "q1", "q3").agg(F.count_if((F.col(value) < F.col("q1") - width) | (F.col(value) > F.col("q3") + width)).alias("n_outliers"))


def trend(rows: DataFrame, group: str, x: str, y: str, ahead: int) -> DataFrame:
    """Least-squares line by group and its value so far ahead, with a band of 15 percent."""
    out = rows.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(x).alias("__last"))
    out = out.withColumn("forecast", F.col("intercept") + F.col("slope") * (F.col("__last") + ahead)).drop("__last")
    return out.withColumns({"low": F.col("forecast") * 0.85, "high": F.col("forecast") * 1.15})


def complete(rows: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Per named check (an SQL condition that valid rows meet): rows that break it and the share that meets it."""
    counted = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in checks.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_invalid")) for k in checks])).alias("c")
    share = 1 - F.col("n_invalid") / F.greatest("n", F.lit(1))
    return counted.select("n", each).select(F.col("c.check").alias("check"), F.col("c.n_invalid").alias("n_invalid"), "n").withColumn("compliance", share).withColumn("compliant", F.col("compliance") > 0.9)
