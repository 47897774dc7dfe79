"""Evaluation of verdicts against labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators import blocks

#: Ranges of values that a group is cut into to be ranked; the cuts are a list of so many numbers.
RANGES = 64


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def judged(verdicts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Verdicts with their label; a verdict without one is dropped (see run_stats)."""
    return verdicts.join(labels, key)


def confusion(rows: DataFrame, *by: str, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """tp, tn, fp, fn and what follows from them, by the given columns."""
    p, a = F.col(predicted), F.col(actual)
    counts = rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rated = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def run_stats(verdicts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """total, scored and dropped verdicts in one row."""
    known = labels.select(key).distinct().withColumn("known", F.lit(True))
    return verdicts.join(known, key, "left").agg(F.count("*").alias("total"), F.count("known").alias("scored"), F.count_if(F.col("known").isNull()).alias("dropped"))


def dealt(rows: DataFrame, value: str, by: str) -> tuple[DataFrame, DataFrame]:
    """rows with __range, and __by, __of, __rows, __start, __n of each group and range: a group is cut by quantiles of all
    values into RANGES ranges, so that no task has to order a whole group. A null group is a group."""
    cuts = rows.approxQuantile(value, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)
    ranged = rows.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col(value))))
    counts = ranged.groupBy(by, "__range").agg(F.count("*").alias("__rows"))
    earlier = W.partitionBy(by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    start, n = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)), F.sum("__rows").over(W.partitionBy(by))
    return ranged, counts.select(F.col(by).alias("__by"), F.col("__range").alias("__of"), "__rows", start.alias("__start"), n.alias("__n"))


def values_at(rows: DataFrame, value: str, by: str, places: Callable[[Column], list[Column]]) -> DataFrame:
    """__key (the group), __n, __at: the values at places(n), counted from 0, in the order of the group's n values that are not
    null. Only the ranges that hold a place are ordered, by their distinct values."""
    ranged, ranges = dealt(rows.where(F.col(value).isNotNull()).select(by, value), value, by)
    wanted = ranges.select("*", F.posexplode(F.array(*[p.cast("long") for p in places(F.col("__n"))])).alias("__k", "__place"))
    wanted = wanted.where((F.col("__place") >= F.col("__start")) & (F.col("__place") < F.col("__start") + F.col("__rows")))
    held = wanted.groupBy("__by", "__of").agg(F.first("__n").alias("__n"), F.first("__start").alias("__start"), F.collect_list(F.struct("__k", "__place")).alias("__wanted"))
    inside = ranged.groupBy(by, "__range", value).agg(F.count("*").alias("__c")).join(held, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    upto = F.col("__start") + F.sum("__c").over(W.partitionBy(by, "__range").orderBy(value))
    met = inside.withColumn("__upto", upto).select(F.col(by).alias("__key"), "__n", F.col(value).alias("__v"), "__upto", "__c", F.inline("__wanted"))
    met = met.where((F.col("__place") < F.col("__upto")) & (F.col("__place") >= F.col("__upto") - F.col("__c")))
    return met.groupBy("__key", "__n").agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__v"))), lambda x: x["__v"]).alias("__at"))


def percentiles(rows: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """__key (the group) and a column per share: the exact percentile, between neighbours in proportion."""
    at = lambda share, n: F.lit(share) * (n - 1)
    found = values_at(rows, value, by, lambda n: [f(at(p, n)) for p in shares.values() for f in (F.floor, F.ceil)])
    low, high = (lambda k: F.get("__at", F.lit(2 * k))), (lambda k: F.get("__at", F.lit(2 * k + 1)))
    part = lambda p: at(p, F.col("__n")) - F.floor(at(p, F.col("__n")))
    return found.select("__key", *[(low(k) + (high(k) - low(k)) * part(p)).alias(name) for k, (name, p) in enumerate(shares.items())])


def spread(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Exact mean, median, p95, p99, extremes and count of what is not null, by group."""
    x = F.col(value)
    sums = rows.where(x.isNotNull()).groupBy(by).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    both = sums.join(percentiles(rows, value, by, {"median": 0.5, "p95": 0.95, "p99": 0.99}), F.col(by).eqNullSafe(F.col("__key")))
    return both.select(by, "mean", "median", "p95", "p99", "min", "max", "n")


def detection_rates(rows: DataFrame, by: str, detectors: dict[str, Column], actual: str = "actual") -> DataFrame:
    """by and a column per detector: the share of the actual positives that it finds, 0 where there are none."""
    rate = lambda found: ratio(F.count_if(F.col(actual) & found), F.count_if(F.col(actual)))
    return rows.groupBy(by).agg(*[rate(found).alias(name) for name, found in detectors.items()])


def rank_percent(rows: DataFrame, value: str, by: str, tie: str) -> DataFrame:
    """The cumulative share of each row in the order of positive values, within each group: rank / n * 100; tie orders equal
    values.

    A group is not ranked in one task, nor is a value that most rows share: ranks run along ranges of (group, value, tie), see
    blocks."""
    positive = rows.where(F.col(value) > 0)
    ranked = blocks.running_sum(positive, (by,), (value, tie), F.lit(1), "__rank")
    counted = blocks.joined(ranked, positive.groupBy(by).agg(F.count("*").alias("__n")), (by,))
    return counted.withColumn("cdf", F.col("__rank") * 100.0 / F.col("__n")).select(*rows.columns, "cdf")


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    """label, n, share: how many rows each class has."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all"))), F.lit(True)).select(label, "n", ratio(F.col("n"), F.col("__all")).alias("share"))


def run_summary(tasks: DataFrame, seconds: str, succeeded: Column, wall: float, workers: int) -> DataFrame:
    """One row of a run: tasks, successes and their rate, seconds of work, speed-up over one after the other, efficiency."""
    out = tasks.agg(F.count("*").alias("n_tasks"), F.count_if(succeeded).alias("n_succeeded"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("work_seconds"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_seconds"))
    out = out.withColumns({"success_rate": ratio(F.col("n_succeeded"), F.col("n_tasks")), "speedup": ratio(F.col("work_seconds"), F.lit(wall))})
    return out.withColumn("efficiency", F.col("speedup") / workers)


def ablation_table(rows: DataFrame, configuration: str, cost: str, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Per configuration the confusion with its rates, the total cost and the cost of a true positive (0 without one)."""
    sums = rows.groupBy(configuration).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"))
    both = confusion(rows, configuration, predicted=predicted, actual=actual).withColumnRenamed(configuration, "__of").join(sums, F.col("__of").eqNullSafe(F.col(configuration))).drop("__of")
    return both.withColumn("cost_per_tp", ratio(F.col("total_cost"), F.col("tp")))


def relative_to(rows: DataFrame, key: str, base: str, value: str) -> DataFrame:
    """Improvement of each configuration over the base one in percent; the table has a row per configuration."""
    own = rows.where(F.col(key) == base).select(F.col(value).alias("__base"))
    return rows.join(F.broadcast(own.limit(1)), F.lit(True)).withColumn("improvement", F.coalesce(F.try_divide((F.col(value) - F.col("__base")) * 100.0, F.col("__base")), F.lit(0.0))).drop("__base")
