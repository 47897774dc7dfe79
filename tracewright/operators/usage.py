"""Counts over time, tools and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import blocks


def nested_counts(calls: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per outer: its number of calls, and inner -> count as entries in order of the name."""
    counts = calls.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counts.groupBy(outer).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.concat_ws("=", inner, F.col("n").cast("string")))).alias("tools"))


def mcp_split(calls: DataFrame, name: str, *by: str) -> DataFrame:
    """Calls of servers' tools (mcp__server__tool) and of others, the share of the first and the servers used, by the given
    columns. A null name is no server's."""
    server = scalars.mcp_parts(F.col(name))["server"]
    counts = calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count(server).alias("n_mcp"), F.countDistinct(server).alias("n_servers"))
    return counts.withColumns({"n_native": F.col("n_calls") - F.col("n_mcp"), "mcp_ratio": F.col("n_mcp") / F.greatest("n_calls", F.lit(1)), "used_mcp": F.col("n_mcp") > 0})


def server_counts(calls: DataFrame, name: str, session: str) -> DataFrame:
    """server, n_calls, n_sessions (that used it at least once)."""
    rows = calls.withColumn("server", scalars.mcp_parts(F.col(name))["server"]).where("server IS NOT NULL")
    return rows.groupBy("server").agg(F.count("*").alias("n_calls"), F.countDistinct(session).alias("n_sessions"))


def top(rows: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n most frequent values, by name where counts agree."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(n)


def top_in_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps only n per task and group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def buckets(rows: DataFrame, ts: str, width: str, value: str, *tags: str) -> DataFrame:
    x = F.col(value)
    out = rows.groupBy(F.window(ts, width).alias("w"), *tags).agg(F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *tags, "sum", "avg", "min", "max", "n")


def anomaly_score(rows: DataFrame, bad: Column, *by: str) -> DataFrame:
    """Error rate in percent, at most 100, with its level."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    score = F.least(F.lit(100.0), F.col("n_bad") * 100.0 / F.col("n"))
    return out.withColumn("score", score).withColumn("level", F.when(F.col("score") > 50, "high").when(F.col("score") > 20, "medium").otherwise("low"))


def growth(series: DataFrame, group: str, order: str, value: str, n: int = 7) -> DataFrame:
    """Mean of the last n points against that of the first n, with a trend from 5 percent on."""
    by = W.partitionBy(group)
    ranked = series.withColumns({"__up": F.row_number().over(by.orderBy(order)), "__down": F.row_number().over(by.orderBy(F.col(order).desc()))})
    out = ranked.groupBy(group).agg(F.avg(F.when(F.col("__up") <= n, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("__down") <= n, F.col(value))).alias("last_mean"))
    out = out.withColumn("growth", F.coalesce(F.try_divide((F.col("last_mean") - F.col("first_mean")) * 100.0, F.col("first_mean")), F.lit(0.0)))
    return out.withColumn("trend", F.when(F.col("growth") > 5, "up").when(F.col("growth") < -5, "down").otherwise("stable"))


def bursts(rows: DataFrame, key: str, ts: str, gap: str, least: int) -> DataFrame:
    """Runs of events of a key with no gap as long as the given one (an interval, like "30 minutes"), of at least so many events. Rows
    without a time belong to no run. A key's rows are not gathered: see blocks."""
    timed = rows.where(F.col(ts).isNotNull()).groupBy(key, ts).agg(F.count("*").alias("__n"))
    run = blocks.previous_row(timed, (key,), (ts,), F.col(ts), "__prev")
    fresh = F.coalesce(F.col(ts) >= F.col("__prev") + F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = blocks.running_sum(run, (key,), (ts,), fresh, "__run")
    out = numbered.groupBy(key, "__run").agg(F.min(ts).alias("began"), F.sum("__n").alias("n"))
    return out.where(F.col("n") >= least).select(key, "began", "n")


def previous(rows: DataFrame, group: str, order: str, tie: str, keep: str) -> DataFrame:
    """The latest strictly earlier row of the same group (as of its time): prev_id (its tie) and prev_value (its keep); of several at
    that time the one with the greatest tie.

    Every row stays: without a group, a time or an earlier row both are null. A group's rows are not gathered: see blocks."""
    out = blocks.latest_earlier(rows, (group,), order, F.struct(F.col(tie).alias("tie"), F.col(keep).alias("keep")), "__prev")
    return out.withColumns({"prev_id": F.col("__prev.tie"), "prev_value": F.col("__prev.keep")}).drop("__prev")


def zscores(rows: DataFrame, group: str, value: str, least: float) -> DataFrame:
    """Rows whose value is at least so many standard deviations from their group's mean."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    z = F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))
    return rows.join(stats, group).withColumn("z", z).where(F.abs("z") >= least).drop("__m", "__s")
