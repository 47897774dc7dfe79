"""Health, alerts, listings and totals of the fleet, storage, sales and survey tools."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators.evaluation import ratio


def cluster_health(nodes: DataFrame, running: Column, load: str) -> DataFrame:
    """n, n_running, mean load, status (healthy above a share of 0.8) and band of the load: low to 30, medium to 70, high."""
    out = nodes.agg(F.count("*").alias("n"), F.count_if(running).alias("n_running"), F.avg(load).alias("mean_load"))
    status = F.when(ratio(F.col("n_running"), F.col("n")) > 0.8, "healthy").otherwise("degraded")
    return out.withColumns({"status": status, "band": F.when(F.col("mean_load") < 30, "low").when(F.col("mean_load") < 70, "medium").otherwise("high")})


def alerts(rows: DataFrame, value: str, critical: float, high: float, low: float) -> DataFrame:
    """The rows out of bounds with their alert; the gravest one counts."""
    level = F.when(F.col(value) >= critical, "critical").when(F.col(value) >= high, "high").when(F.col(value) <= low, "low")
    return rows.withColumn("alert", level).where("alert IS NOT NULL")


def status_counts(rows: DataFrame, status: str, statuses: tuple[str, ...], *by: str) -> DataFrame:
    """A column of counts for each of the statuses, beside all rows as total."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def matching(rows: DataFrame, **wanted: object) -> DataFrame:
    """The rows that agree with every stated value; (least, most) is a range with its ends, None asks nothing."""
    tests = [F.col(c).between(*v) if isinstance(v, tuple) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.where(reduce(and_, tests, F.lit(True)))


def unknown_members(groups: DataFrame, member: str, registry: DataFrame, key: str) -> DataFrame:
    """The rows of groups whose member is not in the registry; a null member is unknown."""
    return groups.join(registry.select(F.col(key).alias("__k")), F.col(member) == F.col("__k"), "left_anti")


def recent(rows: DataFrame, ts: str, now: Column, horizon: str, *by: str) -> DataFrame:
    """n_recent by the given columns: rows later than the horizon before now."""
    return rows.groupBy(*by).agg(F.count_if(F.col(ts) > now - F.expr(f"INTERVAL {horizon}")).alias("n_recent"))


def listing(files: DataFrame, path: str, size: str, prefix: str, most: int) -> DataFrame:
    """n and bytes of the first files, by path, under a prefix; the sum is of those listed."""
    listed = files.where(F.col(path).startswith(prefix)).orderBy(path).limit(most)
    return listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def engagement(posts: DataFrame, key: str, score: str, ts: str, since: str, *by: str) -> DataFrame:
    """Posts from a time on: n, total, mean and the best one (the least key of those with the highest score)."""
    best = F.min_by(key, F.struct(-F.col(score), F.col(key)))
    return posts.where(F.col(ts) >= F.lit(since).cast("timestamp")).groupBy(*by).agg(F.count("*").alias("n"), F.sum(score).alias("total"), F.avg(score).alias("mean"), best.alias("best"))


def daily_demand(moves: DataFrame, quantity: str, ts: str, *by: str) -> DataFrame:
    """Outgoing quantity over the number of days with any."""
    out = moves.where(F.col(quantity) < 0).groupBy(*by).agg(F.sum(F.abs(quantity)).alias("out_total"), F.countDistinct(F.to_date(ts)).alias("n_days"))
    return out.withColumn("per_day", ratio(F.col("out_total"), F.col("n_days")))


def listed_total(lists: DataFrame, key: str, ids: str, items: DataFrame, item: str, value: str) -> DataFrame:
    """key, n_items, n_missing, total: the values of the items that a list names, repeats counted; empty lists stay with 0."""
    names = lists.select(key, F.explode_outer(ids).alias("__id"))
    priced = names.join(items.select(F.col(item).alias("__item"), F.col(value).alias("__v")), F.col("__id") == F.col("__item"), "left")
    known = F.col("__item").isNotNull()
    return priced.groupBy(key).agg(F.count_if(known).alias("n_items"), F.count_if(F.col("__id").isNotNull() & ~known).alias("n_missing"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("total"))


def geo_summary(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: n, centre, bounds, spans, mean and greatest distance in km from the centre; points outside of the globe and
    null ones are left out."""
    valid = points.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    each = lambda f, name: [f(lat).alias(f"{name}_lat"), f(lon).alias(f"{name}_lon")]
    summary = valid.agg(F.count("*").alias("n"), *each(F.avg, "centre"), *each(F.min, "min"), *each(F.max, "max"))
    summary = summary.withColumns({"lat_span": F.col("max_lat") - F.col("min_lat"), "lon_span": F.col("max_lon") - F.col("min_lon")})
    centre = summary.select(F.col("centre_lat").alias("__lat"), F.col("centre_lon").alias("__lon"))
    away = scalars.haversine_km(F.col("__lat"), F.col("__lon"), F.col(lat), F.col(lon))
    far = valid.join(F.broadcast(centre), F.lit(True)).agg(F.avg(away).alias("mean_km"), F.max(away).alias("max_km"))
    return summary.join(F.broadcast(far), F.lit(True))


def peer_benchmark(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group its mean, its percent rank among the groups and whether it is in the top quarter; the groups are few, such as
    departments, and ranked as one list after they are aggregated."""
    means = rows.groupBy(group).agg(F.avg(value).alias("mean"))
    ranked = means.withColumn("percent_rank", F.percent_rank().over(W.orderBy("mean")))
    return ranked.withColumn("top_quarter", F.col("percent_rank") >= 0.75)


def distribution(answers: DataFrame, question: str, answer: str) -> DataFrame:
    """question, answer, n, percent of the answers to the question."""
    counts = answers.where(F.col(answer).isNotNull()).groupBy(question, answer).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(question)))
