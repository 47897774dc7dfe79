"""Overlap of intervals of any length, by dyadic bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The least level above 0 whose bins, 2 ** level ticks wide, are as long as the interval: it then touches two of them at most."""
    return F.length(F.bin(F.greatest(length, F.lit(1)) - 1))


def _bins(level: Column) -> Column:
    """The one or two bins of a level that the ticks of __from to __to touch."""
    at = lambda tick: F.call_function("shiftright", F.col(tick), level.cast("int"))
    return F.array_distinct(F.array(at("__from"), at("__last")))


def overlaps(rows: DataFrame, key: str, start: str, end: str, *group: str) -> DataFrame:
    """a, b: the keys of each two intervals of a group with a.start < b.end and b.start < a.end, once, a < b.

    start and end are timestamps or whole numbers; an interval is open at its end, and one without length overlaps those around it.
    It is at home in the bins of its own level and visits those of every coarser level that the table has. Two intervals so meet in
    bins of the longer one's level only, each of which is at most twice its length: nearly all that meet there do overlap, and no bin
    grows with the longest interval. Of two common bins the one with the later start counts. An interval with a null start, end, group
    or key, or that ends before it begins, overlaps nothing; rows that share a key are no pair with each other. Bins of a crowded time
    are ordinary join keys, which Spark splits where they are skewed."""
    tick = lambda name: F.unix_micros(F.col(name).cast("timestamp")) if dict(rows.dtypes)[name].startswith("timestamp") else F.col(name).cast("long")
    named = {f"__g{k}": F.col(g) for k, g in enumerate(group)}
    each = rows.select(F.col(key).alias("__key"), *[c.alias(n) for n, c in named.items()], tick(start).alias("__from"), tick(end).alias("__to"))
    each = each.where((F.col("__from") <= F.col("__to")) & F.col("__key").isNotNull()).dropna(subset=list(named) or ["__from"])
    each = each.withColumns({"__last": F.greatest(F.col("__to") - 1, F.col("__from")), "__level": _level(F.col("__to") - F.col("__from"))})
    levels = sorted(r[0] for r in each.select("__level").distinct().collect())  # 64 at most
    home = each.withColumn("__bin", F.explode(_bins(F.col("__level"))))
    coarser = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= F.col("__level"))
    visits = each.withColumn("__at", F.explode(coarser)).withColumn("__bin", F.explode(_bins(F.col("__at"))))
    h = home.select(*named, "__bin", F.col("__level").alias("__at"), F.col("__key").alias("__a"), F.col("__from").alias("__from_a"), F.col("__to").alias("__to_a"))
    v = visits.select(*named, "__bin", "__at", "__level", F.col("__key").alias("__b"), F.col("__from").alias("__from_b"), F.col("__to").alias("__to_b"))
    meets = (F.col("__from_a") < F.col("__to_b")) & (F.col("__from_b") < F.col("__to_a"))
    first = F.col("__bin") == F.call_function("shiftright", F.greatest("__from_a", "__from_b"), F.col("__at").cast("int"))
    once = F.when(F.col("__level") == F.col("__at"), F.col("__a") < F.col("__b")).otherwise(F.col("__a") != F.col("__b"))
    found = h.join(v, [*named, "__at", "__bin"]).where(meets & first & once)
    return found.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))


def conflicts(rows: DataFrame, key: str, start: str, end: str, day: Column, *group: str) -> DataFrame:
    """The groups and days with two intervals that overlap; an interval belongs to the day of its start."""
    of = rows.withColumn("__day", day)
    pairs = overlaps(of, key, start, end, *group, "__day")
    days = of.select(F.col(key).alias("a"), *group, F.col("__day").alias("day"))
    return days.join(pairs.select("a"), "a", "left_semi").select(*group, "day").distinct()
