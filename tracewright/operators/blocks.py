"""Ordered work along each key's rows without one task for a key: rows lie in ranges of (key, order), each range is worked through on its
own, and what the ranges before it hand on is composed over a table with a row per key and range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.storage import kept


def joined(rows: DataFrame, handed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows with the other columns of handed, which has one row for each value of the named ones; null equals null."""
    own = handed.withColumnsRenamed({n: f"__{k}_of" for k, n in enumerate(names)})
    same = F.lit(True)
    for k, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"__{k}_of"))
    return rows.join(own, same).drop(*[f"__{k}_of" for k in range(len(names))])


@dataclass(frozen=True)
class Blocks:
    """rows with __range; rows with the same key and order lie in one range. Null keys are a key, null places come first."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def inside(self) -> WindowSpec:
        """A key's rows of a range, in order."""
        return W.partitionBy(*self.keys, "__range").orderBy(*self.order)

    @property
    def upto(self) -> WindowSpec:
        return self.inside.rowsBetween(W.unboundedPreceding, W.currentRow)

    @property
    def ranges(self) -> WindowSpec:
        """A key's ranges, in order; a key has at most as many as there are."""
        return W.partitionBy(*self.keys).orderBy("__range")

    @property
    def before(self) -> WindowSpec:
        return self.ranges.rowsBetween(W.unboundedPreceding, -1)

    def totals(self, rows: DataFrame, **sums: Column) -> DataFrame:
        return rows.groupBy(*self.keys, "__range").agg(*[c.alias(n) for n, c in sums.items()])

    def carried(self, rows: DataFrame, totals: DataFrame, name: str, value: Column) -> DataFrame:
        """rows with value, a window over the totals of their key's ranges."""
        return joined(rows, totals.select(*self.keys, "__range", value.alias(name)), (*self.keys, "__range"))


def dealt(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> Blocks:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Blocks(kept(rows.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id())), keys, order)


def running_sum(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """rows with the running sum of value along each key; rows at the same place count in any order, nulls add nothing."""
    b = dealt(rows.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), keys, order)
    out = b.carried(b.rows, b.totals(b.rows, __all=F.sum("__v")), "__start", F.coalesce(F.sum("__all").over(b.before), F.lit(0)))
    return out.withColumn(name, F.col("__start") + F.sum("__v").over(b.upto)).drop("__v", "__start", "__range")


def previous_row(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], what: Column, name: str) -> DataFrame:
    """rows with the value of `what` on the row just before, null on a key's first row."""
    b = dealt(rows.withColumn("__v", F.struct(what.alias("of"))), keys, order)
    totals = b.totals(b.rows, __last=F.max_by("__v", F.struct(*order)))
    out = b.carried(b.rows, totals, "__before", F.last("__last").over(b.before))
    return out.withColumn(name, F.coalesce(F.lag("__v").over(b.inside), F.col("__before"))["of"]).drop("__v", "__before", "__range")


def clamped_sum(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], change: Column, name: str) -> DataFrame:
    """rows with a balance that starts at 0, takes each change and stops at 0 where more goes out than there is.

    A range turns the balance x before it into max(x + s, m): s is the sum of its changes, m what it leaves of nothing. Such functions
    compose, so ranges are chained by two running values, and within a range the clamp is a least running sum."""
    b = dealt(rows.withColumn("__c", F.coalesce(change.cast("long"), F.lit(0).cast("long"))), keys, order)
    summed = kept(b.rows.withColumn("__p", F.sum("__c").over(b.upto)))
    totals = b.totals(summed, __s=F.sum("__c"), __m=F.sum("__c") - F.least(F.lit(0), F.min("__p")))
    totals = totals.withColumn("__gain", F.col("__m") - F.sum("__s").over(b.ranges.rowsBetween(W.unboundedPreceding, W.currentRow)))
    start = F.coalesce(F.sum("__s").over(b.before) + F.greatest(F.lit(0), F.max("__gain").over(b.before)), F.lit(0))
    out = b.carried(summed, totals, "__start", start)
    return out.withColumn(name, F.col("__p") - F.least(-F.col("__start"), F.min("__p").over(b.upto))).drop("__c", "__p", "__start", "__range")


def latest_earlier(rows: DataFrame, keys: tuple[str, ...], order: str, what: Column, name: str) -> DataFrame:
    """rows with the greatest `what` among the key's rows at the latest strictly earlier place; null where there is none, for a null
    key and for a null place."""
    b = dealt(rows.withColumn("__v", F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("at"), what.alias("of")))), keys, (order,))
    places = b.rows.groupBy(*keys, "__range", order).agg(F.max("__v").alias("__upto"))
    places = b.carried(places, b.totals(b.rows, __last=F.max("__v")), "__before", F.max("__last").over(b.before))
    earlier = F.max("__upto").over(b.inside.rowsBetween(W.unboundedPreceding, -1))
    out = joined(b.rows, places.select(*keys, order, F.coalesce(earlier, F.col("__before")).alias("__prev")), (*keys, order))
    known = F.col(order).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return out.select(*rows.columns, F.when(known, F.col("__prev.of")).alias(name))
