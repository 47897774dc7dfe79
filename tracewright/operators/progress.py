"""Counters that run along an ordered stream of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tracewright.operators.evaluation import ratio
from tracewright.operators.storage import kept

COUNTERS = ("tp", "tn", "fp", "fn", "escalated", "dropped")


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the running sums of the given columns in the order of `order`, nulls first, each row included.

    Exact prefix sums over the cluster: rows are dealt into ranges of the order, a window sums within each range, and what the ranges
    before it sum to, a table with a row per range, is added. Equal places stand in one range and count in the order of a hash of
    their rows (without maps and variants), so that any number of tasks gives the same sums; `order` should tell rows apart. A null adds nothing."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    tie = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
    dealt = rows.withColumns({f"__add_{k}": F.coalesce(sums[k].cast("long"), F.lit(0).cast("long")) for k in names} | {"__tie": tie})
    dealt = kept(dealt.repartitionByRange(n, *order, "__tie").withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*[F.sum(f"__add_{k}").alias(f"__sum_{k}") for k in names])
    earlier = totals.select(F.col("__range").alias("__earlier"), *[F.col(f"__sum_{k}") for k in names])
    ranges = totals.select("__range").join(F.broadcast(earlier), F.col("__earlier") < F.col("__range"), "left")  # a row per range
    starts = ranges.groupBy("__range").agg(*[F.coalesce(F.sum(f"__sum_{k}"), F.lit(0)).alias(f"__start_{k}") for k in names])
    upto = W.partitionBy("__range").orderBy(*order, "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = dealt.withColumns({f"__upto_{k}": F.sum(f"__add_{k}").over(upto) for k in names})
    out = inside.join(F.broadcast(starts), "__range")
    return out.select(*rows.columns, *[(F.col(f"__start_{k}") + F.col(f"__upto_{k}")).alias(k) for k in names])


def counters(predicted: Column, actual: Column, escalated: Column) -> dict[str, Column]:
    """What a result adds to each counter. One without a verdict or a label is dropped and adds to no other."""
    scored = predicted.isNotNull() & actual.isNotNull()
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return {
        "tp": one(predicted & actual),
        "tn": one(~predicted & ~actual),
        "fp": one(predicted & ~actual),
        "fn": one(~predicted & actual),
        "escalated": one(scored & escalated),
        "dropped": one(~scored),
    }


def progress(results: DataFrame, order: list[str], predicted: Column, actual: Column, escalated: Column) -> DataFrame:
    """results with the counters after each of them, completed, and the accuracy and share of escalations in percent so far, 0 before
    the first one that is scored."""
    out = running(results, order, counters(predicted, actual, escalated))
    scored = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    out = out.withColumn("completed", scored + F.col("dropped"))
    return out.withColumns({"accuracy": ratio((F.col("tp") + F.col("tn")) * 100, scored), "escalated_share": ratio(F.col("escalated") * 100, scored)})


def observed(stream: DataFrame, predicted: Column, actual: Column, escalated: Column, name: str = "progress") -> DataFrame:
    """The stream itself; each of its batches tells the sums of the counters over its rows under the given name."""
    return stream.observe(name, *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in counters(predicted, actual, escalated).items()])


class Progress(StreamingQueryListener):
    """Adds up what the batches of an observed stream tell. A batch that is told twice, as after a restart, counts once; totals() are
    those of the batches that this listener has heard of."""

    def __init__(self, name: str = "progress"):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = {k: int(told[k]) for k in COUNTERS}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        return {k: sum(b[k] for b in self.batches.values()) for k in COUNTERS}
