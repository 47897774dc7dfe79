"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import bounded, n_words, numbered, saved

#: Rows of one source and size class that one window partition orders.
BLOCK_ROWS = 1_000
WEIGHTS = (5, 2, 1)


def sources_with_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: source, source_size (one row per source). Adds weight and target.

    Weights repeat over the sources by code point, null last. Targets share `share` times all words by weight, none above
    `most` times its source: sources are capped in the order of cap over weight until the level that the rest get fits.
    All sums are exact integers, so that the result does not depend on the order of rows. Works on the table of sources,
    which has one row each."""
    by_name = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, here = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rows = rows.withColumns({"__spent": F.coalesce(F.sum("cap").over(before), F.lit(0)), "__w": F.sum("weight").over(here) - F.coalesce(F.sum("weight").over(before), F.lit(0)), "__total": F.sum("source_size").over(here)})
    level = (F.lit(share) * F.col("__total") - F.col("__spent")) / F.col("__w")
    rows = rows.withColumn("__level", level).withColumn("__free", F.col("cap") > F.col("__level") * F.col("weight"))
    # the first source that is not capped sets the level of all that follow
    first = F.min(F.when(F.col("__free"), F.struct("__spent", "__level"))).over(here)["__level"]
    rows = rows.withColumn("__at", first)
    target = F.when(F.col("__at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("__at") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs.

    Within a source each document is expected target / source_size times. Documents are ordered by size class and a hash,
    expected copies are summed along that order from one random offset per source, and a document is taken once for every
    integer that its part of the sum crosses. Since sizes ascend along the order, words follow their target closely.

    The order within a source is cut into blocks of a size class and a range of hashes, of about BLOCK_ROWS rows each, so
    that a source with most of the rows is ranked by many tasks: a rank is the rows of earlier size classes, plus those of
    earlier blocks of the class, plus the rank in the block. Rows that agree in doc_id and size (repeated rows) are interchangeable; a source with no words, or a null or
    empty text, has target 0 or takes 0 words. A null source is a source."""
    return _mixed(docs, [], seed, share, most)


def _mixed(docs: DataFrame, keys: list[str], seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix with further columns of docs, which also order rows that agree in doc_id and size."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(*keys, "doc_id", "source", n_words(F.col("text")).alias("size"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("h"))
    rows = saved(rows.withColumn("bin", F.floor(2 * F.sqrt("size")).cast("int")))
    bins = saved(rows.groupBy("source", "bin").agg(F.count("*").alias("rows"), F.sum("size").alias("size")))
    targets = sources_with_targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    blocks = bins.select("source", "bin", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long").alias("n_blocks"))
    keyed = rows.alias("d").join(blocks.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin")))
    keyed = keyed.select("d.*", F.floor(F.col("h") * F.col("n_blocks") / F.lit(float(1 << 32))).cast("int").alias("block"))
    counts = keyed.groupBy("source", "bin", "block").agg(F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = bins.withColumn("n", F.col("rows")).select("source", "bin", earlier(W.partitionBy("source").orderBy("bin")).alias("before"))
    within = counts.select("source", "bin", "block", earlier(W.partitionBy("source", "bin").orderBy("block")).alias("before"))
    starts = within.alias("w").join(classes.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")) & (F.col("w.bin") == F.col("c.bin")))
    starts = starts.select("w.source", "w.bin", "w.block", (F.col("w.before") + F.col("c.before")).alias("start"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.withColumns({"rate": rate, "offset": offset})
    plan = starts.alias("s").join(rated.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target", "t.rate", "t.offset")
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("source", "bin", "block").orderBy("h", "doc_id", "size", *keys)))
    out = ranked.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bin") == F.col("p.bin")) & (F.col("r.block") == F.col("p.block")))
    upto = lambda k: F.floor(F.col("p.offset") + F.col("p.rate") * k)
    copies = (upto(F.col("p.start") + F.col("r.rank")) - upto(F.col("p.start") + F.col("r.rank") - 1)).cast("long")
    return out.select(*[f"r.{k}" for k in keys], "r.doc_id", "r.source", "r.size", "p.source_size", "p.target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """docs with a row for each copy that the mix takes and the column mix_copy (1, 2, ...).

    Each row has its own copies, also where its doc_id is null or repeated. A column mix_copy of docs is replaced; a row that
    is not taken is left out."""
    rows = numbered(docs.drop("mix_copy"))
    taken = saved(_mixed(rows, ["__row"], **options).where("copies > 0").select("__row", F.col("copies").alias("__copies")))
    both = rows.join(bounded(taken), "__row").drop("__row")
    return both.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop("__copies")
