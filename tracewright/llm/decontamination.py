"""Benchmark decontamination by containment of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.blooms import listed_only
from tracewright.llm.common import bounded, indices, numbered, saved, whole

SHINGLE, CONTAINMENT = 5, 0.8


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, so that case and punctuation do not hide a passage."""
    return F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), "")


def _shingles(w: Column, width: int, make) -> Column:
    return F.transform(indices(F.size(w) - (width - 1)), lambda i: make(*[F.get(w, i + k) for k in range(width)]))


def _hashes(w: Column, width: int) -> Column:
    return _shingles(w, width, lambda *x: F.xxhash64(*x))


def _texts(w: Column, width: int) -> Column:
    return _shingles(w, width, lambda *x: F.concat_ws(" ", *x))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, width, shingle, h and n_shingles: the distinct shingles of each item. Items shorter than a shingle are one
    shingle as they are; items without a word have no row. Rows with the same item_id are one item."""
    rows = items.select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    texts = F.coalesce(*[F.when(F.col("width") == k, _texts(F.col("w"), k)) for k in range(1, shingle + 1)])
    hashes = F.coalesce(*[F.when(F.col("width") == k, _hashes(F.col("w"), k)) for k in range(1, shingle + 1)])
    pairs = rows.select("item_id", "width", F.explode(F.arrays_zip(texts.alias("shingle"), hashes.alias("h"))).alias("x"))
    pairs = pairs.select("item_id", "width", F.col("x.shingle").alias("shingle"), F.col("x.h").alias("h")).distinct()
    return pairs.withColumn("n_shingles", F.count("*").over(W.partitionBy("item_id")))


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """width, h: the MinHash sketches of the items. The size of the sketch follows the size of the item: an item of m
    shingles keeps its m - ceil(containment * m) + 1 least hashes, and a document that contains enough of the item misses at
    most one hash less than that. So at least one is found, and the search loses no document."""
    keep = F.col("n_shingles") - F.ceil(F.lit(containment) * F.col("n_shingles") - 1e-9) + 1
    least = F.row_number().over(W.partitionBy("item_id").orderBy("h", "shingle"))
    return shingles.withColumn("__k", least).where(F.col("__k") <= keep).select("item_id", "width", "h")


def _both(width: str, h: str) -> Column:
    return F.xxhash64(h, width).alias("both")


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of every document that has the share of an item's shingles.

    Candidates are pairs that agree in a sketch hash; each is verified by the exact shingles of the whole document. Rows
    with the same doc_id (also null) count as one document. Null and empty texts, and an empty table on either side, give
    no rows. Only doc_id and text of docs, and item_id and text of items, are read."""
    shingles = saved(item_shingles(items, shingle))
    widths = [r.width for r in shingles.select("width").distinct().collect()]  # at most `shingle` numbers
    if not widths:
        widths = [shingle]
    sketch = saved(sketches(shingles, containment))
    keys = saved(sketch.select(_both("width", "h")).distinct())
    sampled = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    rows = sampled.select("doc_id", F.explode(_hashes(F.col("w"), widths[0])).alias("h")).withColumn("width", F.lit(widths[0]))
    for width in widths[1:]:
        rows = rows.unionByName(sampled.select("doc_id", F.explode(_hashes(F.col("w"), width)).alias("h")).withColumn("width", F.lit(width)))
    hits = listed_only(rows.withColumn("both", _both("width", "h")), keys, "both").drop("both").distinct()
    pairs = saved(hits.join(bounded(sketch), ["width", "h"]).select("doc_id", "item_id").distinct())
    wanted = pairs.select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.select("doc_id", "text").join(bounded(wanted), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    ws = texts.select("doc_id", plain_words(F.col("text")).alias("w"))
    own = None
    for width in widths:
        part = ws.select("doc_id", F.explode(F.array_distinct(_texts(F.col("w"), width))).alias("shingle")).withColumn("width", F.lit(width))
        own = part if own is None else own.unionByName(part)
    matched = own.join(bounded(shingles.select("item_id", "width", "shingle", "n_shingles")), ["width", "shingle"])
    exact = matched.groupBy("doc_id", "item_id", "n_shingles").agg(F.countDistinct("shingle").alias("n_found"))
    asked = pairs.select(F.col("doc_id").alias("__id"), F.col("item_id").alias("__item"))
    exact = exact.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("item_id").eqNullSafe(F.col("__item")), "left_semi")
    exact = exact.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return exact.where(F.col("n_found") >= F.ceil(F.lit(containment) * F.col("n_shingles") - 1e-9))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose own text contains an item, whatever their doc_id; all columns stay, repeated rows too."""
    rows = numbered(docs)
    bad = saved(contained(rows.select(F.col("__row").alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("__row")).distinct())
    return rows.join(bounded(bad), "__row", "left_anti").select(*docs.columns)
