"""How far the sources of a language stand from one another, by joint histograms of counts.

Each (lang, source) group gives every kept term a smoothed share in parts of SCALE. A pair of groups is compared by a sum over all
kept terms of a function of both shares, and a share depends on the term's count alone. So the terms of a pair are first tallied by
their two counts, with the cells where one or both counts are zero implied by the marginal histograms, and the function is then
evaluated once for each combination and multiplied by its tally. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import bounded, saved, stored, whole

SCALE = 1_000_000_000
#: A language keeps the terms of at least so many of its documents.
LEAST_DOCS = 3
#: The part of single terms is listed to this rank.
TOP = 200
#: A task hands out its partial counts when it holds so many; Spark adds them up.
HELD = 300_000

#: Bytes of UTF-8: A-Z becomes a-z, other letters and all of the non-ASCII ones stay, the rest parts terms.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_COUNTS = "lang string, source string, term string, n long, n_docs long"


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (lang, source, term) of the task its occurrences and documents, handed out in bounded parts."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def out(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, ns, docs = [], [], [], [], []
        for (lang, source), (n, n_docs) in held.items():
            langs += [lang] * len(n)
            sources += [source] * len(n)
            terms += n.keys()
            ns += n.values()
            docs += map(n_docs.__getitem__, n)
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(docs, pa.int64())], schema=schema)

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = text.translate(_TERM_BYTES).split()
            n, n_docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(found)
            n_docs.update(set(found))
            size += len(n) - before
            if size >= HELD:
                yield out(held)
                held, size = {}, 0
    yield out(held)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, counts (the term's sources with their counts, in order of the source): one row per kept term.

    One shuffle by (lang, term) serves both sums. A row holds an entry per source of the language, of which the result has one row
    per pair."""
    texts = docs.select(whole(F.col("lang")).alias("lang"), whole(F.col("source")).alias("source"), whole(F.col("text")).cast("binary").alias("text"))
    partial = texts.mapInArrow(_partial_counts, _COUNTS).repartition("lang", "term")
    counted = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    of = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    terms = counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), of)
    return terms.where(F.col("n_docs") >= least_docs).drop("n_docs")


def _share(n: str, size: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + kept)); decimals, since the product of a large corpus is no long."""
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(10)) * CAST({n} + 1 AS DECIMAL(18))) div CAST(greatest({size} + {kept}, 1) AS DECIMAL(18))")


def _distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)"""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms), kept (terms of the language), lang_size: each occurring group."""
    occurring = docs.select(whole(F.col("lang")).alias("lang"), whole(F.col("source")).alias("source")).distinct()
    sizes = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    return occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "kept", "lang_size"])


def joint_histogram(kept: DataFrame, of: DataFrame) -> DataFrame:
    """lang, a, b, na, nb, m: for each pair of sources a < b of a language, how many kept terms a has na times and b nb times.

    Terms with the same counts in all sources are counted as one row first. Each pair of sources that share a term adds it to its
    own cell and takes it from the cells where one of them would have it alone; the marginal histograms fill those."""
    profiles = kept.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    one = profiles.select("lang", "m", "counts", F.posexplode("counts").alias("at", "x"))
    both = one.where(F.col("at") + 1 < F.size("counts")).select("lang", "m", "x", F.explode(F.slice("counts", F.col("at") + 2, F.size("counts"))).alias("y"))
    cell = lambda na, nb, sign: F.struct(na.alias("na"), nb.alias("nb"), (F.col("m") * sign).alias("m"))
    zero, nx, ny = F.lit(0).cast("long"), F.col("x.n"), F.col("y.n")
    shared = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.inline(F.array(cell(nx, ny, 1), cell(nx, zero, -1), cell(zero, ny, -1), cell(zero, zero, 1))))
    pairs = of.select("lang", F.col("source").alias("a"), "kept").join(of.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    alone = profiles.select("lang", "m", F.inline("counts")).groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
    n = F.col("n")
    first = alone.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).select("lang", "a", "b", F.inline(F.array(cell(n, zero, 1), cell(zero, zero, -1))))
    second = alone.withColumnRenamed("source", "b").join(pairs, ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(zero, n, 1), cell(zero, zero, -1))))
    neither = pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), F.col("kept").alias("m"))
    return shared.unionByName(first).unionByName(second).unionByName(neither).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))


def pair_values(kept: DataFrame, of: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: summed over all kept terms, 0 where there are none."""
    a = of.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), "kept")
    b = of.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"))
    cells = joint_histogram(kept, of).join(bounded(a), ["lang", "a"]).join(bounded(b), ["lang", "b"])
    shares = cells.select("lang", "a", "b", "m", _share("na", "size_a", "kept").alias("p"), _share("nb", "size_b", "kept").alias("q"))
    each = lambda p, q: F.sum(_distance(p, q) * F.col("m"))
    sums = shares.groupBy("lang", "a", "b").agg(each("p", "q").alias("ab"), each("q", "p").alias("ba"))
    way = lambda s, t, v: F.struct(F.col(s).alias("source"), F.col(t).alias("item"), F.col(v).alias("value"))
    return sums.select("lang", F.inline(F.array(way("a", "b", "ab"), way("b", "a", "ba"))))


def term_values(kept: DataFrame, of: DataFrame) -> DataFrame:
    """lang, source, item (a term of the group with a larger share than in its language), value."""
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.inline("counts")).join(bounded(of), ["lang", "source"])
    shares = rows.select("lang", "source", "item", _share("n", "size", "kept").alias("p"), _share("total", "lang_size", "kept").alias("q"))
    return shares.where("p > q").select("lang", "source", "item", _distance("p", "q").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: of each group its distance to the other sources of its language (part pair, all
    ranks), and its terms with a larger share than in the language (part term, ranks to top); rank by value, ties by item.

    Null text, lang and source count as empty. Every row is a document of its own, whatever its id. A language without kept terms
    gives pairs of value 0; a source that is alone in its language, or an empty table, gives no pair. Other columns are not read."""
    kept = stored(kept_terms(docs, least_docs))
    of = saved(groups(docs, kept))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair_values(kept, of).withColumn("rank", F.row_number().over(order))
    term = term_values(kept, of).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pair, "pair").unionByName(out(term, "term"))
