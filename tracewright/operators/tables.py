"""Operators of the data tools over any table: cleaning, filtering, enriching, comparing, ledgers, search."""

from __future__ import annotations

from functools import partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators import blocks

#: What a filter may ask of a column.
COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
}
#: Common words that tell languages apart; the first language with the most wins.
COMMON_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for"),
    "de": ("der", "die", "und", "das", "nicht", "ist", "ein", "mit", "auf", "sich"),
    "fr": ("le", "les", "et", "des", "en", "du", "une", "est", "dans", "pour"),
    "es": ("el", "los", "que", "y", "del", "se", "las", "por", "un", "con"),
}


def clean(rows: DataFrame, same: Column, first: str, means: tuple[str, ...] = (), constants: dict[str, str] | None = None) -> DataFrame:
    """One row of those that agree in same, the one with the least first (null last); nulls of means become the mean of the
    column in the table, nulls of constants the given value."""
    columns = rows.columns
    once = rows.groupBy(F.xxhash64(same).alias("__h"), F.sha2(same.cast("string"), 256).alias("__s")).agg(F.min_by(F.struct(*columns), F.coalesce(F.col(first), F.lit((1 << 63) - 1))).alias("__r")).select("__r.*")
    if means:
        found = rows.agg(*[F.avg(c).alias(c) for c in means]).first()
        once = once.withColumns({c: F.coalesce(F.col(c), F.lit(found[c])) for c in means})
    return once.fillna(constants or {}).select(*columns)


def filter_steps(rows: DataFrame, steps: list[tuple[str, str, object]]) -> DataFrame:
    """step, remaining: the rows that are left after each of the comparisons (column, operator, value), in one pass."""
    tests = [F.coalesce(COMPARE[op](F.col(column), value), F.lit(False)) for column, op, value in steps]
    counts = rows.agg(*[F.count_if(reduce(and_, tests[: k + 1])).alias(f"{k}") for k in range(len(tests))])
    each = [F.struct(F.lit(k + 1).alias("step"), F.col(f"{k}").alias("remaining")) for k in range(len(tests))]
    return counts.select(F.inline(F.array(*each)))


def aggregated(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def match_rate(rows: DataFrame, key: str, other: DataFrame, other_key: str, *by: str) -> DataFrame:
    """n, matched and rate of the rows whose key is in other; a key that other repeats counts once."""
    known = other.select(F.col(other_key).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__m", F.lit(1))
    joined = rows.join(known, F.col(key) == F.col("__k"), "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.count("__m").alias("matched")).withColumn("rate", F.col("matched") / F.col("n"))


def cohorts(rows: DataFrame, value: str, in_first: Column, *by: str) -> DataFrame:
    """The mean of value in either cohort, and how far the second is above the first, also as a percentage."""
    means = rows.groupBy(*by).agg(F.avg(F.when(in_first, F.col(value))).alias("first_mean"), F.avg(F.when(~in_first, F.col(value))).alias("second_mean"))
    means = means.withColumn("difference", F.col("second_mean") - F.col("first_mean"))
    return means.withColumn("percent", F.try_divide(F.col("difference") * 100, F.col("first_mean")))


def correlated(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("correlation"), F.covar_samp(x, y).alias("covariance"))


def segments(rows: DataFrame, value: str, cuts: dict[str, float], above: str) -> DataFrame:
    """segment, n, mean: a row is in the first segment whose bound its value is below; null values are in none."""
    name = None
    for label, bound in cuts.items():
        name = F.when(F.col(value) < bound, label) if name is None else name.when(F.col(value) < bound, label)
    return rows.where(F.col(value).isNotNull()).groupBy(name.otherwise(above).alias("segment")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def keywords(docs: DataFrame, text: str, group: str, most: int, stop: tuple[str, ...], least: int = 4) -> DataFrame:
    """group, word, n, rank: the most frequent words of a-z of each group. Words are counted before they are ranked, and the
    ranking keeps only the first ones of each partition."""
    found = docs.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = found.where((F.length("word") >= least) & ~F.col("word").isin(*stop)).groupBy(group, "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.col("n").desc(), "word")))
    return ranked.where(F.col("rank") <= most)


def _among(known: tuple[str, ...], word: Column) -> Column:
    return word.isin(*known)


def language(text: Column) -> Column:
    """The language with the most common words in the text; unknown if there are none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    common = F.filter(words, partial(_among, tuple({w for known in COMMON_WORDS.values() for w in known})))
    # lambda variables, so that words and votes are computed once
    votes = F.transform(F.array(common), lambda found: F.array(*[F.size(F.filter(found, partial(_among, known))) for known in COMMON_WORDS.values()]))
    named = lambda v: F.element_at(F.array(*map(F.lit, COMMON_WORDS)), F.array_position(v, F.array_max(v)).cast("int"))
    return F.get(F.transform(votes, lambda v: F.when(F.array_max(v) > 0, named(v)).otherwise("unknown")), F.lit(0))


def health(rows: DataFrame, bad: Column, *by: str) -> DataFrame:
    """n, n_bad, percent that are not bad, and its level: healthy above 80, fair from 50, else poor."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    out = out.withColumn("percent", (F.col("n") - F.col("n_bad")) * 100 / F.col("n"))
    return out.withColumn("level", F.when(F.col("percent") > 80, "healthy").when(F.col("percent") >= 50, "fair").otherwise("poor"))


def ledger(rows: DataFrame, key: str, order: tuple[str, ...], change: Column, reorder_below: int) -> DataFrame:
    """rows with balance, which starts at 0 and stops at 0 where more goes out than there is, and reorder: an outgoing row has
    left less than the level. A key's rows are not gathered: see blocks."""
    out = blocks.clamped_sum(rows.withColumn("__change", change), (key,), order, F.col("__change"), "balance")
    return out.withColumn("reorder", (F.col("__change") < 0) & (F.col("balance") < reorder_below)).drop("__change")


def last(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    back = F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc()))
    return rows.withColumn("__back", back).where(F.col("__back") <= n).drop("__back")


def recommended(rows: DataFrame, key: str, seed: int, points: dict[str, int], most: int = 5) -> DataFrame:
    """The rows that share most with the seed's row, by the points of each column; ties go to the least key."""
    like = rows.where(F.col(key) == seed).select(*points).first()
    if like is None:
        return rows.select(key, F.lit(0).alias("score")).limit(0)
    score = sum((F.when(F.col(c) == like[c], n).otherwise(0) for c, n in points.items()), F.lit(0))
    return rows.where(F.col(key) != seed).select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(most)


def search(query: str, **tables: tuple[DataFrame, str, str]) -> DataFrame:
    """kind, id of the rows whose text contains the query in any case; tables: kind = (rows, id, text)."""
    out = None
    for kind, (rows, key, text) in tables.items():
        part = rows.where(F.contains(F.lower(text), F.lit(query.lower()))).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def loops(rows: DataFrame, key: str, order: tuple[str, ...], call: str, times: int = 3) -> DataFrame:
    """key, n_loops: rows whose call equals each of the calls just before it, so many in a row; keys without loops stay out. A null
    call equals none. A key's rows are not gathered: a run of n equal calls has n + 1 - times loops."""
    run = blocks.previous_row(rows.select(key, *order, F.col(call).alias("__call")), (key,), order, F.col("__call"), "__prev")
    fresh = F.coalesce(F.col("__call") != F.col("__prev"), F.lit(True))
    runs = blocks.running_sum(run, (key,), order, fresh, "__run").groupBy(key, "__run").agg((F.count("*") + 1 - times).alias("__n"))
    return runs.where("__n > 0").groupBy(key).agg(F.sum("__n").alias("n_loops"))


def repeated_sets(messages: DataFrame, key: str, order: str, calls: str, times: int = 2) -> DataFrame:
    """The messages (all columns) that make the same set of calls as at least so many earlier ones, back to the last message of their
    key without calls. calls is an array; a null one counts as empty, and such messages repeat nothing."""
    listed = messages.withColumn("__set", F.array_sort(F.array_distinct(F.coalesce(F.col(calls), F.array().cast(dict(messages.dtypes)[calls])))))
    parts = blocks.running_sum(listed, (key,), (order,), F.size("__set") == 0, "__part")
    nth = blocks.running_sum(parts.where(F.size("__set") > 0), (key, "__part", "__set"), (order,), F.lit(1), "__nth")
    return nth.where(F.col("__nth") > times).select(*messages.columns)


def attached(rows: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """rows with turn_group: the number of rows that open a group up to here; 0 before the first one."""
    return blocks.running_sum(rows, (key,), (order,), opens, "turn_group")
