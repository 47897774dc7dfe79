"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fold, saved, whole, words

#: Shares of the pooled covariance and of the identity in each class's covariance.
POOLED, IDENTITY = 0.3, 0.02
HELD_OUT, THRESHOLD = 0, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Transformed statistics of a text that is not null, by name; all are finite for every text."""
    w, lines = F.col("__w"), F.col("__l")
    n, chars = F.greatest(F.size(w), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda k, of: F.sqrt(k / of)
    return {
        "x_words": F.log1p(F.size(w)),
        "x_word_length": F.log1p(chars / n),
        "x_distinct": F.log((F.size(F.array_distinct(w)) + 1) / (n + 1)) / F.log1p(n),
        "x_symbols": share(count(r"[#*$%&|<>{}\\^~]"), chars),
        "x_upper": share(count(r"\p{Lu}"), chars),
        "x_shouts": share(count("[!?]"), chars),
        "x_digits": share(count("[0-9]"), chars),
        "x_stops": share(count("[.,]"), chars),
        "x_lines": share(F.size(lines), n),
        "x_twice": share(F.size(lines) - F.size(F.array_distinct(lines)), F.greatest(F.size(lines), F.lit(1))),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row; a null text counts as empty."""
    rows = docs.select("doc_id", whole(F.col("text")).alias("__t"), words(F.col("text")).alias("__w"), F.filter(F.split(whole(F.col("text")), "\n"), lambda x: F.trim(x) != "").alias("__l"))
    return rows.select("doc_id", *[c.cast("double").alias(k) for k, c in statistics(F.col("__t")).items()])


def fit(stats: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT) -> dict:
    """Means and inverse Cholesky factors by class from all labelled rows outside the held-out fold.

    One aggregation gives counts, means and products; the factors are computed once here. A doc_id with several labels counts
    as good if one of them is. A class without rows gets the other's shape, without labels every score is 0.5."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__y"))
    if held_out is not None:
        known = known.where(fold(F.col("doc_id")) != held_out)
    names = [c for c in stats.columns if c.startswith("x_")]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    moments = [F.count("*").alias("n"), *[F.avg(a).alias(a) for a in names], *[F.avg(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]]
    rows = {int(r["__y"]): r for r in stats.join(known, "doc_id").groupBy("__y").agg(*moments).collect()}
    d, model = len(names), {"names": names, "classes": {}}
    if not rows:
        return model
    total, own = sum(r["n"] for r in rows.values()), {}
    for y, r in rows.items():
        mean, cov = np.array([r[a] for a in names]), np.zeros((d, d))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            cov[i, j] = cov[j, i] = r[f"{a}*{b}"] - r[a] * r[b]
        own[y] = (r["n"], mean, cov)
    pooled = sum(n * cov for n, _, cov in own.values()) / total
    for y in (0, 1):
        n, mean, cov = own.get(y, (0, next(iter(own.values()))[1], pooled))
        shrunk = (1 - POOLED - IDENTITY) * cov + POOLED * pooled + IDENTITY * np.diag(np.diag(pooled)) + 1e-8 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        model["classes"][y] = {"prior": (n + 1) / (total + 2), "mean": mean.tolist(), "inverse": np.linalg.inv(factor).tolist(), "logdet": 2 * float(np.log(np.diag(factor)).sum())}
    return model


def _log_density(c: dict, names: list[str]) -> Column:
    """Up to a constant: minus half the squared length of the whitened difference, and of the log determinant."""
    out = F.lit(float(np.log(c["prior"]) - 0.5 * c["logdet"]))
    for j, row in enumerate(c["inverse"]):
        z = sum((F.lit(row[i]) * (F.col(names[i]) - c["mean"][i]) for i in range(1, j + 1)), F.lit(row[0]) * (F.col(names[0]) - c["mean"][0]))
        out = out - 0.5 * z * z
    return out


def scored(stats: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, of being good) and predicted of every row of the statistics."""
    if not model["classes"]:
        score = F.lit(0.5)
    else:
        one, zero = (_log_density(model["classes"][y], model["names"]) for y in (1, 0))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), one - zero))))
    rows = stats.select("doc_id", score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT) -> DataFrame:
    """Fits on the labelled rows and scores all: repeated rows and null ids have a row each."""
    stats = saved(measured(docs))
    return scored(stats, fit(stats, labels, held_out))
