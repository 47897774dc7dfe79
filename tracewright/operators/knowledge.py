"""Search in tables of policies, tactics and servers, and rules over names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_categories(rows: DataFrame, category: str, wanted: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """The rows of the wanted categories, all rows where none are named; not exact: in any case of the letters."""
    if not wanted:
        return rows
    return rows.where(F.col(category).isin(*wanted) if exact else F.lower(category).isin(*[w.lower() for w in wanted]))


def any_keyword(rows: DataFrame, fields: tuple[str, ...], keywords: tuple[str, ...]) -> DataFrame:
    """Each row once whose fields, joined by blanks, contain one of the keywords in any case; none for no keywords."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    return rows.where(reduce(or_, [F.contains(text, F.lit(k.lower())) for k in keywords], F.lit(False)))


def looked_up(wanted: DataFrame, name: str, known: DataFrame, key: str) -> DataFrame:
    """wanted with the known row of its name, or of the name with underscores for hyphens; status is found or not_found, and
    available lists the known keys beside a name that is not found. known is a list of one row per key, such as servers."""
    listed = known.agg(F.sort_array(F.collect_set(key)).alias("__all"))
    exact = known.select(F.col(key).alias("__k"), F.struct(*known.columns).alias("__exact"))
    plain = known.select(F.col(key).alias("__p"), F.struct(*known.columns).alias("__plain"))
    rows = wanted.join(exact, F.col(name) == F.col("__k"), "left").join(plain, F.replace(F.col(name), F.lit("-"), F.lit("_")) == F.col("__p"), "left")
    hit = F.coalesce("__exact", "__plain")
    rows = rows.join(F.broadcast(listed), F.lit(True)).withColumn("__hit", hit)
    status = F.when(F.col("__hit").isNotNull(), "found").otherwise("not_found")
    return rows.select(*wanted.columns, F.col("__hit").alias("match"), status.alias("status"), F.when(F.col("__hit").isNull(), F.col("__all")).alias("available"))


def risk_map(rows: DataFrame, category: str, name: str) -> DataFrame:
    """category (null: uncategorized), names in order, n."""
    return rows.groupBy(F.coalesce(F.col(category), F.lit("uncategorized")).alias("category")).agg(F.sort_array(F.collect_list(name)).alias("names"), F.count("*").alias("n"))


def glob(value: Column, pattern: str) -> Column:
    """Whether value is of the pattern: * any run, ? any character, [..] one of, [!..] none of; all else stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        end = pattern.find("]", i + 2) if pattern[i] == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner.replace("^", "\\^")) + "]", end
        else:
            out += {"*": ".*", "?": "."}.get(pattern[i], pattern[i] if pattern[i].isalnum() else "\\" + pattern[i])
        i += 1
    return value.rlike(f"(?s)\\A{out}\\z")


def principal(attributes: Column, trusted: tuple[str, ...], untrusted: tuple[str, ...]) -> Column:
    """Trusted if all attributes of a list joined by ; are, Transparent if the rest is named so, else Untrusted. An attribute is
    trusted by a pattern of the first list unless one of the second fits too."""

    def one(a: Column) -> Column:
        fits = lambda patterns: reduce(or_, [glob(a, p) for p in patterns], F.lit(False))
        return F.when(a == "Transparent", "Transparent").when(fits(trusted) & ~fits(untrusted), "Trusted").otherwise("Untrusted")

    each = F.transform(F.split(attributes, ";"), one)
    least = lambda names: F.forall(each, lambda p: p.isin(*names))
    return F.when(least(("Trusted",)), "Trusted").when(least(("Trusted", "Transparent")), "Transparent").otherwise("Untrusted")


def in_ranges(rows: DataFrame, key: str, ranges: str) -> DataFrame:
    """The rows whose key is in a list like 1,3-5,7 (ends included); an empty list keeps all."""
    if not ranges:
        return rows
    ends = [[int(x) for x in part.split("-")] for part in ranges.split(",")]
    return rows.where(reduce(or_, [F.col(key).between(e[0], e[-1]) for e in ends]))


def scanned(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, line (from 1), kind, n_found: how often each named pattern is found in each line of a text, in any case."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "__line"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("__line", F.lit(f"(?i){p}")).alias("n_found")) for k, p in patterns.items()])
    return lines.select(key, (F.col("line") + 1).alias("line"), F.inline(found)).where("n_found > 0")


def data_injection(runs: DataFrame, first: str, second: str, warnings: str, value: str) -> Column:
    """Whether an injected value got through: no warning of the second run contains it, and the runs (struct of calls and
    answer) differ."""
    warned = F.exists(F.coalesce(F.col(warnings), F.array().cast("array<string>")), lambda w: F.contains(w, F.col(value)))
    return ~F.coalesce(warned, F.lit(False)) & ~F.col(first).eqNullSafe(F.col(second))
