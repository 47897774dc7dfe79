"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.blooms import bloom, possible
from tracewright.llm.common import ascii_lower, bounded, saved, whole

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #. Both are empty for a
    null url and for one without ://."""
    part = lambda k: F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return ascii_lower(part(1)), part(2)


def canonical(listed: DataFrame) -> DataFrame:
    """listed: host, path, verdict. Adds labels (of the host), path_len and the key; rows without a host are no rules."""
    rows = listed.select(ascii_lower(F.col("host")).alias("host"), whole(F.col("path")).alias("path"), "verdict").where(F.col("host") != "")
    rows = rows.withColumns({"labels": F.size(F.split("host", r"\.")), "path_len": F.length("path"), "key": F.concat("host", F.lit("\n"), "path")})
    return rows.groupBy("key", "host", "path", "labels", "path_len").agg(F.min("verdict").alias("verdict"))


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A listed entry fits its host and all subdomains, and paths that start with its own; the longest that fits decides (by
    host and path together, then by host). A url's keys are its host suffixes with its path prefixes, of the numbers of labels
    and for each of those the lengths of path that the list has; a url has no more of them than characters of its path for
    each suffix. Keys that pass the Bloom filter are joined with the list by the exact key. Distinct urls are judged once, so
    that a url with many pages counts once; pages without a fitting entry, null urls and urls without :// get no rule and the
    default verdict. A key listed twice counts once (allow before block). Repeated pages keep a row each, columns of pages
    other than page_id and url are not read."""
    rules = saved(canonical(listed))
    # at most 127 numbers of labels, and for each as many lengths as a path has characters
    shapes = rules.groupBy("labels").agg(F.sort_array(F.collect_set("path_len")).alias("lengths")).collect()
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = parts.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one")
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.size(F.split("host", r"\."))
    prefixes = lambda suffix, lengths: F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda m: m <= F.length("path")), lambda m: F.concat(suffix, F.lit("\n"), F.substring("path", F.lit(1), m)))
    of = [F.when(labels >= r.labels, prefixes(F.substring_index("host", ".", -r.labels), r.lengths)).otherwise(F.array().cast("array<string>")) for r in shapes]
    hits = urls.select("host", "path", F.explode(F.concat(*of)).alias("key"))
    if (filtered := bloom(rules, "key")) is not None:
        hits = possible(hits, "key", saved(filtered[0]), filtered[1])
    exact = rules.select("key", F.length("key").alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict")
    found = hits.join(bounded(exact), "key")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("length", "host_length")).alias("best"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
