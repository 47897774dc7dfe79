"""Sinks of events: JSON lines, an enveloped file, a file for each session, and a log of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_time(ts: Column) -> Column:
    """YYYYMMDD_HHMMSS in the session's time zone, which should be UTC."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def time_of_file(name: Column) -> Column:
    """The time in adr.<session>.<YYYYMMDD_HHMMSS>.json; null for other names and impossible times."""
    digits = F.regexp_extract(name, r"(?s)\Aadr\..*\.([0-9]{8}_[0-9]{6})\.json\z", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def pruned(rows: DataFrame) -> Column:
    """A row as JSON without nulls, blank strings and empty maps; strings lose the blanks at their ends, empty lists stay."""

    def field(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "string":
            c = F.nullif(F.regexp_replace(c, r"\A\s+|\s+\z", ""), F.lit(""))
        elif kind.startswith("map"):
            c = F.when(F.size(c) > 0, c)
        return c.alias(name)

    return F.to_json(F.struct(*[field(n, k) for n, k in rows.dtypes]))


def content_hash(source: Column, session: Column, history: Column) -> Column:
    """sha256 over source, session and messages as JSON with keys in order of their names; equal contents have equal hashes."""
    return F.sha2(F.to_json(F.struct(history.alias("chat_history"), session.alias("session_id"), source.alias("source"))), 256)


def config_uuid(*parts: Column, user: Column, at: int = 1) -> Column:
    """sha256 over the parts of a configuration joined by bars, the user (or unknown_user) at the given place."""
    fields = [p.cast("string") for p in parts]
    fields.insert(at, F.coalesce(user, F.lit("unknown_user")))
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in fields]), 256)


def write_lines(rows: DataFrame, path: str) -> None:
    """One pruned JSON object a line, in as many files as there are partitions."""
    rows.select(pruned(rows).alias("value")).write.mode("errorifexists").text(path)


def envelope(rows: DataFrame, now: Column) -> DataFrame:
    """ord, value: the lines of one JSON object with timestamp, total_entries and entries, a line for each entry. The entries
    are not gathered in a row; what reads the file should take the lines in order of ord, each entry but the last has a comma."""
    numbered = rows.select(pruned(rows).alias("entry"), F.monotonically_increasing_id().alias("k"))
    last = numbered.agg(F.max("k").alias("last"), F.count("*").alias("n"))
    head = last.select(F.lit(-1).cast("long").alias("ord"), F.concat(F.lit('{"timestamp":"'), now.cast("string"), F.lit('","total_entries":'), F.col("n").cast("string"), F.lit(',"entries":[')).alias("value"))
    body = numbered.join(F.broadcast(last), F.lit(True)).select(F.col("k").alias("ord"), F.concat("entry", F.when(F.col("k") < F.col("last"), ",").otherwise("")).alias("value"))
    tail = rows.sparkSession.createDataFrame([((1 << 63) - 1, "]}")], "ord long, value string")
    return head.unionByName(body).unionByName(tail)


def write_sessions(rows: DataFrame, path: str, name: str = "file") -> None:
    """A folder for each session's name (adr.<session>.<time>), which holds its pruned JSON; rows without a name stay out."""
    plain = rows.drop(name)
    named = rows.where(F.col(name).isNotNull()).select(F.col(name), pruned(plain).alias("value"))
    named.repartition(name).write.partitionBy(name).mode("append").text(path)


def dead_letters(rows: DataFrame, raw: str, source: str) -> DataFrame:
    """value: a JSON line (source, error, raw) for each row whose raw text is no JSON; a null text counts as such."""
    bad = rows.where(F.try_parse_json(raw).isNull())
    return bad.select(F.to_json(F.struct(F.col(source).alias("source"), F.lit("not JSON").alias("error"), F.substring(raw, 1, 1000).alias("raw"))).alias("value"))


def recent_files(files: DataFrame, days: int, now: Column) -> DataFrame:
    """The rows of a file source whose file changed within so many days; Spark prunes files by their metadata."""
    return files.where(F.col("_metadata.file_modification_time") >= now - F.make_dt_interval(F.lit(days)))
