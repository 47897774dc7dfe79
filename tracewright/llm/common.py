"""Column helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a build side up to which it is broadcast; beyond them Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words between ASCII blanks; an empty array for null or blank text."""
    return F.array_remove(F.split(whole(text), BLANK), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only, so that offsets and bytes of other letters stay."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda function Spark computes an expression again for each element, but
    not a lambda variable."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def indices(n: Column) -> Column:
    """0..n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"__{name}").lower() in taken:
        pass
    return name


def _octets(df: DataFrame, name: str) -> Column:
    """About the bytes of a column in a row: of nested ones as JSON, of others 8 or their own length."""
    kind, value = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 16
    return F.lit(8)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of df have at most so many bytes; df should be saved or cheap."""
    each = sum((_octets(df, name) for name in df.columns), F.lit(8))
    return (df.agg(F.sum(each.cast("long")).alias("n")).first()["n"] or 0) <= most


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast after measuring that it fits."""
    return F.broadcast(df) if fits(df, most) else df


def shuffled(df: DataFrame) -> DataFrame:
    """Marks df for joins that shuffle and sort both sides. Without the mark Spark may broadcast a side whose size it takes from a
    compressed file, or from what a task or an explode was given instead of what it makes."""
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in spark.checkpoint.dir. Only a local session, whose
    executors are in the driver, may go without; then it is a new temporary one."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (sc.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = named or tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage as saved() does, by a table of Parquet in the shared folder, which takes less room for many rows."""
    df.write.parquet(out := f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(out)


def numbered(df: DataFrame) -> DataFrame:
    """df with __row, a number of each row; saved, so that every use of it sees the same numbers."""
    return saved(df.withColumn("__row", F.monotonically_increasing_id()))
