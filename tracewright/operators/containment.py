"""Which texts contain which strings, for any number of strings of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.storage import kept

#: Widths of blocks. A string of 2 w - 1 characters or more covers a whole block of every text that is cut into blocks of w.
WIDTHS = (16, 8, 4, 2, 1)


def _blocks(text: Column, width: int) -> Column:
    """The text's consecutive blocks of a width, without a shorter one at the end."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{width}}}"), F.lit(0))


def containing(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, normal=lambda c: c) -> DataFrame:
    """key and all columns of needles, for each text that contains the needle, after normal() of both.

    Texts are cut into blocks of a fixed width. Wherever a needle stands in a text, the text's blocks that it covers stand at one of
    the needle's `width` alignments; so each alignment of a needle asks for one of its blocks, the one in fewest texts, and none at all
    if a block of it is in no text. Widths go with the needles' length, and only needles' blocks are kept of a text. A common word,
    however long, is so never the key of a needle that holds anything rarer. What shares the block is then searched for the whole
    needle. Rows of texts with the same key and text are one text; a null or empty needle is contained nowhere, a null text contains
    nothing. Columns of needles must not be named as the key."""
    listed = needles.withColumn("__needle", normal(F.col(needle))).where("__needle <> ''")
    width = F.lit(None)
    for w in reversed(WIDTHS):
        width = F.when(F.length("__needle") >= 2 * w - 1, w).otherwise(width)
    listed = listed.withColumns({"__width": width, "__id": F.xxhash64("__needle")})
    found = listed.select("__needle", "__id", "__width").distinct()
    shifts = found.withColumn("__shift", F.explode(F.sequence(F.lit(0), F.col("__width") - 1)))
    rest = F.substring("__needle", F.col("__shift") + 1, F.length("__needle"))
    cut = F.lit(None).cast("array<string>")
    for w in WIDTHS:
        cut = F.when(F.col("__width") == w, _blocks(rest, w)).otherwise(cut)
    asked = kept(shifts.select("__id", "__width", "__shift", F.explode(F.array_distinct(cut)).alias("__block")))
    widths = [r[0] for r in asked.select("__width").distinct().collect()]  # five at most
    if not widths:
        return texts.select(key).join(needles, F.lit(False))
    rows = texts.select(F.col(key), normal(F.col(text)).alias("__text")).where(F.col("__text").isNotNull()).withColumn("__row", F.xxhash64(key, "__text"))
    of = lambda w: F.transform(F.array_distinct(_blocks(F.col("__text"), w)), lambda b: F.struct(F.lit(w).alias("__width"), b.alias("__block")))
    blocks = rows.select("__row", F.inline(F.concat(*map(of, widths))))
    met = kept(blocks.join(asked.select("__width", "__block").distinct(), ["__width", "__block"], "left_semi").distinct())
    counts = met.groupBy("__width", "__block").agg(F.count("*").alias("__n"))
    at = asked.join(counts, ["__width", "__block"], "left")
    rarest = at.groupBy("__id", "__shift").agg(F.min_by(F.struct("__width", "__block"), F.struct(F.coalesce("__n", F.lit(0)), "__block")).alias("x"), F.min(F.coalesce("__n", F.lit(0))).alias("__n"))
    keys = rarest.where("__n > 0").select("__id", "x.*").distinct()
    # only the numbers of rows and needles go together; the texts are read again for the candidates
    candidates = met.join(keys, ["__width", "__block"]).select("__row", "__id").distinct()
    pairs = rows.join(candidates, "__row").join(listed.drop("__width"), "__id").where(F.contains("__text", F.col("__needle")))
    return pairs.select(F.col(key), *needles.columns).distinct()


def leaks(texts: DataFrame, key: str, text: str, canaries: DataFrame, name: str, canary: str) -> DataFrame:
    """name, n_texts, leaked: of each canary the number of texts (by key) that hold it as it is. One without a text is not leaked, and
    what it stands for cannot be reached from there."""
    found = containing(texts, key, text, canaries.select(F.col(name).alias("__name"), F.col(canary).alias("__canary")), "__canary")
    counts = found.groupBy("__name").agg(F.countDistinct(key).alias("__n"))
    out = canaries.select(name).distinct().join(counts, F.col(name).eqNullSafe(F.col("__name")), "left")
    n = F.coalesce("__n", F.lit(0))
    return out.select(name, n.alias("n_texts"), (n > 0).alias("leaked"))
