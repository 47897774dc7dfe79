"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores the measurements and one
bit per failed rule; a policy is a versioned mask over those bits, so that policies are
applied, compared and ablated without reading a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import BLANK, indices, whole, words

SYMBOLS = "#*$%&|<>"

#: Bit number, rule, failure condition over the measurements.
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 30 * n_words"),
    (3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 14 * n_words"),
    (6, "shouting", "100 * n_upper > 50 * word_chars"),
]
BASE_MASK = 0b11
#: Policies by version: the rules that reject a document.
POLICIES: dict[str, int] = {"base": BASE_MASK, "v1": 0b1111111, "v2-lenient": 0b1000111}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the measurements. Windows of three words are compared by a 64-bit chained hash of the words and sorted
    within the row, so that no text is shuffled."""
    text = whole(F.col("text"))
    base = docs.select(*keep, words(F.col("text")).alias("__w"), F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "")) != "").alias("__l"), text.alias("__t"))
    bare = F.regexp_replace(F.col("__t"), BLANK, "")
    base = base.select(
        *keep,
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count(F.col("__t"), F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    w = F.col("__w")
    windows = F.transform(indices(F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    base = base.withColumn("__s", F.sort_array(windows)).drop("__w")
    s = F.col("__s")
    same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    found = F.flatten(F.transform(F.filter(s, same), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    return base.withColumn("n_repeat_words", F.size(F.array_distinct(found)).cast("long")).drop("__s")


def failed_bits(rules: list[tuple[int, str, str]] = RULES) -> Column:
    """One long whose bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for bit, _, failure in rules:
        bits = bits.bitwiseOR(F.when(F.expr(failure), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """doc_id, the measurements and failed_bits, one row per input row (repeated rows and null ids stay as they are).

    A null or empty text has no words and no lines: every measurement is 0. Other columns of docs are not read."""
    return _measured(docs, ["doc_id"]).withColumn("failed_bits", failed_bits(rules))


def apply_policy(ledger_rows: DataFrame, version: str) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return ledger_rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def compared(ledger_rows: DataFrame, versions: list[str]) -> DataFrame:
    """version, n, n_kept, words_kept of each policy; the ledger is counted by its bits once, at most 2 ** rules rows."""
    counts = ledger_rows.groupBy("failed_bits").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    policy = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(POLICIES[v]).cast("long").alias("mask")) for v in versions])).alias("p")
    kept = F.col("failed_bits").bitwiseAND(F.col("p.mask")) == 0
    sums = [F.sum("n").alias("n"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept"), F.sum(F.when(kept, F.col("words")).otherwise(0)).alias("words_kept")]
    return counts.select("*", policy).groupBy(F.col("p.version").alias("version")).agg(*sums)


def ablation(ledger_rows: DataFrame, version: str, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    The ledger is first counted by its masked bits, at most 2 ** rules rows; the rest is arithmetic on those."""
    mask = POLICIES[version]
    counts = ledger_rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in rules if mask >> bit & 1])).alias("r")
    return counts.select("bits", "n", rule).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
