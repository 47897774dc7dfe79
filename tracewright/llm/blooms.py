"""Blocked Bloom filters in front of exact joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_BYTES, fits, indices, saved

#: A block is 8 words of 64 bits, and a key sets one bit in each; 16 bits a key give about 0.1 % false hits. A row of the filter
#: holds the words of so many blocks.
WORDS, WORD_BITS, BITS_PER_KEY, PAGE = 8, 64, 16, 32
#: With fewer bits a key the filter lets nearly everything pass, and the exact join goes without it.
LEAST_BITS_PER_KEY = 2


def _places(key: Column, n_blocks: int) -> tuple[Column, list[Column], list[Column]]:
    """Of a key: the page, the positions of its 8 words in the page, and the bit in each."""
    block, h = F.pmod(F.xxhash64(key), F.lit(n_blocks)), F.xxhash64(key, F.lit("bits"))
    at = [((block % PAGE) * WORDS + k).cast("int") for k in range(WORDS)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) for k in range(WORDS)]
    return F.floor(block / PAGE).cast("long"), at, bits


def bloom(keys: DataFrame, name: str, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int] | None:
    """The filter of a column of keys: rows of a page and its words, and the number of blocks. It takes at most most_bytes, with
    fewer bits a key for more keys; None where they would be too few."""
    n = keys.count()
    bits = min(BITS_PER_KEY, most_bytes * 8 / max(n, 1))
    if bits < LEAST_BITS_PER_KEY:
        return None
    n_blocks = max(1, math.ceil(n * bits / (WORDS * WORD_BITS)))
    page, at, bit = _places(F.col(name), n_blocks)
    each = keys.select(page.alias("__page"), F.explode(F.array(*[F.struct(a.alias("at"), b.alias("bit")) for a, b in zip(at, bit, strict=True)])).alias("x"))
    words = each.groupBy("__page", F.col("x.at").alias("at")).agg(F.bit_or("x.bit").alias("word"))
    own = words.groupBy("__page").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("of"))
    return own.select("__page", F.transform(indices(F.lit(PAGE * WORDS)), lambda k: F.coalesce(F.try_element_at("of", k), F.lit(0).cast("long"))).alias("__words")), n_blocks


def possible(rows: DataFrame, name: str, pages: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose column may be in the filter; none that is in it is lost. The filter's size is bounded by bloom()."""
    page, at, bits = _places(F.col(name), n_blocks)
    hit = F.lit(True)
    for a, b in zip(at, bits, strict=True):
        hit &= F.get("__words", a).bitwiseAND(b) != 0
    return rows.withColumn("__page", page).join(F.broadcast(pages), "__page").where(hit).select(*rows.columns)


def listed_only(rows: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """The rows whose column is in that of listed (saved). A short list is broadcast; before the join with a long one the filter
    of it keeps most other rows out of the shuffle."""
    keys = listed.select(name)
    if fits(keys):
        return rows.join(F.broadcast(keys), name, "left_semi")
    if (filtered := bloom(keys, name)) is not None:
        rows = possible(rows, name, saved(filtered[0]), filtered[1])
    return rows.join(keys, name, "left_semi")
