"""Language-model scores by a probabilistic suffix tree over characters.

A text is its lower-cased words, a blank after each, and one end. A state is a context of up to `depth` of these symbols. A
context is a state if its next-symbol distribution diverges from that of its longest suffix that is one, by enough nats over
all its occurrences; the root always is. A state's distribution is its discounted counts and, for the weight they leave, its
suffix's distribution, down to all symbols alike. A symbol is scored by the longest state that its context ends in.

Counts are of all training texts from one occurrence on, so that the tree grows with the corpus. Runs of depth + 1 symbols are
counted once; those of shorter contexts are their sums. The tree is a table with a row for each such run that any text has, its
value is found by joins from the root on, and a text's score is the sum of its runs' values. No part that grows is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import bounded, fold, saved, stored, whole

DEPTH, DISCOUNT = 5, 0.7
#: Nats by which all occurrences of a context must gain over its suffix for it to become a state.
MIN_GAIN = 10.0
#: Share of all training tokens, or symbols, from which on a word or run is looked up by the workers and not by the join. It
#: bounds each of their two tables by its inverse, 160 MB, and keeps common keys out of the join; no score depends on it.
COMMON = 1e-7
HELD_OUT = 1
#: Bytes of text that a worker takes at once, one text at least; it bounds the worker's memory.
PIECE = 1 << 22
#: A symbol is its code point and 1, so that 0 is none; END closes a text, START fills the contexts of its first symbols.
BLANK, END, START, ALPHABET = 33, 0x110001, 0x110002, 0x110001
#: Symbols of 21 bits in a column of 63.
BITS, IN_COLUMN = 21, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(*columns: np.ndarray) -> np.ndarray:
    """One hash of 64 bits for the columns of a run."""
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = _mixed(out + x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


class Piece:
    """Some texts of a batch: their words' hashes and their symbols, each with the number of its text."""

    def __init__(self, texts: list[str], depth: int):
        joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
        at = np.flatnonzero((joined != 32) & ((joined < 9) | (joined > 13)))
        code, text = joined[at].astype(np.int32), text[at]
        code[(code >= 65) & (code <= 90)] += 32
        begins = np.ones(len(code), bool)
        begins[1:] = (np.diff(at) > 1) | (np.diff(text) > 0)
        first, word = np.flatnonzero(begins), np.cumsum(begins) - 1
        self.text_of_word = text[first]
        own = _mixed(((np.arange(len(code)) - first[word]) << BITS | code).astype(np.uint64) + np.uint64(1))
        self.words = _mixed(np.add.reduceat(own, first) if len(code) else own).view(np.int64)
        # per text: START depth times, the words with a blank after each, END
        sizes = np.bincount(text, minlength=len(texts)) + np.bincount(self.text_of_word, minlength=len(texts)) + 1
        new = np.arange(len(code)) + word + (depth + 1) * text.astype(np.int64) + depth
        self.symbols = np.full(int(sizes.sum()) + depth * len(texts), START, np.int32)
        self.symbols[new], self.symbols[new[np.r_[first[1:], len(code)][: len(first)] - 1] + 1] = code + 1, BLANK
        self.symbols[np.cumsum(sizes + depth) - 1] = END
        self.text, self.depth = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), depth

    def runs(self) -> list[np.ndarray]:
        """The columns of each symbol of the texts with its context, the earliest symbols in the first."""
        n, d, size = _columns(self.depth), self.depth, len(self.symbols)
        own, out = self.symbols[d:] != START, []
        for c in range(n):
            packed = np.zeros(size - d, np.int64)
            for back in range(min((n - c) * IN_COLUMN - 1, d), (n - c - 1) * IN_COLUMN - 1, -1):
                packed <<= BITS
                packed |= self.symbols[d - back : size - back]
            out.append(packed[own])
        return out


def _columns(depth: int) -> int:
    return -(-(depth + 1) // IN_COLUMN)


def _names(depth: int) -> list[str]:
    return [f"g{k}" for k in range(_columns(depth))]


def _pieces(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """The batches, cut between texts."""
    for batch in batches:
        ends, first = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            upto = max(first + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
            part = batch.slice(first, upto - first)
            yield part, Piece(part.column("text").to_pylist(), depth)
            first = upto


def _counted(depth: int):
    """mapInArrow function: by run (g0, ...) and by word (its hash as g0, the others -1) the occurrences in training texts; what
    only other texts have comes with 0."""

    def rows(columns: list[np.ndarray], keys: np.ndarray, training: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        times = np.add.reduceat(training[order].astype(np.int64), at) if len(at) else at.astype(np.int64)
        return pa.RecordBatch.from_arrays([*[pa.array(x[order[at]]) for x in columns], pa.array(times)], names=[*_names(depth), "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, piece in _pieces(batches, depth):
            training = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            runs = piece.runs()
            yield rows(runs, _key(*runs), training[piece.text])
            none = np.full(len(piece.words), -1, np.int64)
            yield rows([piece.words] + [none] * (_columns(depth) - 1), piece.words, training[piece.text_of_word])

    return count


def _without_first(length: int, depth: int) -> list[Column]:
    """The columns of a run of so many symbols, less its first."""
    back, place = divmod(length - 1, IN_COLUMN)
    first = _names(depth)[-1 - back]
    return [F.col(g).bitwiseAND(F.lit((1 << BITS * place) - 1)).alias(g) if g == first else F.col(g) for g in _names(depth)]


def values(runs: DataFrame, depth: int = DEPTH, min_gain: float = MIN_GAIN) -> DataFrame:
    """runs (g0, ..., n: training occurrences of each run of depth + 1 symbols) with e, the log probability of the last symbol
    after the others."""
    names, n = _names(depth), F.col("n")
    levels = [runs.select(*names, "n")]
    for length in range(depth + 1, 1, -1):
        levels.append(saved(levels[-1].select(*_without_first(length, depth), "n").groupBy(names).agg(F.sum("n").alias("n"))))
    by = W.partitionBy(*names[:-1], F.shiftright(names[-1], BITS))
    out = None
    for length, level in enumerate(reversed(levels), 1):
        level = level.withColumns({"total": F.sum("n").over(by), "kinds": F.sum((n > 0).cast("long")).over(by)})
        if out is None:
            level = level.withColumn("under", F.lit(-math.log(ALPHABET)))
        else:
            up = saved(out).select(*[F.col(k).alias(f"_{k}") for k in names], F.col("e").alias("under"))
            suffix = [c.alias(f"_{k}") for k, c in zip(names, _without_first(length, depth), strict=True)]
            level = level.select("*", *suffix).join(bounded(up), [f"_{k}" for k in names])
        p = F.log((F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.exp("under")) / F.col("total"))
        level = level.withColumn("p", F.when(F.col("total") > 0, p))
        gain = F.sum(F.when(n > 0, n * (F.col("p") - F.col("under"))).otherwise(0.0)).over(by)
        level = level.withColumn("state", F.col("p").isNotNull() & (F.lit(length == 1) | (gain >= min_gain)))
        out = level.select(*names, "n", F.when(F.col("state"), F.col("p")).otherwise(F.col("under")).alias("e"))
    return out


class Tree(NamedTuple):
    """Numbers of training tokens, distinct ones, ends and symbols; words (key, n) and runs (key, n, value: log10)."""

    tokens: int
    kinds: int
    ends: int
    symbols: int
    words: DataFrame
    runs: DataFrame

    def unigram(self, n: Column) -> Column:
        return F.log10((n + 0.5) / F.lit(self.tokens + 0.5 * (self.kinds + 1)))


def train(rows: DataFrame, depth: int = DEPTH, min_gain: float = MIN_GAIN) -> Tree:
    """The tree of rows (text, held_out), with a row for each word of training texts and for each run of any text."""
    if depth < IN_COLUMN:
        raise ValueError(f"depth must be {IN_COLUMN} at least")
    names = _names(depth)
    counts = rows.select("text", "held_out").mapInArrow(_counted(depth), ", ".join(f"{x} long" for x in [*names, "n"]))
    counts = stored(counts.groupBy(names).agg(F.sum("n").alias("n")))
    is_word = F.col("g1") == -1
    ends = rows.where(~F.col("held_out")).count()
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (is_word, ~is_word)]
    of_words, of_runs, kinds = counts.agg(*sums, F.count_if(is_word & (F.col("n") > 0))).first()
    runs = values(counts.where(~is_word), depth, min_gain).select(_keyed(*names), "n", (F.col("e") / math.log(10)).alias("value"))
    return Tree(of_words + ends, kinds + (ends > 0), ends, of_runs, counts.where(is_word & (F.col("n") > 0)).select(F.col("g0").alias("key"), "n"), stored(runs))


def _keyed(*names: str) -> Column:
    @F.arrow_udf("long")
    def key(*parts: pa.Array) -> pa.Array:
        return pa.array(_key(*[x.to_numpy(zero_copy_only=False) for x in parts]))

    return key(*names).alias("key")


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The position of each x in sorted keys, -1 where it is not."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def _score(shared, depth: int):
    """mapInArrow function: per text a row with a struct, the sums of what is common in it; and a row (row, key) for each of
    its other words and runs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, piece in _pieces(batches, depth):
            size, row = batch.num_rows, batch.column("row").to_numpy(zero_copy_only=False)
            sums, left = [], []
            for of, keys, (listed, table) in ((piece.text_of_word, piece.words, shared.value[0]), (piece.text, _key(*piece.runs()), shared.value[1])):
                at = _find(listed, keys)
                on = at >= 0
                sums.append(np.bincount(of[on], table[at[on]], size).astype(float))
                left.append((of[~on], keys[~on]))
            n_words, unlisted = np.bincount(piece.text_of_word, minlength=size), np.bincount(left[0][0], minlength=size)
            parts = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (n_words, unlisted, *sums))]
            own = pa.StructArray.from_arrays(parts, names=["doc_id", "held_out", "n_words", "n_unlisted", "base", "value"])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(row), own], names=["row", "key", "own"])
            for of, keys in left:
                yield pa.RecordBatch.from_arrays([pa.array(row[of]), pa.array(keys), pa.nulls(len(keys), own.type)], names=["row", "key", "own"])

    return score


def scored(docs: DataFrame, held_out: int = HELD_OUT, depth: int = DEPTH, min_gain: float = MIN_GAIN, common: float = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Trained on all rows outside the held-out fold. Null and empty texts are their end alone; repeated rows have a row each;
    with no training text every word is unknown and all symbols are alike. Only doc_id and text are read."""
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), whole(F.col("text")).alias("text"))
    tree = train(rows, depth, min_gain)
    n, key = F.col("n"), F.col("key")
    words = tree.words.select(key, n, F.lit(True).alias("word"), tree.unigram(n).alias("value"))
    runs = tree.runs.select(key, n, F.lit(False).alias("word"), "value")
    tables, rest = [], []
    for table, total in ((words, tree.tokens), (runs, tree.symbols)):
        is_common = n >= max(1.0, common * total)
        listed = table.where(is_common).select("key", "value").toArrow().sort_by("key")
        tables.append(tuple(listed[c].to_numpy() for c in ("key", "value")))
        rest.append(table.where(~is_common).select("key", "word", "value"))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, key long, own struct<doc_id: {kind}, held_out: boolean, n_words: long, n_unlisted: long, base: double, value: double>"
    parts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(shared, depth), schema)
    found = parts.join(rest[0].unionByName(rest[1]), "key", "left").where("own IS NOT NULL OR word IS NOT NULL")
    of = lambda c, value: F.coalesce(F.sum(F.when(F.col("own").isNull() & c, value)), F.lit(0))
    own = lambda name: F.max(F.col("own")[name]).alias(name)
    sums = [of(F.col("word"), F.lit(1)).alias("known"), of(F.col("word"), F.col("value")).alias("more_base"), of(~F.col("word"), F.col("value")).alias("more_value")]
    out = found.groupBy("row").agg(*map(own, ("doc_id", "held_out", "n_words", "n_unlisted", "base", "value")), *sums)
    unknown = F.col("n_unlisted") - F.col("known")
    base = F.col("base") + F.col("more_base") + unknown * tree.unigram(F.lit(0)) + tree.unigram(F.lit(tree.ends))
    n_known = F.col("n_words") - unknown + int(tree.ends > 0)
    return out.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), n_known.cast("long").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("value") + F.col("more_value")).alias("score"))
