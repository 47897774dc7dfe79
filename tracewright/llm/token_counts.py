"""Token counts of texts, kept in a cache by digest.

The cache is a table of (version, digest, n_tokens) in shared storage: version is the digest of the tokenizer and of the library
that runs it, digest that of the normalised content. Texts whose digest is there are not encoded again; of the others each distinct
one is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import blooms
from tracewright.llm.common import bounded, saved, unused, whole

LIMIT = 1024
#: Characters that are handed to the tokenizer at once, and pieces whose counts a Python worker remembers.
BATCH_CHARS, HELD = 1 << 20, 400_000
_CACHE = "digest binary, n_tokens long, version string"

#: A byte-level tokenizer never joins what stands on both sides of a single blank between visible ASCII characters: the blank
#: begins a piece and whatever is before it ends one, special tokens hold no blank, and nothing is normalised.
_CUT = re.compile(r"(?<=[!-~])(?=\x20[!-~])")


class _JsonTokenizer:
    """Counts of a file of the tokenizers library, with its default handling of special strings, without added tokens, truncation
    or padding. In one Python worker the counts of pieces are remembered, up to HELD of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        own = self.tokenizer.pre_tokenizer
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.in_pieces = isinstance(own, pre_tokenizers.ByteLevel) and own.use_regex and not own.add_prefix_space and self.tokenizer.normalizer is None and not any(" " in s for s in specials)
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.in_pieces:
            return self.lengths(texts)
        cut, known = [_CUT.split(t) for t in texts], self.known
        new = list({p for pieces in cut for p in pieces}.difference(known))
        if len(known) + len(new) > HELD:
            known.clear()
            new = list({p for pieces in cut for p in pieces})
        known.update(zip(new, self.lengths(new), strict=True))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]


class _PieceModel:
    """Counts of a sentencepiece model, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> tuple[Callable[[list[str]], list[int]], str]:
    """A function that counts tokens, and the library that it uses; the file's ending tells which."""
    if path.endswith(".json"):
        return _JsonTokenizer(path), "tokenizers"
    if path.endswith(".model"):
        return _PieceModel(path), "sentencepiece"
    raise ValueError(f"no library for {path}")


def version_of(path: str) -> str:
    """Digest of the file's bytes with the library and its version: another of any of them is another version."""
    _, library = tokenizer(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {library_version(library)} ".encode() + f.read()).hexdigest()


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = tokenizer(path)[0]
    for batch in batches:
        texts, n, at = batch["text"].to_pylist(), [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            n += count(texts[at:end])
            at = end
        yield pa.record_batch([batch["digest"], pa.array(n, pa.int64())], names=["digest", "n_tokens"])


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one version; several appends may hold a digest, with the same count. None yet: an empty table."""
    try:
        rows = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def same(text: Column) -> Column:
    """The normal form of content for a tokenizer that tells all texts apart."""
    return text


def fill(docs: DataFrame, path: str, cache: str, normal: Callable[[Column], Column] = same) -> str:
    """Encodes the distinct texts of docs that the cache lacks and appends them; returns the version.

    With a filled cache the missing digests are found first, without texts, and keep the others out of the shuffle."""
    spark, version = docs.sparkSession, version_of(path)
    text = normal(whole(F.col("text")))
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    had = cached(spark, cache, version)
    if not had.isEmpty():
        missing = saved(texts.select("digest").distinct().join(had.select("digest"), "digest", "left_anti"))
        if missing.isEmpty():
            return version
        texts = blooms.listed_only(texts, missing, "digest")
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    new = distinct.mapInArrow(partial(_encoded, path=path), "digest binary, n_tokens long")
    new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    return version


def counted(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, normal: Callable[[Column], Column] = same) -> DataFrame:
    """docs with n_bytes (of the text in UTF-8), n_tokens and over_limit, whatever else a row holds; a null text is empty.

    cache is a folder in shared storage. normal must not change a text's count; only then may different texts share a digest.
    Columns of docs with the names of the new ones are replaced. Rows that repeat, or share an id, stay as they are."""
    version = fill(docs, path, cache, normal)
    counts = cached(docs.sparkSession, cache, version)
    key = unused(docs, "digest")
    rows = docs.drop("n_bytes", "n_tokens", "over_limit")
    kept = rows.columns
    keyed = rows.withColumns({"n_bytes": F.octet_length(whole(F.col("text"))).cast("long"), key: F.unhex(F.sha2(normal(whole(F.col("text"))), 256))})
    joined = keyed.join(bounded(counts.withColumnRenamed("digest", key)), key)
    return joined.select(*[F.col(f"`{c}`") for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
