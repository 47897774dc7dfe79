"""Spelling variants of words: a join on their rarest bigrams.

All bigrams of the words are ordered by how many words hold them. A word gives its three rarest ones, each with its position. One
edit touches two bigrams of a word at most; of the bigrams that it leaves in place the rarest one is among the three of both words,
since two others can come before it at most. The edit then lies before or behind that shared bigram, so that the words agree from
it on or up to it, and of what is left on the other side one half agrees as well. These are the limits on positions: pairs join on
the shared bigram with the equal side and the equal half, and the distance is verified afterwards. No pair of near words is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import shuffled, stored, whole

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word that it stands for.
RATIO = 2
#: A run whose crc32 with its document's id this number divides loses a letter.
SLIP = 97
#: A word's bigrams that join: one more than an edit can touch.
RAREST = 3
#: A task hands out its partial counts when it holds so many words; Spark adds them up.
HELD = 300_000

#: Bytes of Latin-1: A-Z becomes a-z, other letters stay, the rest parts runs.
_RUN_BYTES = bytes(b if b >= 0xC0 or b < 0x80 and chr(b).isalpha() else 0x20 for b in range(256)).lower()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of the task its occurrences. A run is bytes of Latin-1, one for each code point; other letters part runs."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = text.encode("latin-1", "replace").translate(_RUN_BYTES).split()
            held.update(runs)
            start = crc32(f"{doc_id}:".encode())
            hashes = ((w, crc32(w if w.isascii() else w.decode("latin-1").encode(), start)) for w in set(runs))
            slips = [(w, h) for w, h in hashes if h % SLIP == 0]
            own = Counter(runs) if slips else {}
            for w, h in slips:
                k, n = h % len(w), own[w]
                held[w] -= n
                held[w[:k] + w[k + 1 :]] += n
            if len(held) >= HELD:
                yield out(Counter({w: n for w, n in held.items() if n and len(w) >= LEAST_CHARS}))
                held = Counter()
    yield out(Counter({w: n for w, n in held.items() if n and len(w) >= LEAST_CHARS}))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least LEAST_CHARS code points and LEAST_COUNT occurrences."""
    texts = docs.select(whole(F.col("doc_id").cast("string")).alias("doc_id"), whole(F.col("text")).alias("text"))
    return texts.mapInArrow(_partial_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, rarest first, by the words that hold it. The letters bound it: 90 of them give 8,100 bigrams at most,
    whatever the number of words."""
    grams = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()
    return {r.gram: k for k, r in enumerate(rows)}


def join_keys(word: str, at: int, shorter: int) -> Iterator[tuple]:
    """Of a word and the place of a rare bigram: the bigram with everything before it or from it on, the letters of the other word
    (this one's, or one less) left on the other side, and one half of those."""
    rest = len(word) - at - 2 - shorter
    if rest >= 0:
        half = rest // 2
        yield "up to", rest, word[: at + 2 + half], ""
        yield "up to", rest, word[: at + 2], word[len(word) - (rest - half) :]
    rest = at - shorter
    if rest >= 0:
        half = rest // 2
        yield "from", rest, word[:half], word[at:]
        yield "from", rest, "", word[at - (rest - half) :]


def keyed(words: DataFrame, order: dict[str, int], rarest: int = RAREST) -> DataFrame:
    """key, longer, word, n: the keys of each word, once for partners of its own length or one more, once (longer) for shorter ones.
    Keys are 64-bit hashes, whose collisions only add candidates."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, longer, word, n = [], [], [], []
            for w, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = sorted(range(len(w) - 1), key=lambda i: (order[w[i : i + 2]], i))[:rarest]
                for shorter in (0, 1):
                    own = {xxhash.xxh64_intdigest("\x00".join(map(str, k))) - (1 << 63) for i in places for k in join_keys(w, i, shorter)}
                    key += own
                    longer += [shorter == 1] * len(own)
                    word += [w] * len(own)
                    n += [count] * len(own)
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(longer, pa.bool_()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["key", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(keys, "key long, longer boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: each pair of words that differ by one inserted, deleted or replaced code point, once.

    A word has up to 24 rows of keys, but Spark sizes them as one, by the words' file."""
    rows = keyed(words, bigram_order(words))
    left = rows.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    once = F.when(F.col("longer"), F.length("a") < F.length("b")).otherwise((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    found = shuffled(left).join(right, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form (each with a form): the last word along the forms. Each step doubles the way that is covered; a
    form has RATIO times the occurrences of its word, so that a way is as long as the logarithm of the largest count at most."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        further = stored(shuffled(at).join(onward, "root", "left"))
        at = further.select("word", F.coalesce("__further", "root").alias("root"))
        if further.where("__further IS NOT NULL").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word. form is the near word of largest n (ties: the first in code-point
    order) if it occurs at least RATIO times as often, else null; root follows forms to the last, the word itself without one.

    Null texts have no words; a null id counts as the empty text. Rows with the same id and text are documents of their own: their
    runs count twice. An empty table gives no row. Other columns are not read."""
    words = stored(vocabulary(docs))
    pairs = near_pairs(words)
    way = lambda w, x, nx: F.struct(F.col(w).alias("word"), F.struct((-F.col(nx)).alias("minus"), F.col(x).alias("form")).alias("near"))
    best = pairs.select(F.inline(F.array(way("a", "b", "nb"), way("b", "a", "na")))).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    ok = -F.col("near.minus") >= RATIO * F.col("n")
    rows = shuffled(words).join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("near.form")).alias("form"), F.when(ok, -F.col("near.minus")).alias("form_n"))
    rows = stored(rows)
    return shuffled(rows).join(roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
