"""Toxicity scores of deobfuscated text.

A noisy-channel decoder restores disguised tokens: the lattice of a token has, for each character, what it may stand for (itself,
a letter that it looks like, one or two of a run, nothing or the end of a word for a separator), and Viterbi picks the path that
a character bigram model of the corpus finds most likely. Restored tokens are scored by the words and stems that labelled
documents have shown to go with toxicity. Tokens are decoded in full, at any length.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fold, saved, stored, whole
from tracewright.llm.simhash import shingle_hashes

#: What characters may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "а": "a", "е": "e", "о": "o", "і": "i", "с": "c", "р": "p"}
SEPARATORS = " .-_*'~/\\:,;"
#: What is not seen and only parts letters.
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
TOKEN = re.compile(r"[\w@$!|+(€]+")
SPACED = re.compile(r"(?<![\w@$!|+])[\w@$!|+](?:[ .\-_*~/\\:,;]{1,2}[\w@$!|+]){2,}(?![\w@$!|+])")
PARTED = re.compile(r"(?<!\w)\w+(?:[.\-_*'~]{1,2}[\w@$!|+]+)+")
DISGUISED = re.compile(r"[\d@$!|+(€][^\W\d_]|[^\W\d_][\d@$!|+(€]+[^\W\d_]|(.)\1\1|(?:(.)\2(.)\3(.)\4)|vv|[^\W\d_][\d@$!|+(€]$|[аеоіср]")
PARTS = re.compile(r"\w[ .\-_*'~/\\:,;]+[\w@$!|+]")
LETTERS = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Labelled rows of each class that are used; entries of a worker's memory, and the longest token in it; the share of all pairs
#: of letters that a pair of the model has, which bounds them by its inverse.
SAMPLE_ROWS, MEMORY, REMEMBERED, PAIR_SHARE = 6_000, 500_000, 64, 1e-6
#: Of two texts of a label one is a copy if they share so much of their runs of three words; rounds that look for them, and
#: hashes that tell it.
COPY, COPY_ROUNDS, SKETCH = 0.5, 4, 128
#: The highest score where labels give no evidence; below that of a toxic text.
MOST_WITHOUT_EVIDENCE = 0.49
#: Toxic documents that a feature needs, at least and as a share of those in the sample, and its log ratio against
#: the others less so many standard errors.
MIN_TOXIC, MIN_TOXIC_SHARE, MIN_WEIGHT, CAUTION = 3, 0.002, 2.0, 1.5
HELD_OUT = 0


def features(word: str) -> list[str]:
    """The word itself and its stems of 4 to 9 letters."""
    return [f"={word}", *[word[:k] for k in range(4, min(10, len(word)))]]


def unaccented(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Decoder:
    """Viterbi over the lattice of a token; bigrams: log probability of a letter after another, both in lower case, with ^ and $
    for the beginning and end of a word."""

    def __init__(self, bigrams: dict[str, float]):
        self.bigrams, self.least = bigrams, min(bigrams.values(), default=-8.0) - 2
        self.costs: dict[tuple[str, str], tuple[float, str]] = {}

    def options(self, token: str) -> list[list[str]]:
        """What each run of a character may stand for; a blank is the end of a word."""
        lattice, k = [], 0
        while k < len(token):
            c, run = token[k], 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            letters = [*LOOKS_LIKE.get(c, ""), *([c] if c.isalpha() else [])]
            if c in SEPARATORS:
                lattice.append(["", " "])
            elif not letters:
                lattice.append([c])
            else:
                lattice.append([x * n for x in letters for n in ((1,) if run == 1 else (1, 2))] + ["w"] * (c == "v" and run == 2))
            k += run
        return lattice

    def cost(self, last: str, option: str) -> tuple[float, str]:
        """The log probability of an option after a letter, and the letter that it ends in."""
        if (last, option) not in self.costs:
            total, at = 0.0, last
            for c in option:
                total, at = total + self.bigrams.get(at + ("$" if c == " " else c), self.least), "^" if c == " " else c
            self.costs[last, option] = total, at
        return self.costs[last, option]

    def restore(self, token: str) -> str:
        """The most likely path: of those that end in each letter the best, with where it came from."""
        best, came = {"^": 0.0}, []
        for options in [*self.options(token), ["$"]]:
            now: dict[str, tuple[float, str, str]] = {}
            for last, score in best.items():
                for option in options:
                    more, at = self.cost(last, option)
                    if at not in now or (score + more, option) > (now[at][0], now[at][2]):
                        now[at] = (score + more, last, option)
            best = {at: x[0] for at, x in now.items()}
            came.append(now)
        out, at = [], max(best, key=lambda x: (best[x], x))
        for step in reversed(came):
            _, at, option = step[at]
            out.append(option)
        return "".join(reversed(out[1:]))


class Scorer:
    """Sums, over the distinct tokens of a text, the largest weight of each restored token's features."""

    def __init__(self, weights: dict[str, float], bigrams: dict[str, float]):
        self.weights, self.decoder, self.memory = weights, Decoder(bigrams), {}
        self.longest = max(map(len, weights), default=0)

    def restored(self, token: str) -> list[str]:
        """The words of the decoded token, and all of it as one; where single letters are parted, a word may begin at any of them."""
        if not (DISGUISED.search(token) or PARTS.search(token)):
            return []
        found = self.decoder.restore(token).split(" ")
        joined = "".join(found)
        found.append(joined)
        if SPACED.fullmatch(token):
            found += [joined[k : k + n] for k in range(len(joined)) for n in range(4, self.longest)] if len(joined) >= 4 else []
        return found

    def fresh(self, token: str) -> float:
        plain = LETTERS.sub("", token)
        return max(self.weights.get(f, 0.0) for w in {plain, unaccented(plain), *self.restored(token)} for f in features(w))

    def weight(self, token: str) -> float:
        if len(token) > REMEMBERED:
            return self.fresh(token)
        if token not in self.memory:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            self.memory[token] = self.fresh(token)
        return self.memory[token]

    def tokens(self, text: str) -> set[str]:
        low = UNSEEN.sub("", text.lower())
        found = set(TOKEN.findall(low))
        found.update(m.group() for m in SPACED.finditer(low))
        found.update(m.group() for m in PARTED.finditer(low))
        return found

    def raw(self, text: str) -> float:
        return sum(map(self.weight, self.tokens(text)))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: how often a letter follows another in the words of a batch, as two code points."""
    for batch in batches:
        for k in range(0, len(batch), 500):
            code = np.frombuffer(" ".join(["", *batch["text"].iloc[k : k + 500].str.lower(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            letters = np.array([c for c in np.flatnonzero(np.bincount(code)) if chr(c).isalpha()], np.int64)
            number, size = np.zeros(int(code.max()) + 1, np.int64), len(letters) + 1
            number[letters] = np.arange(1, size)
            both = number[code[:-1]] * size + number[code[1:]]
            pairs, n = np.unique(both, return_counts=True) if size > 1000 else (np.arange(size * size), np.bincount(both, minlength=size * size))
            pairs, n = pairs[(n > 0) & (pairs > 0)], n[(n > 0) & (pairs > 0)]
            letters = np.concatenate([[0], letters])
            yield pd.DataFrame({"a": letters[pairs // size], "b": letters[pairs % size], "n": n})


def letter_pairs(docs: DataFrame) -> dict[str, int]:
    """How often a letter follows another in words of all texts (^ begins a word, $ ends it), for pairs of enough of them."""
    counts = saved(docs.select(whole(F.col("text")).alias("text")).mapInPandas(_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return {(chr(r["a"]) if r["a"] else "^") + (chr(r["b"]) if r["b"] else "$"): r["n"] for r in counts.where(F.col("n") >= PAIR_SHARE * total).collect()}


def _gathered(known: frozenset[str] | None):
    """mapInPandas function. Per batch, by feature the documents and the toxic ones that have it: of whole words or, with the
    telling words known, of the stems of all other words."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, toxic = Counter(), Counter()
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                words = {LETTERS.sub("", token) for token in set(TOKEN.findall(text.lower()))}
                words = {w for w in words if w.isalpha()}
                if known is None:
                    own = {f"={w}" for w in words}
                else:
                    own = {f for w in words if f"={w}" not in known for f in features(w)[1:]}
                n.update(own)
                if label:
                    toxic.update(own)
            if n:
                yield pd.DataFrame({"key": list(n), "n": list(n.values()), "toxic": [toxic[k] for k in n]})

    return gather


def without_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, toxic) without copies of others of the same label, which are no evidence of their own. They are a
    sample of bounded size.

    A copy shares at least COPY of its runs of three words with a row that stays for it: of texts with up to SKETCH runs
    counted, of others told by the SKETCH least hashes of both. Each round brings together rows that agree in the least of their
    hashes under its own order, and holds each to the one of least id among them; what is not alike stays, however many rows
    share a line. Texts without a word are copies of one another. Rounds carry sketches, not texts."""
    own = rows.withColumn("__text", F.xxhash64("text"))
    runs = own.select("doc_id", "toxic", "__text", F.array_distinct(shingle_hashes(F.col("text"))).alias("__runs"))
    least_of = lambda k: F.array_min(F.transform("__runs", lambda h: F.xxhash64(h, F.lit(k))))
    kept = stored(runs.select("doc_id", "toxic", "__text", F.array(*map(least_of, range(COPY_ROUNDS))).alias("__turns"), F.slice(F.array_sort("__runs"), 1, SKETCH).alias("__sketch")).dropDuplicates(["doc_id", "toxic", "__text"]))
    for turn in range(COPY_ROUNDS):
        keyed = kept.withColumn("__least", F.get("__turns", F.lit(turn)))
        one = F.min(F.struct("doc_id", "__text", "__sketch")).alias("__one")
        of = keyed.groupBy(F.col("toxic").alias("__toxic"), F.col("__least").alias("__of")).agg(one)
        met = keyed.join(of, (F.col("toxic") == F.col("__toxic")) & F.col("__least").eqNullSafe(F.col("__of")))
        least = F.slice(F.array_sort(F.array_union("__sketch", "__one.__sketch")), 1, SKETCH)
        both = F.size(F.array_intersect(F.array_intersect("__sketch", "__one.__sketch"), least))
        alike = F.coalesce(F.try_divide(both, F.size(least)), F.lit(1.0)) >= COPY
        itself = F.col("doc_id").eqNullSafe(F.col("__one.doc_id")) & (F.col("__text") == F.col("__one.__text"))
        kept = met.where(itself | ~alike).select(*kept.columns)
    names = kept.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__label"), F.col("__text").alias("__of"))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("toxic") == F.col("__label")) & (F.col("__text") == F.col("__of"))
    return own.join(names, same, "left_semi").dropDuplicates(["doc_id", "toxic", "__text"]).drop("__text")


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Weights, slope and bias from at most sample_rows labelled rows of each class outside the held-out fold;
    bigrams from all documents.

    The rows are those with the least hash of doc_id, so that a rerun takes the same. A doc_id with several labels counts as
    toxic if one of them is. Without rows of both classes, so with an empty table of labels too, nothing tells toxic texts
    apart: no word has a weight, and every score is the share of toxic ones, but MOST_WITHOUT_EVIDENCE at most, so that
    no text is rejected."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        known = known.where(fold(F.col("doc_id")) != held_out)
    known = saved(known)
    all1, all0 = known.select(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    least = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for label in (0, 1)]
    chosen = saved(least[0].unionByName(least[1]))
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = stored(without_copies(rows).repartition(32))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        prior = min((all1 + 0.5) / (all0 + all1 + 1), MOST_WITHOUT_EVIDENCE)
        return {"weights": {}, "bigrams": {}, "slope": 1.0, "bias": math.log(prior / (1 - prior))}
    in_toxic, in_others = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    weight = F.log(in_toxic / (n1 + 1)) - F.log(in_others / (n0 + 1)) - CAUTION * F.sqrt(1 / in_toxic + 1 / in_others)

    def told(counts: DataFrame) -> dict[str, float]:
        # a few times the words of the sample at most, which is bounded
        rows = counts.where((F.col("toxic") >= max(MIN_TOXIC, MIN_TOXIC_SHARE * n1)) & (F.col("weight") >= MIN_WEIGHT))
        return {r["key"]: r["weight"] for r in rows.collect()}

    def gathered(words: frozenset[str] | None) -> DataFrame:
        rows = sample.select("text", "toxic").mapInPandas(_gathered(words), "key string, n long, toxic long")
        return saved(rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).withColumn("weight", weight))

    weights = told(gathered(None))
    # a stem that only stands for a telling word says nothing about other words that begin with it
    weights = told(gathered(frozenset(weights))) | weights
    seen, firsts = Counter(letter_pairs(docs)), Counter()
    share = max(1, sum(seen.values()) // 20_000)
    for key in weights:  # what the classifier knows is what disguises hide
        word = key.lstrip("=")
        for pair in map("".join, zip(f"^{word}", word + "$" * key.startswith("="))):
            seen[pair] += share
    for key, n in seen.items():
        firsts[key[0]] += n
    bigrams = {key: math.log(n / firsts[key[0]]) for key, n in seen.items()}
    rows = sample.select("doc_id", "toxic", _udf({"weights": weights, "bigrams": bigrams})("text").alias("raw")).select("toxic", "raw").toPandas()
    slope, bias = _platt(np.log1p(rows["raw"].to_numpy(float)), rows["toxic"].to_numpy(float), all1 / n1, all0 / n0)
    return {"weights": weights, "bigrams": bigrams, "slope": slope, "bias": bias}


def _platt(x: np.ndarray, y: np.ndarray, w1: float, w0: float) -> tuple[float, float]:
    """Slope and bias of a logistic curve, slightly regularised; a sampled row stands for w1 or w0 labelled ones."""
    w = np.where(y == 1, w1, w0)
    beta = np.array([0.5, -1.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + 1e-2 * beta
        hessian = (design * (w * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


_HELD: dict[str, Scorer] = {}


def _scorer(model: dict, key: str) -> Scorer:
    """The scorer of a Python worker, which keeps what it remembers from one task to the next; one model at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Scorer(model["weights"], model["bigrams"])
    return _HELD[key]


def _udf(model: dict):
    key = hashlib.sha256(repr((sorted(model["weights"].items()), sorted(model["bigrams"].items()))).encode()).hexdigest()
    scorer_of = partial(_scorer, {k: model[k] for k in ("weights", "bigrams")}, key)

    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of()
        for texts in batches:
            yield texts.map(scorer.raw).astype(float)

    return raw


def _probability(model: dict) -> Column:
    """A logistic curve over the logarithm of the sum: a few labels that are wrong about very toxic texts then don't bend it."""
    return 1 / (1 + F.exp(-(F.log1p(_udf(model)(whole(F.col("text")))) * model["slope"] + model["bias"])))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced. A null or empty text has
    the score of a text without any listed word; whole texts are read, of any length."""
    return docs.withColumn("score", _probability(model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """docs without those that are predicted to be toxic; the columns stay."""
    kept = docs.withColumn("__p", _probability(model))
    return kept.where(F.col("__p") < 0.5).select(*docs.columns)
