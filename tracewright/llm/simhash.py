"""SimHash near-duplicates by vantage-point trees.

Two fingerprints of 64 bits that differ in at most 3 differ in at most 1 in one of their 32-bit halves. Each half is a metric
space of its own, so the search is run twice, for radius 1 on a half, and pairs are then held to the whole fingerprint. On a
half, a vantage-point tree cuts the points by their distance from a pivot; by the triangle bound, only points whose distance
is exactly one more than the cut can have a neighbour on the inner side, and those are sent there too as guests. From there
on a guest goes to every side where a neighbour may be at home, outwards too from a distance equal to the cut. So each pair
meets in the home leaf of one of the two. Points that share a half can't be cut by it: a leaf that holds too many is split
further on the other half, of whose bits three differ at most, so that of any four parts of it one is equal. (On whole fingerprints with radius 3 most points lie within the bound of any cut, and every level would copy most of them.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import ascii_lower, bound, bounded, indices, numbered, saved, words

SHINGLE, RADIUS, BITS = 3, 3, 64
#: Rows of the sample that the trees' pivots and cuts are fitted on, the fingerprints that a leaf should hold, and the block of a leaf that is compared at once.
SAMPLE_ROWS, LEAF_ROWS, BLOCK = 100_000, 4_000, 2_048
#: Times LEAF_ROWS from which on a leaf is split, and the ways, one after the other, of parting 32 bits in four: by masks.
TOO_MANY = 4
PARTS = [[0xFF << 8 * k for k in range(4)], [0x11111111 << k for k in range(4)], [0x03030303 << 2 * k for k in range(4)]]


def shingle_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of the shingles, repeats included: of the whole sequence where it is shorter, none for no words."""
    shingled = lambda w: F.transform(indices(F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)])))
    short = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return bound(words(ascii_lower(text)), lambda w: F.when(F.size(w) >= SHINGLE, shingled(w)).otherwise(short(w)))


def _majority(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = np.zeros(len(batch), np.uint64)
        for k, hashes in enumerate(batch["h"]):
            if len(hashes):
                bits = np.unpackbits(np.asarray(hashes, np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
                prints[k] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).view(">u8")[0]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": prints.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long): a bit is 1 if it is set in over half of the shingle hashes. Texts without words have 0."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text")).alias("h"))
    return hashed.mapInPandas(_majority, "doc_id long, fingerprint long")


def _grow(points: np.ndarray, rng: np.random.Generator, leaf: float, nodes: list) -> int:
    """A tree over the sample as rows (pivot, cut, inner, outer); a leaf is (0, -1, -1, -1). Returns the node's number."""
    me = len(nodes)
    nodes.append((0, -1, -1, -1))
    if len(points) > leaf:
        best = None
        for pivot in rng.choice(points, 5):
            d = np.bitwise_count(points ^ pivot)
            for cut in {int(np.median(d)), int(np.median(d)) - 1}:
                inner, edge = float(np.mean(d <= cut)), float(np.mean(d == cut + 1))
                cost = (inner + edge) ** 2 + (1 - inner) ** 2
                if 0 < inner < 1 and (best is None or cost < best[0]):
                    best = (cost, pivot, cut, d)
        if best and best[0] < 0.95:
            _, pivot, cut, d = best
            a = _grow(points[d <= cut], rng, leaf, nodes)
            b = _grow(points[d > cut], rng, leaf, nodes)
            nodes[me] = (int(pivot), cut, a, b)
    return me


def _fit(distinct: DataFrame, leaf_rows: int) -> list[np.ndarray]:
    """A tree for each half, from a bounded sample of the distinct fingerprints; it affects the sizes of leaves only."""
    n = distinct.count()
    rows = distinct.select("fingerprint").where(F.pmod(F.xxhash64("fingerprint"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).limit(SAMPLE_ROWS).toPandas()
    points, trees = np.sort(rows["fingerprint"].to_numpy(np.int64)).view(np.uint64), []
    for half in (0, 1):
        nodes: list = []
        own = np.unique((points >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
        _grow(own, np.random.default_rng(half), max(1.0, leaf_rows * len(own) / max(n, 1)), nodes)
        trees.append(np.array(nodes, np.int64))
    return trees


def _deal(trees: list[np.ndarray]):
    """mapInPandas function: a row for each leaf that a fingerprint lives in (home) or borders on (guest)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch["fingerprint"].to_numpy(np.int64)
            for half, nodes in enumerate(trees):
                part = (x.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
                while todo:
                    node, rows, home = todo.pop()
                    pivot, cut, inner, outer = nodes[node]
                    if not len(rows):
                        continue
                    if inner < 0:
                        yield pd.DataFrame({"leaf": np.int64(half << 32 | node), "half": np.int32(half), "fingerprint": x[rows], "home": home})
                        continue
                    d = np.bitwise_count(part[rows] ^ np.uint64(pivot))
                    # a guest must follow the homes it borders on, also outwards; of two homes one side is enough
                    inside, outside = d <= cut + 1, (d > cut) | (d == cut) & ~home
                    todo.append((inner, rows[inside], home[inside] & (d[inside] <= cut)))
                    todo.append((outer, rows[outside], home[outside]))

    return walk


def _within(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of left and right within the radius, block by block."""
    for i in range(0, len(left), BLOCK):
        near = np.bitwise_count(left[i : i + BLOCK, None] ^ right[None, :]) <= RADIUS
        a, b = np.nonzero(near)
        yield a + i, b


def _forest(home: np.ndarray, all_points: np.ndarray) -> np.ndarray:
    """Links home-any as a spanning forest: pairs (fingerprint, least fingerprint of its group in this leaf)."""
    parent = np.arange(len(all_points))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for j in range(0, len(all_points), BLOCK):
        for a, b in _within(home, all_points[j : j + BLOCK]):
            b = b + j
            off = a != b
            a, b = a[off], b[off]
            if not len(a):
                continue
            # one pass of hooking whole blocks, then single unions for what is left
            apart = parent[a] != parent[b]
            for p, q in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    roots = np.array([root(k) for k in range(len(all_points))])
    linked = roots != np.arange(len(all_points))
    return np.stack([all_points[linked], all_points[roots[linked]]], axis=1)


def _leaf_links(leaf: pd.DataFrame) -> pd.DataFrame:
    x = leaf.sort_values(["home", "fingerprint"], ascending=[False, True])
    points = x["fingerprint"].to_numpy(np.int64).view(np.uint64)
    links = _forest(points[: int(x["home"].sum())], points)
    return pd.DataFrame({"a": links[:, 0].astype(np.uint64).view(np.int64), "b": links[:, 1].astype(np.uint64).view(np.int64)})


def _split(dealt: DataFrame, masks: list[int], most: int) -> DataFrame:
    """dealt with each leaf of more than so many rows cut: a row goes to four new leaves, one for each part of its other half."""
    big = saved(dealt.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > most).select("leaf"))
    if big.isEmpty():
        return dealt
    other = F.when(F.col("half") == 0, F.shiftrightunsigned("fingerprint", 32)).otherwise(F.col("fingerprint").bitwiseAND(F.lit((1 << 32) - 1)))
    keys = F.array(*[F.xxhash64("leaf", F.lit(mask).cast("long"), other.bitwiseAND(F.lit(mask).cast("long"))) for mask in masks])
    cut = dealt.join(bounded(big), "leaf", "left_semi").select(F.explode(keys).alias("leaf"), "half", "fingerprint", "home")
    return dealt.join(bounded(big), "leaf", "left_anti").select(*dealt.columns).unionByName(cut)


def links(distinct: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints that connect exactly what their pairs within the radius connect.

    In a leaf only a spanning forest of the pairs is returned, so that a dense group of n near copies gives under n rows."""
    dealt = distinct.select("fingerprint").mapInPandas(_deal(_fit(distinct, leaf_rows)), "leaf long, half int, fingerprint long, home boolean")
    for masks in PARTS:
        dealt = _split(dealt, masks, TOO_MANY * leaf_rows)
    return dealt.groupBy("leaf").applyInPandas(_leaf_links, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the connected components of edges a, b by alternating large and small stars; the root is the least node.

    Each round is saved; it ends when no edge changes, which takes about the logarithm of the longest path."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = saved(small.where("u <> v").distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots(prints: DataFrame, leaf_rows: int) -> DataFrame:
    """fingerprint, least (of the doc_ids that have it), root (one fingerprint of its component) of each distinct fingerprint."""
    distinct = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    reach = saved(components(links(distinct, leaf_rows)))
    return distinct.join(reach, distinct["fingerprint"] == reach["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach) of every row.

    Null and empty texts have fingerprint zero and link like others. A null doc_id is never the id of a component unless all
    of its members are null; repeated rows are members of one component."""
    prints = saved(fingerprints(docs))
    member = _roots(prints, leaf_rows)
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id (null last), and of rows that share it the one with
    the least text. Rows are told apart by a number of their own, so that null or repeated ids join nothing. All columns stay."""
    rows = numbered(docs)
    prints = saved(fingerprints(rows.select(F.col("__row").alias("doc_id"), "text")))
    of = saved(prints.join(_roots(prints, leaf_rows).drop("least"), "fingerprint").select(F.col("doc_id").alias("__row"), F.col("root").alias("__root")))
    several = of.groupBy("__root").agg(F.count("*").alias("n")).where("n > 1").select("__root")
    shared = saved(of.join(several, "__root"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.col("__row"))
    first = rows.join(bounded(shared), "__row").groupBy("__root").agg(F.min_by("__row", rank).alias("__row"))
    lost = saved(shared.join(first.select("__row"), "__row", "left_anti").select("__row"))
    return rows.join(bounded(lost), "__row", "left_anti").select(*docs.columns)
