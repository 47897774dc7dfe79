"""Source divergence, token counts and spelling variants against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tracewright.llm import divergence, spelling, token_counts
from tracewright.llm import queries as registered

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = {k: k + 32 for k in range(65, 91)}


# Source divergence


def plain_audit(rows, least_docs=3, top=200):
    """rows: (lang, source, text); every pair over the full table of counts."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((r[0] or "", r[1] or "", r[2] or "") for r in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups.add((lang, source))
        n[lang, source].update(terms)
        n[lang, None].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in df[lang].items() if d >= least_docs]
        share = lambda g: {t: 1 + 10**9 * (n[lang, g][t] + 1) // (sum(n[lang, g][x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = share(source)
        pairs = [(other, q) for la, other in groups if la == lang and other != source for q in [share(other)]]
        pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other) for other, q in pairs]
        q = share(None)
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def audit(docs, **more):
    return sorted(tuple(r) for r in divergence.audit(docs, **more).collect())


def test_divergence_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Éa", "éa", "\U0001f600", "x\u0085y"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), " ".join(vocabulary[min(rng.randrange(124), rng.randrange(124))] + rng.choice(["", ".", "-B"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("lone", "s", "one two"), ("few", "s", "alpha"), ("few", "t", "beta"), ("few", None, None), (None, "z", None)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(7)
    want = plain_audit(rows)
    assert audit(docs) == want
    assert {r[4] for r in want if r[0] == "few"} == {0} and not [r for r in want if r[0] == "lone"]
    assert audit(docs, top=3) == plain_audit(rows, top=3) and audit(docs, least_docs=1) == plain_audit(rows, least_docs=1)


def test_joint_histogram_covers_all_terms(spark):
    docs = cases.documents(spark).withColumn("lang", F.lit("en"))
    kept = divergence.kept_terms(docs, 1)
    of = divergence.groups(docs, kept)
    got = divergence.joint_histogram(kept, of).groupBy("a", "b").agg(F.sum("m").alias("m"), F.min("m").alias("least")).collect()
    assert len(got) == 10 and {r.m for r in got} == {kept.count()} and min(r.least for r in got) >= 0


def test_divergence_hands_out_bounded_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 5)
    texts = [b"a b c", b"c d E f", b"", b"g a a"]
    batch = pa.record_batch([pa.array(["l"] * 4), pa.array(["s"] * 4), pa.array(texts)], names=["lang", "source", "text"])
    parts = list(divergence._partial_counts(iter([batch])))
    assert len(parts) == 2
    n, docs = Counter(), Counter()
    for part in parts:
        for r in part.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["n_docs"]
    assert n == {"a": 3, "b": 1, "c": 2, "d": 1, "e": 1, "f": 1, "g": 1} and docs == {"a": 2, "b": 1, "c": 2, "d": 1, "e": 1, "f": 1, "g": 1}


# Token counts

TEXTS = [None, "", " ", "  two  blanks ", "it's we'll I'D don't", "a<|endoftext|>b <|endoftext|> c", "<|endoftext|", "tab\tnew\nline \n x", "café été  nbsp  em x", "日本語 text \U0001f600 \U0001f600", "a" * 5000, "1234 5 67,89", "! ! ?? --", "x́ é"]


def tokenize(texts, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([x or "" for x in texts])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, tmp_path, name):
    docs = spark.createDataFrame(list(enumerate(TEXTS + TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.counted(docs, public_tokenizers.path(name), str(tmp_path / "cache"), limit=20).collect()}
    want = tokenize(TEXTS + TEXTS, name)
    assert [got[k].n_tokens for k in range(len(want))] == want
    assert all(got[k].n_bytes == len((t or "").encode()) and got[k].over_limit == (want[k] > 20) for k, t in enumerate(TEXTS))


def test_pieces_add_up_on_any_text(spark):
    rng = random.Random(2)
    count = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))[0]
    letters = list("ab'st.,!?19 éß́一  \t\n") + ["  ", " ", " ", "<|endoftext|>", "'re", "\U0001f600"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    assert count.in_pieces and count(texts) == tokenize(texts, "byte_bpe_50k.json")


def test_op12_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in registered.op12_token_counts(spark, sf).collect()}
    want = dict(zip(texts, tokenize(texts.values(), "byte_bpe_50k.json"), strict=True))
    assert got == {k: (len((t or "").encode()), want[k], want[k] > 1024) for k, t in texts.items()}


def test_cache_encodes_only_distinct_misses(spark, tmp_path):
    """A second run adds only what is new; another version shares nothing; stored counts are what is returned."""
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    make = lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    stored = lambda: spark.read.schema(token_counts._CACHE).parquet(cache)
    version = token_counts.fill(make(["one two", "one two", "three", None, ""]), path, cache)
    assert stored().count() == 3
    assert token_counts.fill(make(["three", "", "four four"] * 50), path, cache) == version and stored().count() == 4
    token_counts.fill(make(["three", "one two"]), path, cache)
    assert stored().count() == 4 == stored().select("digest").distinct().count()
    other = token_counts.fill(make(["three"]), public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert other != version and stored().count() == 5
    forged = stored().where(F.col("version") == version).select("digest", F.lit(77).cast("long").alias("n_tokens"), "version")
    forged.write.partitionBy("version").parquet(str(tmp_path / "forged"))
    assert {r.n_tokens for r in token_counts.counted(make(["three", "three", None]), path, str(tmp_path / "forged")).collect()} == {77}


def test_normal_form_shares_counts(spark, tmp_path):
    """The word tokenizer drops the case of ASCII letters, so that texts that differ in it may share a digest."""
    docs = spark.createDataFrame([(1, "Same Words"), (2, "same words"), (3, "SAME words")], "doc_id long, text string")
    rows = token_counts.counted(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache"), normal=F.lower).collect()
    assert {r.n_tokens for r in rows} == {tokenize(["Same Words"], "word_bpe_49k.json")[0]}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    about = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in about.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), c, len(about[w]), n[form[w]] if form[w] else None) for w, c in n.items())


def variants(docs):
    return sorted(tuple(r) for r in spelling.variants(docs).collect())


def test_variants_by_brute_force(spark):
    rng = random.Random(4)
    letters = "abaabenoé×À"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    for w in words[:25]:
        for _ in range(6):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    words += ["banana", "bananan", "anana", "bbbbbb", "bbbbb", "bbbbbbb", "AÉIOU", "aéiou", "aÉiou"]
    rows = [(k if k % 9 else None, " ".join(words[int(len(words) * rng.random() ** 3)] + rng.choice(["", ",", "ā", "1"]) for _ in range(60))) for k in range(120)]
    rows += [(600, "chaines " * 4 + "chained " * 9 + "chainad " * 20), (500, None), (501, ""), (502, "banana " * 400), (502, "banana " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_variants(rows)
    assert variants(docs) == want
    assert len(want) > 80 and sum(r[1] is not None for r in want) > 15 and any(r[2] not in (r[0], r[1]) for r in want)


def test_three_rarest_bigrams_lose_no_pair(spark):
    """All pairs of words over few letters, with repeated bigrams, against the keys of the join alone."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {(r.a, r.b) for r in spelling.near_pairs(df).collect()}
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)} and len({frozenset(p) for p in got}) == len(got)


def test_roots_of_long_ways(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w5"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w37" for w, _ in rows}


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """Spark takes the keys' size from the words' file, which is small enough to broadcast; the keys are many times as large."""
    plans, stored = [], spelling.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df):
        plans.append(plan(df))
        return stored(df)

    monkeypatch.setattr(spelling, "stored", noted)
    docs = spark.createDataFrame([(k, "chaines chained chained chainad " * 4) for k in range(9)], "doc_id long, text string")
    plans.append(plan(spelling.variants(docs)))
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert len(joins) >= 4 and all("SortMergeJoin" in line for line in joins)


def test_spelling_hands_out_bounded_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 3)
    texts = ["alpha beta gamma delta", "alpha alpha omega", ""]
    batch = pa.record_batch([pa.array(["1", "2", "3"]), pa.array(texts)], names=["doc_id", "text"])
    n = Counter()
    parts = list(spelling._partial_counts(iter([batch])))
    for part in parts:
        for r in part.to_pylist():
            n[r["word"]] += r["n"]
    assert len(parts) > 1 and n == {"alpha": 3, "gamma": 1, "delta": 1, "omega": 1}


# Awkward rows


def test_awkward_rows(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = cases.documents(spark)
    plain = [(r.doc_id, r.text) for r in rows.collect()]
    for k, docs in enumerate((rows, cases.clashing(spark))):
        assert audit(docs) == plain_audit([(r.lang, r.source, r.text) for r in rows.collect()])
        assert variants(docs) == plain_variants(plain)
        got = token_counts.counted(docs, path, str(tmp_path / f"cache{k}"))
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == sorted((i or 0, n) for (i, _), n in zip(plain, tokenize([t for _, t in plain], "byte_bpe_50k.json"), strict=True))
        assert set(docs.columns) <= set(got.columns)
    none = cases.empty(spark)
    assert audit(none) == [] and variants(none) == [] and token_counts.counted(none, path, str(tmp_path / "none")).collect() == []
    clash = rows.withColumns({"n_tokens": F.lit("x"), "__digest": F.lit("y"), "over_limit": F.lit(1)})
    got = token_counts.counted(clash, path, str(tmp_path / "clash"))
    assert got.count() == rows.count() and {r["__digest"] for r in got.collect()} == {"y"} and dict(got.dtypes)["n_tokens"] == "bigint"
