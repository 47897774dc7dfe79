"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities themselves. Corpus statistics then find the terms that give an entity away. The pointwise
mutual information of a term and an entity, over the entity's own information, is 1 where the term occurs with nothing else, and
0 where it tells nothing. It is shrunk by how much evidence there is: with evidence e, a pair keeps e / (e + 1) of it. Each distinct
surroundings of the entity in the documents that hold both is evidence, and one more where the term itself stands beside the
entity. Copies of a passage are one surroundings, so that their number is no evidence.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.blooms import listed_only
from tracewright.llm.common import bounded, saved, stored, whole
from tracewright.llm.decontamination import plain_words
from tracewright.llm.spans import matches

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: The patterns as their contracts state them, written without backtracking: a match can only begin at the start of a run
#: or where the last match ended, and runs are possessive where what follows is not in them.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must have, cheaper to look for than the pattern.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "[+][0-9]"}
WINDOW_WORDS, WINDOW_CHARS = 5, 120
#: Disclosure, after shrinking, from which on a term is generalised or removed. For a term that is found with
#: nothing else, standing beside the entity once or being in two documents of its own surroundings suffices for the first.
GENERALISE_AT, REMOVE_AT = 0.66, 0.75


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of a string of 1 to 19 digits."""
    twice = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    terms = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(twice, d.cast("int"))))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
    n = F.length(_digits(v))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(v))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _is_valid(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _listed(kind: str, span: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), span["start"].cast("string"), F.lit(":"), span["end"].cast("string"))


def _of_kind(kind: str, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).alias("kind"), span["value"].alias("value"))


def _placeholder(kind: str, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(f"<{kind}>").alias("by"))


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: the valid matches in a text that is not null."""
    out = {}
    for kind in KINDS:
        found = F.filter(matches(text, PATTERNS[kind]), partial(_is_valid, kind))
        out[kind] = F.when(F.regexp_like(text, F.lit(GUARDS[kind])), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return out


def _with_spans(docs: DataFrame, *keep: str) -> DataFrame:
    rows = docs.select(*keep, whole(F.col("text")).alias("__text"))
    return rows.select("*", F.xxhash64("__text").alias("__hash"), *[c.alias(f"__{kind}") for kind, c in base_spans(F.col("__text")).items()])


def _nearest(text: Column, span: Column) -> Column:
    """The nearest words on either side of a span, none that may be cut."""
    first = F.greatest(span["start"] - WINDOW_CHARS, F.lit(0))
    left, right = plain_words(F.substring(text, first + 1, span["start"] - first)), plain_words(F.substring(text, span["end"] + 1, F.lit(WINDOW_CHARS)))
    near_left = F.slice(F.reverse(F.when(first > 0, F.slice(left, 2, F.lit(WINDOW_CHARS))).otherwise(left)), 1, WINDOW_WORDS)
    cut = F.length(text) > span["end"] + WINDOW_CHARS
    near_right = F.slice(F.when(cut, F.slice(right, F.lit(1), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right), 1, WINDOW_WORDS)
    return F.array_sort(F.array_distinct(F.concat(near_left, near_right)))


def contexts(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), entities and words of each document that holds an entity; documents that agree in doc_id and
    text are one. entities: each entity with the words beside it; an entity is a kind with the lower-cased value, digits only
    for numbers. words: the distinct words of three letters or more outside of all entities."""
    rows = _with_spans(docs, "doc_id").where(" OR ".join(f"size(__{k}) > 0" for k in KINDS)).dropDuplicates(["doc_id", "__hash"])
    spans = F.array_sort(F.concat(*[F.transform(f"__{k}", partial(_of_kind, k)) for k in KINDS]))
    text, begin = F.col("__text"), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), F.lit(" ")).alias("out"))
    outside = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    value = lambda s: F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
    entities = F.transform(spans, lambda s: F.struct(F.concat_ws(":", s["kind"], value(s)).alias("entity"), _nearest(text, s).alias("near")))
    return rows.select("doc_id", F.col("__hash").alias("hash"), entities.alias("entities"), F.filter(F.array_distinct(plain_words(outside)), lambda w: F.length(w) >= 3).alias("words"))


def disclosing(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> tuple[DataFrame, DataFrame]:
    """The terms that reveal an entity (term, disclosure, action) and the documents that hold them (doc_id, hash, term).

    disclosure = ratio * e / (e + 1), where ratio = log(N * n_both / (n_entity * n_term)) / log(N / n_entity) with counts of whole
    documents, and e is the number of distinct surroundings of the entity in the documents that hold both, each counted twice
    where the term is in it. Pairs that cannot reach the threshold are left out by exact bounds, before the corpus is read for
    its terms: the ratio is at most 1, and a term has at least the documents in which it is found with any entity."""
    found = stored(contexts(docs))
    total = docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("hash")).distinct().count()
    least = generalise_at / (1 - generalise_at) - 1e-9 if generalise_at < 1 else float("inf")
    # of a document and an entity one row: all its surroundings there are one
    each = found.select("doc_id", "hash", F.explode("entities").alias("e")).groupBy("doc_id", "hash", F.col("e.entity").alias("entity"))
    own = each.agg(F.array_sort(F.collect_set("e.near")).alias("nears"))
    own = stored(own.select("doc_id", "hash", "entity", F.xxhash64("nears").alias("context"), F.array_distinct(F.flatten("nears")).alias("near")))
    entities = own.groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_contexts"))
    entities = saved(entities.where((2 * F.col("n_contexts") >= least) & (F.col("n_entity") < total)))
    words = found.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "words")
    held = own.join(bounded(entities), "entity").join(words, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")))
    # where an entity has too few surroundings, only the terms beside it can have evidence enough
    asked = F.when(F.col("n_contexts") >= least, F.col("words")).otherwise(F.array_intersect("near", "words"))
    held = held.select("entity", "context", "n_entity", "n_contexts", "near", F.explode(asked).alias("term")).withColumn("near", F.array_contains("near", F.col("term")).cast("long"))

    def disclosure(n_term: str, e: Column) -> Column:
        pmi = F.log(F.lit(float(total)) * F.least("n_both", n_term) / (F.col("n_entity") * F.col(n_term)))
        return pmi / F.log(F.lit(float(total)) / F.col("n_entity")) * e / (e + 1)

    both = held.groupBy("entity", "term", "n_entity", "n_contexts").agg(F.count("*").alias("n_both"), F.sum("near").alias("n_beside"))
    near = found.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    most = F.least("n_both", "n_contexts") + F.least("n_beside", "n_contexts")
    both = saved(both.join(near, "term").where((most >= least) & (disclosure("n_near", most) >= generalise_at)).drop("n_contexts", "n_beside"))
    # the surroundings are counted for those pairs only that could reach the threshold
    seen = held.join(bounded(both.select("entity", "term")), ["entity", "term"], "left_semi").groupBy("entity", "term", "context").agg(F.max("near").alias("near"))
    seen = seen.groupBy("entity", "term").agg((F.count("*") + F.sum("near")).alias("e"))
    both = saved(both.join(seen, ["entity", "term"]).where(disclosure("n_near", F.col("e")) >= generalise_at).select("entity", "term", "n_entity", "n_both", "e"))
    here = docs.select("doc_id", whole(F.col("text")).alias("text")).select("doc_id", F.xxhash64("text").alias("hash"), F.explode(F.array_distinct(plain_words(F.col("text")))).alias("term"))
    # all words are counted before the join, whose rows then follow the terms and not their occurrences
    n_term = here.groupBy("term").agg(F.count("*").alias("n_term"))
    rated = n_term.join(bounded(both), "term")
    terms = rated.groupBy("term").agg(F.max(disclosure("n_term", F.col("e"))).alias("disclosure")).where(F.col("disclosure") >= generalise_at)
    terms = saved(terms.withColumn("action", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")))
    return terms, stored(listed_only(here, terms, "term").distinct())


def find(docs: DataFrame, **options) -> DataFrame:
    """docs with the columns __text, __hash, __email, __ip, __card, __phone and __term (spans of what is to be replaced).

    A null text is an empty one and has no spans. Documents that agree in doc_id and text count once; other columns stay as they
    are."""
    terms, where = disclosing(docs, **options)
    acts = F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("__acts")
    acts = saved(where.join(bounded(terms), "term").groupBy("doc_id", "hash").agg(acts)).withColumnsRenamed({"doc_id": "__id", "hash": "__h"})
    rows = _with_spans(docs, *docs.columns).join(bounded(acts), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    inside = lambda s: F.exists(F.concat(*[F.col(f"__{k}") for k in KINDS]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    tokens = F.filter(matches(F.col("__text"), r"[\p{L}\p{N}]+"), lambda s: F.map_contains_key(F.col("__acts"), F.lower(s["value"])) & ~inside(s))
    acted = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.try_element_at(F.col("__acts"), F.lower(s["value"])).alias("action")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,action:string>>")
    return rows.withColumn("__term", F.when(F.col("__acts").isNotNull(), acted).otherwise(none)).drop("__id", "__h", "__acts")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of docs."""
    rows = find(docs.select("doc_id", "text"), **options)
    joined = {k: F.transform(f"__{k}", partial(_listed, k)) for k in (*KINDS, "term")}
    base = F.concat(*[joined[k] for k in KINDS])
    return rows.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, "term")], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, joined["term"]), ",").alias("spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with text replaced: entities by their kind in angle brackets, revealing terms removed or made general (a number,
    a name where capitalised, else a word). Overlapping spans become one. n_chars, where docs has it, follows the text."""
    rows = find(docs, **options)
    label = lambda s: F.when(s["action"] == "remove", "").when(s["value"].rlike("^[0-9]+$"), "<number>").when(s["value"].rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")
    marked = [F.transform(f"__{k}", partial(_placeholder, k)) for k in KINDS]
    marked.append(F.transform("__term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("by"))))
    rows = rows.withColumn("__all", F.array_sort(F.concat(*marked)))
    text = F.col("__text")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["by"])).otherwise(acc["out"]).alias("out"))
    changed = F.aggregate("__all", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    rows = rows.withColumn("text", F.when(F.size("__all") > 0, changed).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")) if dict(docs.dtypes)["n_chars"] == "bigint" else F.col("n_chars"))
    return rows.select(*docs.columns)
