"""The registered queries of the corpus operators, with SQL where SQL expresses them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, divergence, mixing, pii, quality, rules, secret_scan, simhash, spelling, suffix_tree, token_counts, toxicity, urls
from tracewright.llm.common import fold, read, shared_folder, stored

#: The rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
POLICY = "v1"
TOKENIZER = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", (fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, path=F.col("source"), train_on=fold(F.col("doc_id")) != 0)
    return found.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.sha2("value", 256).alias("value_sha256"), "score", F.col("is_secret").cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(stored(rules.ledger(read(spark, sf_dir, "documents"))), POLICY)
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(rules.BASE_MASK)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "failed_bits")


def op6_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablation(stored(rules.ledger(read(spark, sf_dir, "documents"))), POLICY)


def op6_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the policy keeps, from one stored ledger."""
    return rules.compared(stored(rules.ledger(read(spark, sf_dir, "documents"))), list(rules.POLICIES))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.classified(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold(F.col("doc_id")) == quality.HELD_OUT).alias("held_out"), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, which is empty at first: all distinct texts are misses."""
    import public_tokenizers

    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    rows = token_counts.counted(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER), cache)
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_pii, op3_mixing, op4_toxicity, op5_secrets, op6_quality_rules, op6_rule_ablation, op6_policies, op7_url_filters, op8_simhash, op9_suffix_tree, op10_quality_classifier, op11_source_divergence, op12_token_counts, op13_spelling_variants]
    return {f.__name__: f for f in own}


_PLAIN = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH it AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 5) AS width FROM it WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS shingle FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM items)),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY 1),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
sd AS (SELECT DISTINCT doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS shingle FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM si)))
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM sd JOIN si USING (width, shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)"""

OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS spent, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, (source IS NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, spent) AS lvl FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lvl * weight) END AS target,
  ('0x' || substr(md5('mix:offset:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, off, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY floor(2 * sqrt(size)), h, doc_id, size) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(off + rate * k) - floor(off + rate * (k - 1)))::BIGINT * size)::BIGINT AS taken FROM r"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT row, i, w[i : i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
p AS (SELECT row, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper FROM d LEFT JOIN p USING (row)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT + 64 * (100 * n_upper > 50 * word_chars)::BIGINT)::BIGINT AS failed_bits FROM m)"""
OP6_ROWS = OP6 + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b"""
OP6_ABLATION = OP6 + """, r AS (SELECT unnest([{'rule': 'few_words', 'bit': 1}, {'rule': 'repeated_windows', 'bit': 2}, {'rule': 'symbols', 'bit': 4}, {'rule': 'duplicate_lines', 'bit': 8}, {'rule': 'short_words', 'bit': 16}, {'rule': 'long_words', 'bit': 32}, {'rule': 'shouting', 'bit': 64}], recursive := true))
SELECT rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits = bit) AS n_failed_alone, count(*) FILTER (WHERE failed_bits = bit OR failed_bits = 0) AS n_kept_without FROM b, r GROUP BY 1"""
OP6_POLICIES = OP6 + """, v AS (SELECT unnest([{'version': 'base', 'mask': 3}, {'version': 'v1', 'mask': 127}, {'version': 'v2-lenient', 'mask': 71}], recursive := true))
SELECT version, count(*) AS n, count(*) FILTER (WHERE failed_bits & mask = 0) AS n_kept, coalesce(sum(n_words) FILTER (WHERE failed_bits & mask = 0), 0)::BIGINT AS words_kept FROM b, v GROUP BY 1"""

OP7 = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT p.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (row)"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(max(s), 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY 1, 2) USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.size + v.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (v.size + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""

OP13 = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM t GROUP BY 1, 2),
x AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM u, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM x GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
i AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
o AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM i),
p AS (SELECT o.word AS a, w.word AS b FROM o JOIN w ON o.less = w.word UNION SELECT w.word, o.word FROM o JOIN w ON o.less = w.word UNION SELECT a.word, b.word FROM o a JOIN o b USING (hole) WHERE a.word <> b.word),
s AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM p JOIN w ON b = w.word GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN s USING (word)),
z AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, z.root FROM f JOIN z ON f.form = z.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op3_mixing": OP3, "op6_quality_rules": OP6_ROWS, "op6_rule_ablation": OP6_ABLATION, "op6_policies": OP6_POLICIES, "op7_url_filters": OP7, "op11_source_divergence": OP11, "op13_spelling_variants": OP13}
