"""The registered queries of benchmark runs and text tools; importing the module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import texts
from tracewright.operators import runs
from tracewright.plans.catalog import registered, table

# Runs


@registered("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def resume(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select("c_custkey")
    return runs.remaining(tasks, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@registered("SELECT event_type, count(*) AS n, avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0 END) AS utility_rate, avg(CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS security_rate FROM events GROUP BY 1")
def suite_success(spark, sf_dir):
    return runs.suite_success(table(spark, sf_dir, "events"), "event_type", F.col("value") > 10, F.col("user_id") % 2 == 0)


@registered("WITH r AS (SELECT CASE WHEN regexp_matches(text, '[!?]') THEN 'reasoning' ELSE 'triage' END AS method, toxic = 1 AS bad FROM documents JOIN labels USING (doc_id)) SELECT method, count(*) AS n, count(*) FILTER (bad) AS n_malicious, count(*) / (SELECT count(*) FROM r)::DOUBLE AS share FROM r GROUP BY 1")
def path_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return runs.path_split(rows.withColumn("method", F.when(F.col("text").rlike("[!?]"), "reasoning").otherwise("triage")), "method", F.col("toxic") == 1)


@registered("""WITH t AS (SELECT c_mktsegment, c_nationkey < 10 AS needed, c_acctbal > 0 AS used FROM customer)
SELECT c_mktsegment, count(*) FILTER (needed AND used) AS needed_used, count(*) FILTER (needed AND NOT used) AS needed_unused, count(*) FILTER (NOT needed AND used) AS unneeded_used, count(*) FILTER (NOT needed AND NOT used) AS unneeded_unused FROM t GROUP BY 1""")
def necessity_matrix(spark, sf_dir):
    return runs.necessity(table(spark, sf_dir, "customer"), F.col("c_nationkey") < 10, F.col("c_acctbal") > 0, "c_mktsegment")


@registered("SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda x: NOT list_contains(['click', 'view', 'purchase'], x))) = 0 AS known FROM events GROUP BY 1")
def injection_keys(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("used"))
    return used.select("user_id", runs.keys_known(F.col("used"), F.array(*map(F.lit, ("click", "view", "purchase")))).alias("known"))


@registered("SELECT o_custkey FROM orders GROUP BY 1 HAVING list_contains(list(o_orderstatus), 'P')")
def channel_members(spark, sf_dir):
    users = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("channels"))
    return runs.members(users, "o_custkey", "channels", "P")


@registered("SELECT event_type, count(*) AS n_messages, count(DISTINCT CASE WHEN value > 45 THEN user_id END) AS n_groups FROM events GROUP BY 1")
def topic_consumers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return runs.consumers(events, "event_type", events.where("value > 45"), "user_id")


@registered("SELECT l_orderkey, count(*) AS n_lines, count(*) - count(p_partkey) AS n_unknown, coalesce(sum(p_retailprice * l_quantity), 0) AS total FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON l_partkey = p_partkey GROUP BY 1")
def order_lines(spark, sf_dir):
    return runs.order_lines(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", table(spark, sf_dir, "part").where("p_size > 3"), "p_partkey", "p_retailprice", "l_orderkey")


@registered("WITH a AS (SELECT c_custkey AS user_id, c_nationkey::BIGINT AS n FROM customer UNION ALL SELECT user_id, 1 FROM events) SELECT user_id, sum(n)::BIGINT AS n FROM a WHERE user_id IS NOT NULL GROUP BY 1")
def counter_upsert(spark, sf_dir):
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("n"))
    return runs.counters(state, table(spark, sf_dir, "events"), "user_id", "n")


@registered("SELECT c_custkey, c_acctbal - 10000.0::DOUBLE AS gain, (c_acctbal - 10000.0::DOUBLE) * 100 / 10000 AS gain_percent FROM customer")
def portfolio_return(spark, sf_dir):
    return runs.trades_return(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "gain", "gain_percent")


# Texts


@registered("""SELECT item_id, upper(replace(text, 'ß', 'SS')) AS upper, reverse(text) AS reversed, upper(text[1]) || lower(text[2:]) AS sentence, translate(text, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '') AS bare FROM benchmark""")
def text_transforms(spark, sf_dir):
    kinds = {"upper": "uppercase", "reversed": "reverse", "sentence": "sentence_case", "bare": "remove_punctuation"}
    return table(spark, sf_dir, "benchmark").select("item_id", *[texts.transformed(F.col("text"), kind).alias(name) for name, kind in kinds.items()])


_WORD_LISTS = {"article": ("the", "der", "le"), "joining": ("and", "und", "et"), "place": ("in", "dans")}
_COUNTED = ", ".join(f"len(list_filter(w, lambda x: list_contains({list(v)}, x)))::INTEGER AS {k}" for k, v in _WORD_LISTS.items())


@registered(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), c AS (SELECT doc_id, {_COUNTED} FROM w)
SELECT *, CASE WHEN greatest(article, joining, place) = 0 THEN 'neutral' WHEN article >= greatest(joining, place) THEN 'article' WHEN joining >= place THEN 'joining' ELSE 'place' END AS best FROM c""")
def lexicon_votes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.votes(F.col("text"), _WORD_LISTS).alias("v")).select("doc_id", "v.*")


@registered("""WITH s AS (SELECT doc_id, (contains(t, 'the')::INT + contains(t, 'and')::INT) / 2 AS en, (contains(t, 'der')::INT + contains(t, 'und')::INT + contains(t, 'die')::INT) / 3 AS de FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))
SELECT doc_id, CASE WHEN en >= de THEN 'english' ELSE 'german' END AS type, greatest(en, de) AS score, CASE WHEN en >= de THEN en >= 0.6 ELSE de >= 0.9 END AS meets FROM s""")
def classify_documents(spark, sf_dir):
    types = {"english": (("The", "and"), 0.6), "german": (("der", "und", "die"), 0.9)}
    return table(spark, sf_dir, "documents").select("doc_id", texts.classified(F.col("text"), types).alias("c")).select("doc_id", "c.*")


@registered("""WITH l AS (SELECT doc_id, text, [ltrim(x, E' \\t\\r\\n\\v\\f') FOR x IN string_split(text, chr(10))] AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(l)::INTEGER AS n_lines, len(list_filter(l, lambda x: x <> ''))::INTEGER AS logical, len(list_filter(l, lambda x: starts_with(x, '#')))::INTEGER AS comments, (len(regexp_extract_all(text, '\\b(if|elif|for|while|except|and|or)\\b')) + 1)::INTEGER AS complexity FROM l)
SELECT *, n_lines - logical AS blank, CASE WHEN logical = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 171 - 5.2::DOUBLE * (complexity / logical) - 0.23::DOUBLE * complexity - 16.2::DOUBLE * (2 / logical))) END AS maintainability FROM c""")
def code_complexity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", texts.complexity(F.col("text"), F.lit(2)).alias("c")).select("doc_id", "c.*")


@registered("SELECT c_custkey, greatest(-12, least(14, round_even((c_custkey % 400 - 200) / 15, 0)))::INTEGER AS utc_offset FROM customer")
def utc_offsets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", texts.utc_offset((F.col("c_custkey") % 400 - 200).cast("double")).alias("utc_offset"))


@registered("SELECT event_id, '[' || upper(event_type) || '] ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | Session: ' || substr('e' || event_id || 'abcdefgh', 1, 8) || '... | Turns: ' || user_id || ' | Tools: 3' AS line FROM events")
def event_lines(spark, sf_dir):
    session = F.concat(F.lit("chat_x_e"), F.col("event_id").cast("string"), F.lit("abcdefgh"))
    return table(spark, sf_dir, "events").select("event_id", texts.event_line(F.col("event_type"), F.col("ts"), session, F.col("user_id"), F.lit(3)).alias("line"))
