"""The registered queries of the data tools; importing the module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import tables
from tracewright.plans.catalog import registered, table


@registered("SELECT min(doc_id) AS doc_id, coalesce(arg_min(source, doc_id), 'unknown') AS source, coalesce(arg_min(n_chars, doc_id)::DOUBLE, (SELECT avg(n_chars) FROM documents)) AS n_chars FROM documents GROUP BY text")
def clean_data(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("n_chars"), "text")
    return tables.clean(rows, F.col("text"), "doc_id", ("n_chars",), {"source": "unknown"}).select("doc_id", "source", "n_chars")


@registered("""WITH c AS (SELECT count(*) FILTER (value > 50) AS a, count(*) FILTER (value > 50 AND event_type <> 'error') AS b, count(*) FILTER (value > 50 AND event_type <> 'error' AND user_id IN (1, 2, 3)) AS c FROM events)
SELECT 1 AS step, a AS remaining FROM c UNION ALL SELECT 2, b FROM c UNION ALL SELECT 3, c FROM c""")
def filter_data(spark, sf_dir):
    return tables.filter_steps(table(spark, sf_dir, "events"), [("value", "gt", 50), ("event_type", "ne", "error"), ("user_id", "in", (1, 2, 3))])


@registered("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS sum, avg(o_totalprice) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def aggregate_data(spark, sf_dir):
    return tables.aggregated(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@registered("SELECT lang, count(*) AS n, count(l.doc_id) AS matched, count(l.doc_id) / count(*) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang")
def enrich_data(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    return tables.match_rate(table(spark, sf_dir, "documents"), "doc_id", labels, "labelled", "lang")


@registered("WITH m AS (SELECT event_type, avg(value) FILTER (user_id < 75) AS first_mean, avg(value) FILTER (NOT user_id < 75) AS second_mean FROM events GROUP BY 1) SELECT *, second_mean - first_mean AS difference, (second_mean - first_mean) * 100 / nullif(first_mean, 0) AS percent FROM m")
def compare_cohorts(spark, sf_dir):
    return tables.cohorts(table(spark, sf_dir, "events"), "value", F.col("user_id") < 75, "event_type")


@registered("SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS correlation, covar_samp(l_quantity, l_extendedprice) AS covariance FROM lineitem GROUP BY 1")
def correlate_data(spark, sf_dir):
    return tables.correlated(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@registered("SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'middle' ELSE 'high' END AS segment, count(*) AS n, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def segment_data(spark, sf_dir):
    return tables.segments(table(spark, sf_dir, "orders"), "o_totalprice", {"low": 50000, "middle": 150000}, "high")


@registered("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN ('that', 'nicht', 'dans', 'pour') GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)::INTEGER AS rank FROM c) WHERE rank <= 10""")
def extract_keywords(spark, sf_dir):
    return tables.keywords(table(spark, sf_dir, "documents"), "text", "lang", 10, ("that", "nicht", "dans", "pour"))


_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN {known}))" for known in tables.COMMON_WORDS.values())


@registered(f"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents), v AS (SELECT doc_id, lang, [{_VOTES}] AS v FROM w)
SELECT lang, CASE WHEN list_max(v) > 0 THEN {list(tables.COMMON_WORDS)}[list_position(v, list_max(v))] ELSE 'unknown' END AS guess, count(*) AS n FROM v GROUP BY ALL""")
def detect_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", tables.language(F.col("text")).alias("guess"))
    return docs.groupBy("lang", "guess").agg(F.count("*").alias("n"))


@registered("""WITH h AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_bad FROM customer GROUP BY 1), p AS (SELECT *, (n - n_bad) * 100 / n AS percent FROM h)
SELECT *, CASE WHEN percent > 80 THEN 'healthy' WHEN percent >= 50 THEN 'fair' ELSE 'poor' END AS level FROM p""")
def fleet_health(spark, sf_dir):
    return tables.health(table(spark, sf_dir, "customer"), F.col("c_acctbal") < 0, "c_nationkey")


@registered("""WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 17) AS change FROM events), s AS (SELECT *, sum(change) OVER w AS s FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS balance FROM s) SELECT event_id, balance::BIGINT AS balance, change < 0 AND balance < 10 AS reorder FROM b""")
def stock_ledger(spark, sf_dir):
    change = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) * (F.col("event_id") % 17)
    return tables.ledger(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), change, 10).select("event_id", "balance", "reorder")


@registered("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 2")
def last_turns(spark, sf_dir):
    return tables.last(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@registered("""WITH s AS (SELECT * FROM customer WHERE c_custkey = 7) SELECT c.c_custkey, (CASE WHEN c.c_mktsegment = s.c_mktsegment THEN 3 ELSE 0 END + CASE WHEN c.c_nationkey = s.c_nationkey THEN 5 ELSE 0 END)::INTEGER AS score
FROM customer c JOIN s ON c.c_custkey <> s.c_custkey WHERE score > 0 ORDER BY score DESC, c.c_custkey LIMIT 5""")
def recommend_similar(spark, sf_dir):
    return tables.recommended(table(spark, sf_dir, "customer"), "c_custkey", 7, {"c_mktsegment": 3, "c_nationkey": 5})


@registered("SELECT 'document' AS kind, doc_id AS id FROM documents WHERE contains(lower(text), 'nicht') UNION ALL SELECT 'page', page_id FROM pages WHERE contains(lower(html), 'nicht') UNION ALL SELECT 'item', item_id FROM benchmark WHERE contains(lower(text), 'nicht')")
def multi_table_search(spark, sf_dir):
    return tables.search("Nicht", document=(table(spark, sf_dir, "documents"), "doc_id", "text"), page=(table(spark, sf_dir, "pages"), "page_id", "html"), item=(table(spark, sf_dir, "benchmark"), "item_id", "text"))


@registered("""WITH l AS (SELECT user_id, event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n_loops FROM l WHERE same GROUP BY 1""")
def repeated_calls(spark, sf_dir):
    return tables.loops(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "event_type")


@registered("SELECT conv_id, turn, coalesce(sum((role = 'assistant')::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS turn_group FROM conversations")
def attach_to_assistant(spark, sf_dir):
    return tables.attached(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "turn_group")


@registered("SELECT coalesce(max(event_id), 0) + 1 AS next_id FROM events")
def next_id(spark, sf_dir):
    return table(spark, sf_dir, "events").agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_id"))
