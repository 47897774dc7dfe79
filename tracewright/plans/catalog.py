"""The registered queries of the library, each with its SQL, over the driver's tables.

Chat messages come from conversations, tool calls and time series from events, verdicts from a rule over documents with
labels, dimensions from the sales tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import detection, evaluation, sessions, statistics, usage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.lit(0).alias("n_tools"))


def verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A rule's verdict on each document, and labels."""
    rule = F.lower("text").rlike("idiot|moron|scum|worthless|pathetic")
    found = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("latency"), rule.alias("predicted"))
    return found, table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("actual"))


_VERDICTS = """WITH v AS (SELECT doc_id, lang, n_chars::DOUBLE AS latency, regexp_matches(lower(text), 'idiot|moron|scum|worthless|pathetic') AS predicted FROM documents),
j AS (SELECT v.*, toxic = 1 AS actual FROM v JOIN labels USING (doc_id)) """


def _confusion_sql(by: str = "", more: str = "") -> str:
    return _VERDICTS + f""", c AS (SELECT {by} count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn FROM j {'GROUP BY ALL' if by else ''}),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0::DOUBLE) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE) AS recall, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0::DOUBLE) AS accuracy FROM c)
SELECT *, {more} coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0::DOUBLE) AS f1 FROM r"""


# Sessions


@registered("SELECT role, count(DISTINCT conv_id) AS n_sessions, count(*) AS n_messages, 0::BIGINT AS n_tool_calls FROM conversations GROUP BY role")
def ingestion_summary(spark, sf_dir):
    return sessions.summary(messages(spark, sf_dir), "role")


@registered("SELECT conv_id AS session_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1")
def transcripts(spark, sf_dir):
    return sessions.transcript(sessions.fold(messages(spark, sf_dir)))


@registered("""WITH s AS (SELECT conv_id AS session_id, count(*) AS n_messages, trim(coalesce(arg_min(text, (turn, role)), '')) AS first FROM conversations GROUP BY 1)
SELECT session_id, n_messages::INTEGER AS n_messages FROM s WHERE n_messages >= 2 OR (length(first) > 5 AND NOT regexp_matches(lower(first), 'invalid api key|please run /login|authentication failed|unauthorized|session expired|rate limit|api error|warmup'))""")
def meaningful_sessions(spark, sf_dir):
    return sessions.meaningful(sessions.fold(messages(spark, sf_dir))).select("session_id", "n_messages")


@registered("""SELECT conv_id AS session_id, turn AS seq, CASE WHEN role = 'user' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 THEN 'user_prompt' WHEN role = 'user' THEN 'tool_result' WHEN role = 'system' THEN 'system_init' ELSE 'agent_response' END AS message_type FROM conversations""")
def message_types(spark, sf_dir):
    return sessions.message_types(messages(spark, sf_dir)).select("session_id", "seq", "message_type")


@registered("""SELECT conv_id AS session_id, turn AS seq, count(*) OVER w AS n_past, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS past_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def past_traces(spark, sf_dir):
    return sessions.past_traces(messages(spark, sf_dir)).select("session_id", "seq", "n_past", "past_chars")


@registered("""WITH t AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_at FROM conversations GROUP BY 1) SELECT c.conv_id AS session_id, turn AS seq FROM conversations c JOIN t USING (conv_id) WHERE first_at IS NULL OR turn <= first_at""")
def until_first_threat(spark, sf_dir):
    return sessions.until_first(messages(spark, sf_dir), F.col("role") == "assistant").select("session_id", "seq")


@registered("""WITH s AS (SELECT user_id AS session_id, max(ts) AS ts FROM events GROUP BY 1), e AS (SELECT user_id AS session_id, max(date_trunc('second', ts)) AS last FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT s.session_id, s.ts FROM s LEFT JOIN e USING (session_id) WHERE last IS NULL OR date_trunc('second', s.ts) > last""")
def incremental_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts")
    return sessions.unseen(rows.groupBy("session_id").agg(F.max("ts").alias("ts")), rows.where("ts < TIMESTAMP '2024-01-29'"))


# Evaluation


@registered(_confusion_sql())
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(evaluation.judged(*verdicts(spark, sf_dir), "doc_id"))


@registered(_confusion_sql("lang,"))
def per_group_metrics(spark, sf_dir):
    return evaluation.confusion(evaluation.judged(*verdicts(spark, sf_dir), "doc_id"), "lang")


@registered(_VERDICTS + "SELECT (SELECT count(*) FROM v) AS total, (SELECT count(*) FROM j) AS scored, (SELECT count(*) FROM v) - (SELECT count(*) FROM j) AS dropped")
def run_stats(spark, sf_dir):
    return evaluation.run_stats(*verdicts(spark, sf_dir), "doc_id")


@registered("SELECT event_type, avg(value) AS mean, median(value) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    return evaluation.spread(table(spark, sf_dir, "events"), "value", "event_type")


@registered("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) * 100.0::DOUBLE / count(*) OVER (PARTITION BY event_type) AS cdf FROM events WHERE value > 0")
def latency_cdf(spark, sf_dir):
    return evaluation.rank_percent(table(spark, sf_dir, "events"), "value", "event_type", "event_id").select("event_id", "cdf")


@registered("""WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1), b AS (SELECT mean AS base FROM m WHERE event_type = (SELECT min(event_type) FROM m))
SELECT event_type, mean, coalesce((mean - base) * 100.0 / nullif(base, 0), 0) AS improvement FROM m, b""")
def ablation_advantage(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    least = means.agg(F.min("event_type").alias("least"))
    based = means.join(F.broadcast(least), F.lit(True)).withColumn("is_base", F.col("event_type") == F.col("least"))
    return evaluation.relative_to(based, "is_base", True, "mean").select("event_type", "mean", "improvement")


@registered(_VERDICTS + "SELECT lang, coalesce(count(*) FILTER (actual AND predicted) / nullif(count(*) FILTER (actual), 0), 0.0::DOUBLE) AS rule, coalesce(count(*) FILTER (actual AND latency > 1000) / nullif(count(*) FILTER (actual), 0), 0.0::DOUBLE) AS long_text FROM j GROUP BY 1")
def detection_rates(spark, sf_dir):
    rows = evaluation.judged(*verdicts(spark, sf_dir), "doc_id")
    return evaluation.detection_rates(rows, "lang", {"rule": F.col("predicted"), "long_text": F.col("latency") > 1000})


@registered("""SELECT r_name, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS building, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END)::BIGINT AS machinery
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def rate_pivot(spark, sf_dir):
    """Rows of a tactic by detector, as a pivot with its columns stated."""
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    out = joined.groupBy("r_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return out.select("r_name", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@registered("SELECT toxic AS label, count(*) AS n, count(*) / (SELECT count(*) FROM labels)::DOUBLE AS share FROM labels GROUP BY 1")
def class_distribution(spark, sf_dir):
    return evaluation.class_distribution(table(spark, sf_dir, "labels").select(F.col("toxic").alias("label")), "label")


@registered("""WITH r AS (SELECT count(*) AS n_tasks, count(*) FILTER (value > 10) AS n_succeeded, sum(value) AS work_seconds, avg(value) AS mean_seconds FROM events)
SELECT *, n_succeeded / n_tasks AS success_rate, work_seconds / 1000.0::DOUBLE AS speedup, work_seconds / 1000.0::DOUBLE / 10 AS efficiency FROM r""")
def run_summary(spark, sf_dir):
    return evaluation.run_summary(table(spark, sf_dir, "events"), "value", F.col("value") > 10, 1000.0, 10)


@registered(_confusion_sql("lang, sum(latency) AS total_cost,", "coalesce(total_cost / nullif(tp, 0), 0.0::DOUBLE) AS cost_per_tp,"))
def ablation_table(spark, sf_dir):
    return evaluation.ablation_table(evaluation.judged(*verdicts(spark, sf_dir), "doc_id"), "lang", "latency")


# Usage


_CALLS = "WITH c AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'mcp__web__click' WHEN event_type = 'view' THEN 'mcp__files__read__all' ELSE event_type END AS tool FROM events) "


def _calls(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "mcp__web__click").when(F.col("event_type") == "view", "mcp__files__read__all").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", name.alias("tool"))


@registered(_CALLS.rstrip() + """, s AS (SELECT user_id, count(*) AS n_calls, count(*) FILTER (tool LIKE 'mcp\\_\\_%' ESCAPE '\\') AS n_mcp, count(DISTINCT CASE WHEN tool LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN split_part(tool, '__', 2) END) AS n_servers FROM c GROUP BY 1)
SELECT *, n_calls - n_mcp AS n_native, n_mcp / n_calls AS mcp_ratio, n_mcp > 0 AS used_mcp FROM s""")
def mcp_split(spark, sf_dir):
    return usage.mcp_split(_calls(spark, sf_dir), "tool", "user_id")


@registered(_CALLS + """SELECT split_part(tool, '__', 2) AS server, count(*) AS n_calls, count(DISTINCT user_id) AS n_sessions FROM c WHERE tool LIKE 'mcp\\_\\_%' ESCAPE '\\' GROUP BY 1""")
def server_counts(spark, sf_dir):
    return usage.server_counts(_calls(spark, sf_dir), "tool", "user_id")


@registered("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS total, list(event_type || '=' || n ORDER BY event_type || '=' || n) AS tools FROM c GROUP BY 1""")
def tool_usage(spark, sf_dir):
    return usage.nested_counts(table(spark, sf_dir, "events"), "user_id", "event_type")


@registered("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def top_users(spark, sf_dir):
    return usage.top(table(spark, sf_dir, "events"), "user_id", 5)


@registered("""SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) WHERE rank <= 3""")
def top_per_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return usage.top_in_group(rows, "user_id", [F.col("value").desc(), F.col("event_id")], 3)


@registered("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, sum(value) AS sum, avg(value) AS avg, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY 1, 2")
def time_buckets(spark, sf_dir):
    return usage.buckets(table(spark, sf_dir, "events"), "ts", "1 hour", "value", "event_type")


@registered("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS n_bad FROM events GROUP BY 1), q AS (SELECT *, least(100.0::DOUBLE, n_bad * 100.0::DOUBLE / n) AS score FROM s)
SELECT *, CASE WHEN score > 50 THEN 'high' WHEN score > 20 THEN 'medium' ELSE 'low' END AS level FROM q""")
def anomaly_score(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return usage.anomaly_score(rows, F.col("event_type") == rows.agg(F.min("event_type")).first()[0], "user_id")


@registered("""WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS value FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS up, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS down FROM d),
m AS (SELECT event_type, avg(value) FILTER (up <= 7) AS first_mean, avg(value) FILTER (down <= 7) AS last_mean FROM r GROUP BY 1), g AS (SELECT *, coalesce((last_mean - first_mean) * 100.0 / nullif(first_mean, 0), 0) AS growth FROM m)
SELECT *, CASE WHEN growth > 5 THEN 'up' WHEN growth < -5 THEN 'down' ELSE 'stable' END AS trend FROM g""")
def period_growth(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return usage.growth(daily, "event_type", "day", "value")


@registered("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, run HAVING count(*) >= 2""")
def tool_bursts(spark, sf_dir):
    return usage.bursts(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes", 2)


@registered("""WITH p AS (SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS prev_id, arg_max(b.value, (b.ts, b.event_id)) AS prev_value FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY 1) SELECT event_id, prev_id, prev_value FROM p""")
def previous_event(spark, sf_dir):
    return usage.previous(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value").select("event_id", "prev_id", "prev_value")


@registered("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) SELECT event_id, (value - m) / s AS z FROM events JOIN s USING (event_type) WHERE abs((value - m) / s) >= 2""")
def reading_anomalies(spark, sf_dir):
    return usage.zscores(table(spark, sf_dir, "events"), "event_type", "value", 2.0).select("event_id", "z")


# Statistics

_MOMENTS = """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS a, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1),
k AS (SELECT l_returnflag, avg(pow((l_quantity - a) / s, 3)) AS sk, avg(pow((l_quantity - a) / s, 4)) - 3 AS ku FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, max(l_quantity) - min(l_quantity) AS range, sum(l_quantity) AS sum, var_samp(l_quantity) AS variance, stddev_samp(l_quantity) AS stddev,
stddev_samp(l_quantity) / sqrt(count(*)) AS std_error, any_value(sk) AS skewness, any_value(ku) AS kurtosis FROM lineitem JOIN k USING (l_returnflag) GROUP BY 1"""


@registered(_MOMENTS)
def descriptive_statistics(spark, sf_dir):
    return statistics.describe(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@registered("""WITH l AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS x, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT l_returnflag, n, x[n // 4 + 1] AS q1, x[3 * n // 4 + 1] AS q3, x FROM l)
SELECT l_returnflag, n::BIGINT AS n, q1, q3, len(list_filter(x, lambda v: v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)))::BIGINT AS n_outliers FROM q""")
def index_quartiles(spark, sf_dir):
    return statistics.index_quartiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@registered("""WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS x, sum(value) AS y FROM events GROUP BY ALL), t AS (SELECT event_type, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, max(x) AS last FROM d GROUP BY 1), f AS (SELECT event_type, slope, intercept, intercept + slope * (last + 7) AS forecast FROM t)
SELECT *, forecast * 0.85 AS low, forecast * 1.15 AS high FROM f""")
def trend_forecast(spark, sf_dir):
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    return statistics.trend(table(spark, sf_dir, "events").groupBy("event_type", day.alias("x")).agg(F.sum("value").alias("y")), "event_type", "x", "y", 7)


@registered("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(value > 1, false)) AS v, count(*) FILTER (NOT coalesce(props LIKE '{%', false)) AS p, count(*) FILTER (user_id IS NULL) AS u FROM events),
l AS (SELECT 'value_range' AS "check", v AS n_invalid, n FROM c UNION ALL SELECT 'props_format', p, n FROM c UNION ALL SELECT 'user_present', u, n FROM c)
SELECT *, 1 - n_invalid / n AS compliance, 1 - n_invalid / n > 0.9 AS compliant FROM l""")
def schema_validation(spark, sf_dir):
    return statistics.complete(table(spark, sf_dir, "events"), {"value_range": "value > 1", "props_format": "props LIKE '{%'", "user_present": "user_id IS NOT NULL"})


# Detection and search


@registered("""WITH s AS (SELECT user_id, max(value / 100) AS top, count(*) AS n_messages, count(*) FILTER (value / 100 >= 0.8) AS n_threats FROM events GROUP BY 1)
SELECT user_id, n_messages, n_threats, n_threats > 0 AS is_malicious, CASE WHEN n_threats > 0 THEN top ELSE greatest(0.1, least(0.3, top * 0.3)) END AS confidence FROM s""")
def any_threat_fold(spark, sf_dir):
    return detection.fold_scores(table(spark, sf_dir, "events"), "user_id", F.col("value") / 100)


@registered("""SELECT doc_id, regexp_matches(text, '[!?]') AND length(text) > 1000 AS is_malicious, CASE WHEN regexp_matches(text, '[!?]') THEN 'reasoning' ELSE 'triage' END AS method, CASE WHEN regexp_matches(text, '[!?]') THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS cost FROM documents""")
def two_stage_cascade(spark, sf_dir):
    rows = detection.cascade(table(spark, sf_dir, "documents"), F.col("text").rlike("[!?]"), F.length("text") > 1000, F.lit(0.25), F.lit(0.5))
    return rows.select("doc_id", "is_malicious", "method", "cost")


@registered("""WITH t AS (SELECT user_id, list_distinct(list(event_type)) AS called, ['click', 'view', 'other'] AS expected FROM events GROUP BY 1)
SELECT user_id, list_sort(list_filter(expected, lambda x: list_contains(called, x))) AS hit, list_sort(list_filter(expected, lambda x: NOT list_contains(called, x))) AS missing, len(list_filter(expected, lambda x: list_contains(called, x))) / 3 AS coverage FROM t""")
def expected_tool_coverage(spark, sf_dir):
    called = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("called"))
    c = detection.coverage(F.array(F.lit("click"), F.lit("view"), F.lit("other")), F.col("called"))
    return called.select("user_id", c.alias("c")).select("user_id", "c.hit", "c.missing", "c.coverage")


@registered("""SELECT doc_id, CASE WHEN list_has_all(['de', 'en'], [lang]) THEN 'Trusted' WHEN list_has_all(['de', 'en', 'fr'], [lang]) THEN 'Transparent' ELSE 'Untrusted' END AS principal FROM documents""")
def trust_evaluation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detection.trust(F.array("lang"), ("de", "en"), ("fr",)).alias("principal"))


@registered("SELECT doc_id FROM documents WHERE list_bool_and([contains(lower(text), w) FOR w IN ['the', 'and', 'er']])")
def all_words_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.forall(F.split(F.lit("the and er"), " "), lambda w: F.contains(F.lower("text"), w))).select("doc_id")


# Joins and sets


@registered("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_outer_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@registered("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@registered("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
def anti_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 480000")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@registered("""SELECT c_custkey, greatest(0, least(100, CASE WHEN length(p) >= 8 THEN least(2 * length(p), 25) ELSE 0 END + 10 * regexp_matches(p, '[a-z]')::INT + 10 * regexp_matches(p, '[A-Z]')::INT + 10 * regexp_matches(p, '[0-9]')::INT + 10 * regexp_matches(p, '[!@#$%^&*()_+=\\[\\]{}|;:,.<>?-]')::INT
+ least(2 * len(list_distinct(string_split(p, ''))), 20) - least(25, 10 * len(list_filter(range(1, length(p) - 1), lambda i: ascii(p[i + 1]) = ascii(p[i]) + 1 AND ascii(p[i + 2]) = ascii(p[i]) + 2)))))::INTEGER AS strength FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN 'abcdef123456' ELSE c_custkey::VARCHAR END AS p FROM customer)""")
def password_strength(spark, sf_dir):
    p = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "abcdef123456").otherwise(F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.password_strength(p).cast("int").alias("strength"))


@registered("SELECT n_name, r_name FROM nation, region")
def task_pairs(spark, sf_dir):
    """Every task with every injection: both are small fixed dimensions."""
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region"))).select("n_name", "r_name")


@registered("""WITH p(t, p_in, p_out) AS (VALUES ('AUTOMOBILE', 2.5::DOUBLE, 10.0::DOUBLE), ('BUILDING', 3.0::DOUBLE, 15.0::DOUBLE)) SELECT c_custkey, (1000 * coalesce(p_in, 0.15::DOUBLE) + c_custkey * coalesce(p_out, 0.6::DOUBLE)) / 1000000 AS cost_usd FROM customer LEFT JOIN p ON c_mktsegment = t""")
def cost_recompute(spark, sf_dir):
    prices = spark.createDataFrame([("AUTOMOBILE", 2.5, 10.0), ("BUILDING", 3.0, 15.0)], "t string, p_in double, p_out double")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(prices), F.col("c_mktsegment") == F.col("t"), "left")
    return rows.select("c_custkey", scalars.cost(F.lit(1000), F.col("c_custkey"), F.coalesce("p_in", F.lit(0.15)), F.coalesce("p_out", F.lit(0.6))).alias("cost_usd"))


@registered("SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def union_sources(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))


@registered("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


# Scalar functions


@registered("""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 400) || '... [truncated ' || (length(text) - 800) || ' chars] ...' || right(text, 400) END AS text FROM documents""")
def truncate_middle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.truncate_middle(F.col("text")).alias("text"))


@registered("""SELECT event_id, sha256(concat_ws('|', 'unknown_device', user_id::VARCHAR, strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'llm_interaction', event_type, event_id::VARCHAR, '0', '0', '')) AS uuid FROM events""")
def event_uuid(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", scalars.event_uuid(F.lit(None).cast("string"), F.col("user_id").cast("string"), iso, F.col("event_type"), F.col("event_id").cast("string"), F.lit(0), F.lit(0), F.lit("")).alias("uuid"))


@registered("""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\s''`&;]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 200) AS name FROM pages""")
def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.clean_id(F.col("url")).alias("name"))


@registered("""SELECT doc_id, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words, len(regexp_extract_all(text, '[.!?]+'))::BIGINT AS sentences FROM documents""")
def text_counts(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("characters"), count(r"\S+").alias("words"), count(r"[.!?]+").alias("sentences"))


_LISTED = "len(list_filter(w, lambda x: list_contains({}, x)))"
_SPAM = " + ".join(f"contains(t, '{x}')::INT" for x in scalars.SPAM)


@registered(f"""WITH w AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
c AS (SELECT doc_id, len(w)::INTEGER AS n_words, {_LISTED.format(list(scalars.POSITIVE))}::INTEGER AS positive, {_LISTED.format(list(scalars.NEGATIVE))}::INTEGER AS negative, ({_SPAM})::INTEGER AS spam FROM w),
s AS (SELECT *, (positive - negative) / greatest(n_words, 1) AS score FROM c) SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment FROM s""")
def sentiment_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", scalars.sentiment(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.*")


@registered("""SELECT c_custkey, 6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT c_custkey, pow(sin(radians(c_custkey % 90 - 10.0::DOUBLE) / 2), 2) + cos(radians(10.0::DOUBLE)) * cos(radians((c_custkey % 90)::DOUBLE)) * pow(sin(radians(c_custkey % 180 - 20.0::DOUBLE) / 2), 2) AS a FROM customer)""")
def haversine(spark, sf_dir):
    lat, lon = (F.col("c_custkey") % 90).cast("double"), (F.col("c_custkey") % 180).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.haversine_km(F.lit(10.0), F.lit(20.0), lat, lon).alias("km"))
