"""The registered queries of the detector's bookkeeping: counters, containment, overlaps, farthest points; importing the module adds
them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import expressions, scalars
from tracewright.operators import containment, farthest, intervals, progress, runs, tables, variants
from tracewright.plans.catalog import registered, table, verdicts

_SQUEEZED = r"trim(regexp_replace(replace({}.text, '\n', ' '), '\s+', ' ', 'g'))"


@registered(f"SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON {_SQUEEZED.format('b')} <> '' AND contains({_SQUEEZED.format('d')}, {_SQUEEZED.format('b')})")
def injection_happened(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return containment.containing(table(spark, sf_dir, "documents"), "doc_id", "text", items, "needle", scalars.squeezed).select("doc_id", "item_id")


@registered("""WITH c AS (SELECT 'item ' || item_id AS name, substr(text, 1, 24) AS canary FROM benchmark UNION ALL SELECT 'start ' || item_id, substr(text, 1, 5) FROM benchmark UNION ALL SELECT 'nation ' || n_nationkey, n_name FROM nation),
f AS (SELECT name, count(DISTINCT doc_id) AS n FROM c JOIN documents ON canary <> '' AND contains(text, canary) GROUP BY 1)
SELECT name, coalesce(n, 0) AS n_texts, n IS NOT NULL AS leaked FROM (SELECT DISTINCT name FROM c) LEFT JOIN f USING (name)""")
def canary_leaks(spark, sf_dir):
    """Canaries of three lengths: the first 24 and 5 characters of each benchmark item, and the nations' names, which no text holds."""
    items, nations = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "nation")
    first = lambda kind, n: items.select(F.concat(F.lit(f"{kind} "), F.col("item_id").cast("string")).alias("name"), F.substring("text", 1, n).alias("canary"))
    names = nations.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("canary"))
    return containment.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", first("item", 24).unionByName(first("start", 5)).unionByName(names), "name", "canary")


_EVENTS = "SELECT event_id, user_id, ts AS began, ts + CASE event_id % 50 WHEN 0 THEN INTERVAL 9 DAY WHEN 1 THEN INTERVAL 0 MINUTE ELSE INTERVAL 1 MINUTE * (1 + event_id % 240) END AS ended FROM events"


def _meetings(spark, sf_dir):
    """Intervals of no time, of minutes, of hours and of nine days."""
    k = F.col("event_id")
    minutes = F.when(k % 50 == 0, 9 * 24 * 60).when(k % 50 == 1, 0).otherwise(1 + k % 240)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("began"), F.timestamp_add("MINUTE", minutes.cast("int"), "ts").alias("ended"))


@registered(f"WITH e AS ({_EVENTS}) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.began < b.ended AND b.began < a.ended")
def interval_overlap(spark, sf_dir):
    return intervals.overlaps(_meetings(spark, sf_dir), "event_id", "began", "ended", "user_id")


@registered(f"""WITH e AS ({_EVENTS}) SELECT DISTINCT a.user_id, a.began::DATE AS day FROM e a JOIN e b ON a.user_id = b.user_id AND a.began::DATE = b.began::DATE AND a.event_id < b.event_id AND a.began < b.ended AND b.began < a.ended""")
def day_conflicts(spark, sf_dir):
    return intervals.conflicts(_meetings(spark, sf_dir), "event_id", "began", "ended", F.to_date("began"), "user_id")


_VERDICTS = """SELECT doc_id, regexp_matches(lower(text), 'idiot|moron|scum|worthless|pathetic') AS predicted, toxic = 1 AS actual, n_chars > 1000 AS escalated FROM documents LEFT JOIN labels USING (doc_id)"""


@registered(f"""WITH r AS ({_VERDICTS}), s AS (SELECT *, predicted IS NOT NULL AND actual IS NOT NULL AS scored FROM r),
c AS (SELECT doc_id, count(*) FILTER (predicted AND actual) OVER w AS tp, count(*) FILTER (NOT predicted AND NOT actual) OVER w AS tn, count(*) FILTER (predicted AND NOT actual) OVER w AS fp, count(*) FILTER (NOT predicted AND actual) OVER w AS fn,
  count(*) FILTER (scored AND escalated) OVER w AS escalated, count(*) FILTER (NOT scored) OVER w AS dropped, count(*) OVER w AS completed FROM s WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT *, coalesce((tp + tn) * 100 / nullif(completed - dropped, 0), 0.0::DOUBLE) AS accuracy, coalesce(escalated * 100 / nullif(completed - dropped, 0), 0.0::DOUBLE) AS escalated_share FROM c""")
def progress_counters(spark, sf_dir):
    found, labels = verdicts(spark, sf_dir)
    rows = found.join(labels, "doc_id", "left").select("doc_id", "predicted", "actual", (F.col("latency") > 1000).alias("long"))
    out = progress.progress(rows, ["doc_id"], F.col("predicted"), F.col("actual"), F.col("long"))
    return out.drop("predicted", "actual", "long")


@registered("""WITH p AS (SELECT c_custkey, c_custkey * 37 % 1201 / 10 - 60.0::DOUBLE AS lat, c_custkey * 101 % 2903 / 10 - 145.0::DOUBLE AS lon FROM customer),
h AS (SELECT a.c_custkey AS a, b.c_custkey AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS x FROM p a JOIN p b ON a.c_custkey < b.c_custkey),
m AS (SELECT arg_max([a, b], x) AS ab, 6371.0::DOUBLE * 2 * atan2(sqrt(max(x)), sqrt(1 - max(x))) AS km FROM h) SELECT ab[1] AS a, ab[2] AS b, round(km, 6) AS km, (SELECT count(*) FROM (SELECT DISTINCT lat, lon FROM p)) AS n_points FROM m""")
def farthest_pair(spark, sf_dir):
    key = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select("c_custkey", (key * 37 % 1201 / 10 - 60.0).alias("lat"), (key * 101 % 2903 / 10 - 145.0).alias("lon"))
    return farthest.farthest(places, "c_custkey", "lat", "lon").select("a", "b", F.round("km", 6).alias("km"), "n_points")


# Nested values


_SHAPE = '{"marks": ["string"], "money": "number", "who": {"name": "string", "segment": "prompt"}}'


def _nested(spark, sf_dir):
    """A nested value of each customer; some lack a key, or have a list where an object should be."""
    key = F.col("c_custkey")
    who = F.when(key % 5 == 0, F.to_json(F.struct(F.col("c_name").alias("name")))).when(key % 7 == 0, F.to_json(F.array("c_name"))).otherwise(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))))
    marks = F.to_json(F.when(key % 3 == 0, F.array("c_mktsegment")).otherwise(F.array("c_mktsegment", "c_name")))
    text = F.concat(F.lit('{"who":'), who, F.lit(',"marks":'), marks, F.lit(',"extra":1,"money":'), key.cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit("customer").alias("query"), F.parse_json(text).alias("value"))
    return rows, spark.range(1).select(F.lit("customer").alias("query"), F.parse_json(F.lit(_SHAPE)).alias("shape"))


@registered("SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS valid FROM customer")
def validated_values(spark, sf_dir):
    rows, queries = _nested(spark, sf_dir)
    return variants.validated(rows, "c_custkey", "value", "query", queries, "shape")


@registered("""WITH v AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0),
l AS (SELECT c_nationkey, c_custkey, unnest(list_concat(CASE WHEN c_custkey % 3 = 0 THEN [{'format': 'string', 'value': c_mktsegment, 'quoted': true}] ELSE [{'format': 'string', 'value': c_mktsegment, 'quoted': true}, {'format': 'string', 'value': c_name, 'quoted': true}] END,
  [{'format': 'number', 'value': c_custkey::VARCHAR, 'quoted': false}, {'format': 'string', 'value': c_name, 'quoted': true}])) AS x, generate_subscripts(list_concat(CASE WHEN c_custkey % 3 = 0 THEN [1] ELSE [1, 2] END, [3, 4]), 1) AS place FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, place) - 1 AS number FROM l)
SELECT c_nationkey, number, '#DATA' || number AS token, x.format AS format, CASE WHEN x.quoted THEN '"' || x.value || '"' ELSE x.value END AS value, c_custkey FROM n""")
def sealed_values(spark, sf_dir):
    """The tokens of all valid values; a run is a nation."""
    rows, queries = _nested(spark, sf_dir)
    valid = rows.where((F.col("c_custkey") % 5 != 0) & (F.col("c_custkey") % 7 != 0)).withColumn("at", F.col("c_custkey"))
    return variants.sealed(valid, "c_custkey", "c_nationkey", "at", "value", "query", queries, "shape")[1]


@registered("""SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""")
def prompt_values(spark, sf_dir):
    rows, queries = _nested(spark, sf_dir)
    found = variants.prompt_values(rows, "c_custkey", "value", "query", queries, "shape")
    return found.select("c_custkey", F.replace("value", F.lit('"'), F.lit("")).alias("segment"))


# Expressions


@registered("""WITH c AS (SELECT c_custkey, c_custkey % 7::DOUBLE AS k, c_acctbal::DOUBLE AS b FROM customer),
f AS (SELECT *, CASE WHEN k - 3 = 0 THEN 'division by zero' WHEN b < 0 THEN 'below zero' END AS fault FROM c)
SELECT c_custkey, fault, CASE WHEN fault IS NULL THEN round(-(k ** 2) / (k - 3) + sqrt(b) * 2 ** -1 - ((b - k) - 5 * floor((b - k) / 5)) + floor(b / 7) + log10(k + 1), 6) END AS result FROM f""")
def expression_values(spark, sf_dir):
    names = {"k": F.col("c_custkey") % 7, "b": F.col("c_acctbal")}
    v = expressions.compiled("-k ** 2 / (k - 3) + sqrt(b) * 2 ** -1 - (b - k) % 5 + b // 7 + log(k + 1, 10)", names)
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", "v.fault", F.round("v.result", 6).alias("result"))


# Calls and runs


@registered("""WITH m AS (SELECT user_id, ts::DATE AS day, CASE WHEN (day(ts::DATE) % 5) = 0 THEN NULL ELSE list_sort(list_distinct(list(event_type))) END AS calls FROM events GROUP BY 1, 2, day(ts::DATE)),
p AS (SELECT *, sum((calls IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY day) AS part FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, part, calls ORDER BY day) AS nth FROM p WHERE calls IS NOT NULL) SELECT user_id, day FROM n WHERE nth > 2""")
def repeated_call_sets(spark, sf_dir):
    """A user's day is a message, its kinds of events the calls; every fifth day has none."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("calls"))
    said = days.withColumn("calls", F.when(F.dayofmonth("day") % 5 != 0, F.col("calls")))
    return tables.repeated_sets(said, "user_id", "day", "calls").select("user_id", "day")


@registered("""WITH i AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS n FROM part WHERE p_size > 40)
SELECT c_custkey, p_partkey FROM customer JOIN i ON place = ('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT % n""")
def chosen_injections(spark, sf_dir):
    return runs.chosen(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey"), "p_partkey", 42)


@registered("""WITH c AS (SELECT event_id, 'toolu_' || event_id AS id, user_id FROM events), e AS (SELECT 'failed: {''tool_use_id'': ''toolu_' || event_id || ''', ''x'': 1}, ''tool_use_id'': ''other''' AS said FROM events WHERE value < 10)
SELECT event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE regexp_extract(said, '''tool_use_id'': ''([^'']+)''', 1) = c.id)""")
def calls_without_failed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    calls = events.select("event_id", F.concat(F.lit("toolu_"), F.col("event_id").cast("string")).alias("id"))
    told = events.where("value < 10").select(F.concat(F.lit("failed: {'tool_use_id': 'toolu_"), F.col("event_id").cast("string"), F.lit("', 'x': 1}, 'tool_use_id': 'other'")).alias("said"))
    return runs.without_failed(calls, "id", told, "said").select("event_id")


@registered("""SELECT o_orderstatus AS suite, count(*) AS n_reports, sum(o_totalprice::DOUBLE)::BIGINT AS total, max(o_orderkey) AS last_report FROM orders GROUP BY 1""")
def reports_by_suite(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("size", F.col("o_totalprice").cast("double"))
    return runs.by_suite(rows, "o_orderstatus", "o_orderkey", "size").select(F.col("o_orderstatus").alias("suite"), "n_reports", F.round("total").cast("long").alias("total"), "last_report")


def _in_text(listed: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(t, '{x}')::INT" for x in listed) + ")"


@registered(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM d),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: list_contains({list(scalars.PROFANE)}, x)))::INT AS profanity, {_in_text(scalars.VIOLENT)}::INT AS violence, {_in_text(scalars.HARASSING)}::INT AS harassment, {_in_text(scalars.SPAM)}::INT AS spam FROM w),
s AS (SELECT *, greatest(0, 1 - (profanity + violence + harassment + spam) / greatest(n, 1) * 10) AS safety_score FROM c)
SELECT doc_id, profanity, violence, harassment, spam, safety_score, CASE WHEN safety_score >= 0.8 THEN 'safe' WHEN safety_score >= 0.5 THEN 'review_needed' WHEN safety_score >= 0.2 THEN 'unsafe' ELSE 'blocked' END AS safety_level FROM s""")
def moderated(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", scalars.moderation(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.*").drop("categories")
