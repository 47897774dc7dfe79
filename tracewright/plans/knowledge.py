"""The registered queries of searches, monitoring and sinks; importing the module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import knowledge, monitoring
from tracewright.plans.catalog import registered, table
from tracewright.sources import export

# Search


@registered("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def category_filter(spark, sf_dir):
    return knowledge.in_categories(table(spark, sf_dir, "customer"), "c_mktsegment", ("Building", "machinery"), exact=False).select("c_custkey")


@registered("SELECT p_partkey FROM part WHERE contains(lower(coalesce(p_name, '') || ' ' || coalesce(p_type, '')), 'ring') OR contains(lower(coalesce(p_name, '') || ' ' || coalesce(p_type, '')), 'economy')")
def keyword_search(spark, sf_dir):
    return knowledge.any_keyword(table(spark, sf_dir, "part"), ("p_name", "p_type"), ("RING", "economy")).select("p_partkey")


@registered("""WITH k AS (SELECT r_regionkey, replace(r_name, ' ', '_') AS name FROM region), w AS (SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 7 = 0 THEN 'NO-WHERE' WHEN n_nationkey % 2 = 0 THEN replace(name, '_', '-') ELSE name END, '?') AS wanted FROM nation LEFT JOIN k ON n_regionkey = r_regionkey)
SELECT n_nationkey, coalesce(a.r_regionkey, b.r_regionkey) AS r_regionkey, CASE WHEN a.name IS NULL AND b.name IS NULL THEN 'not_found' ELSE 'found' END AS status, CASE WHEN a.name IS NULL AND b.name IS NULL THEN (SELECT string_agg(name, ',' ORDER BY name) FROM k) END AS available
FROM w LEFT JOIN k a ON a.name = wanted LEFT JOIN k b ON b.name = replace(wanted, '-', '_')""")
def server_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "region").select("r_regionkey", F.replace("r_name", F.lit(" "), F.lit("_")).alias("name"))
    nations = table(spark, sf_dir, "nation").join(F.broadcast(known), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    wanted = F.when(F.col("n_nationkey") % 7 == 0, "NO-WHERE").when(F.col("n_nationkey") % 2 == 0, F.replace("name", F.lit("_"), F.lit("-"))).otherwise(F.col("name"))
    rows = knowledge.looked_up(nations.select("n_nationkey", F.coalesce(wanted, F.lit("?")).alias("wanted")), "wanted", known, "name")
    return rows.select("n_nationkey", F.col("match.r_regionkey").alias("r_regionkey"), "status", F.array_join("available", ",").alias("available"))


@registered("SELECT coalesce(r_name, 'uncategorized') AS category, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 0) ON n_regionkey = r_regionkey GROUP BY 1")
def risk_map(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where("r_regionkey <> 0")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return knowledge.risk_map(nations, "r_name", "n_name").withColumn("names", F.array_join("names", ","))


@registered("""WITH a AS (SELECT doc_id, [lang, source, 'Transparent'] AS a FROM documents), p AS (SELECT doc_id, [CASE WHEN x = 'Transparent' THEN 1 WHEN x IS NOT NULL AND (x IN ('en', 'de') OR x GLOB 'src*') AND NOT x GLOB 'src[0-3]' THEN 2 ELSE 0 END FOR x IN a] AS p FROM a)
SELECT doc_id, CASE WHEN list_min(p) = 2 THEN 'Trusted' WHEN list_min(p) >= 1 THEN 'Transparent' ELSE 'Untrusted' END AS principal FROM p""")
def attribute_principal(spark, sf_dir):
    attributes = F.concat_ws(";", F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?")), F.lit("Transparent"))
    return table(spark, sf_dir, "documents").select("doc_id", knowledge.principal(attributes, ("en", "d?", "src*"), ("src[0-3]",)).alias("principal"))


@registered("SELECT event_id FROM events WHERE user_id BETWEEN 1 AND 3 OR user_id = 7 OR user_id BETWEEN 20 AND 21")
def task_range(spark, sf_dir):
    return knowledge.in_ranges(table(spark, sf_dir, "events"), "user_id", "1-3,7,20-21").select("event_id")


@registered("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM l),
f AS (SELECT doc_id, line, 'digits' AS kind, len(regexp_extract_all(t, '[0-9]{4,}')) AS n FROM e UNION ALL SELECT doc_id, line, 'insult', len(regexp_extract_all(t, '(?i)idiot|moron')) FROM e) SELECT doc_id, line::INTEGER AS line, kind, n::INTEGER AS n_found FROM f WHERE n > 0""")
def pattern_scan(spark, sf_dir):
    return knowledge.scanned(table(spark, sf_dir, "documents"), "doc_id", "text", {"digits": "[0-9]{4,}", "insult": "idiot|moron"})


@registered("""WITH r AS (SELECT c_custkey, c_custkey % 3 AS a, c_custkey % 2 AS b, CASE WHEN c_custkey % 5 = 0 THEN 'saw ' || c_mktsegment || ' in a call' END AS w, c_mktsegment AS v FROM customer)
SELECT c_custkey, NOT coalesce(contains(w, v), false) AND a <> b AS got_through FROM r""")
def data_injection(spark, sf_dir):
    key = F.col("c_custkey")
    warned = F.when(key % 5 == 0, F.array(F.concat(F.lit("saw "), "c_mktsegment", F.lit(" in a call"))))
    runs = table(spark, sf_dir, "customer").select(key, F.struct((key % 3).alias("x")).alias("first"), F.struct((key % 2).alias("x")).alias("second"), warned.alias("w"), "c_mktsegment")
    return runs.select(key, knowledge.data_injection(runs, "first", "second", "w", "c_mktsegment").alias("got_through"))


# Monitoring


@registered("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_running, avg(value) AS mean_load FROM events)
SELECT *, CASE WHEN n_running / n > 0.8 THEN 'healthy' ELSE 'degraded' END AS status, CASE WHEN mean_load < 30 THEN 'low' WHEN mean_load < 70 THEN 'medium' ELSE 'high' END AS band FROM c""")
def cluster_health(spark, sf_dir):
    return monitoring.cluster_health(table(spark, sf_dir, "events"), F.col("event_type") != "error", "value")


@registered("SELECT event_id, CASE WHEN value >= 40 THEN 'critical' WHEN value >= 25 THEN 'high' ELSE 'low' END AS alert FROM events WHERE value >= 25 OR value <= 1")
def alert_ladder(spark, sf_dir):
    return monitoring.alerts(table(spark, sf_dir, "events"), "value", 40, 25, 1).select("event_id", "alert")


@registered("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return monitoring.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P"), "o_orderpriority")


@registered("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size BETWEEN 5 AND 20")
def criteria_filter(spark, sf_dir):
    return monitoring.matching(table(spark, sf_dir, "part"), p_brand="Brand#2", p_size=(5, 20), p_type=None).select("p_partkey")


@registered("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)")
def unknown_members(spark, sf_dir):
    registry = table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    return monitoring.unknown_members(table(spark, sf_dir, "customer"), "c_nationkey", registry, "n_nationkey").select("c_custkey")


@registered("SELECT event_type, count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS n_recent FROM events GROUP BY 1")
def recent_activity(spark, sf_dir):
    return monitoring.recent(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), "7 DAY", "event_type")


@registered("SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM (SELECT length(html) AS size FROM pages WHERE starts_with(url, 'http://') ORDER BY url, page_id LIMIT 20)")
def prefix_listing(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.struct("url", "page_id").alias("at"), "url", F.length("html").alias("size"))
    return monitoring.listing(pages.withColumn("name", F.concat("url", F.lit(" "), F.lpad(F.col("at.page_id").cast("string"), 20, "0"))), "name", "size", "http://", 20)


@registered("SELECT event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean, arg_min(event_id, (-value, event_id)) AS best FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def engagement_summary(spark, sf_dir):
    return monitoring.engagement(table(spark, sf_dir, "events"), "event_id", "value", "ts", "2024-01-10", "event_type")


@registered("""WITH m AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN -value ELSE value END AS q FROM events)
SELECT user_id, sum(abs(q)) AS out_total, count(DISTINCT ts::DATE) AS n_days, sum(abs(q)) / count(DISTINCT ts::DATE) AS per_day FROM m WHERE q < 0 GROUP BY 1""")
def demand_base(spark, sf_dir):
    moves = table(spark, sf_dir, "events").withColumn("q", F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")))
    return monitoring.daily_demand(moves, "q", "ts", "user_id")


@registered("""WITH l AS (SELECT o_orderkey, unnest([o_orderkey % 2500, o_custkey]) AS id FROM orders) SELECT o_orderkey, count(p_partkey) AS n_items, count(*) - count(p_partkey) AS n_missing, coalesce(sum(p_retailprice), 0) AS total FROM l LEFT JOIN part ON id = p_partkey GROUP BY 1""")
def listed_total(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 2500, "o_custkey").alias("ids"))
    return monitoring.listed_total(lists, "o_orderkey", "ids", table(spark, sf_dir, "part"), "p_partkey", "p_retailprice")


@registered("""WITH p AS (SELECT (c_custkey % 100 - 5)::DOUBLE AS lat, (c_custkey % 200 - 10)::DOUBLE AS lon FROM customer), v AS (SELECT * FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
s AS (SELECT count(*) AS n, avg(lat) AS centre_lat, avg(lon) AS centre_lon, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon, max(lat) - min(lat) AS lat_span, max(lon) - min(lon) AS lon_span FROM v),
a AS (SELECT pow(sin(radians(lat - centre_lat) / 2), 2) + cos(radians(centre_lat)) * cos(radians(lat)) * pow(sin(radians(lon - centre_lon) / 2), 2) AS a FROM v, s), d AS (SELECT 6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM a)
SELECT s.*, (SELECT avg(km) FROM d) AS mean_km, (SELECT max(km) FROM d) AS max_km FROM s""")
def geo_summary(spark, sf_dir):
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select((key % 100 - 5).cast("double").alias("lat"), (key % 200 - 10).cast("double").alias("lon"))
    return monitoring.geo_summary(points, "lat", "lon")


@registered("WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS mean FROM customer GROUP BY 1), r AS (SELECT *, percent_rank() OVER (ORDER BY mean) AS percent_rank FROM m) SELECT *, percent_rank >= 0.75 AS top_quarter FROM r")
def peer_benchmark(spark, sf_dir):
    return monitoring.peer_benchmark(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@registered("WITH c AS (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL) SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY lang) AS percent FROM c")
def answer_distribution(spark, sf_dir):
    return monitoring.distribution(table(spark, sf_dir, "documents"), "lang", "source")


# Sinks


@registered("""WITH n AS (SELECT event_id, 'adr.' || event_type || CASE WHEN event_id % 4 = 0 THEN '.20241301_000000' ELSE strftime(ts, '.%Y%m%d_%H%M%S') END || CASE WHEN event_id % 5 = 0 THEN '.txt' ELSE '.json' END AS name FROM events)
SELECT event_id, name, CASE WHEN event_id % 5 <> 0 THEN try_strptime(regexp_extract(name, '\\.([0-9]{8}_[0-9]{6})\\.json$', 1), '%Y%m%d_%H%M%S') END AS ts FROM n""")
def file_times(spark, sf_dir):
    key = F.col("event_id")
    time = F.when(key % 4 == 0, "20241301_000000").otherwise(export.file_time(F.col("ts")))
    named = table(spark, sf_dir, "events").select(key, F.concat(F.lit("adr."), "event_type", F.lit("."), time, F.when(key % 5 == 0, ".txt").otherwise(".json")).alias("name"))
    return named.select("event_id", "name", export.time_of_file(F.col("name")).cast("timestamp_ntz").alias("ts"))


@registered("""WITH m AS (SELECT conv_id, string_agg('{"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, sha256('{"chat_history":[' || m || '],"session_id":"' || conv_id || '","source":"chat"}') AS hash FROM m""")
def content_hashes(spark, sf_dir):
    message = F.struct("turn", "role", F.length("text").alias("chars"))
    folded = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    history = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["chars"].alias("chars")))
    return folded.select("conv_id", export.content_hash(F.lit("chat"), F.col("conv_id").cast("string"), history).alias("hash"))


@registered("SELECT s_suppkey, sha256(concat_ws('|', s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'unknown_user' ELSE 'u' || s_nationkey END, 'system_configuration', s_nationkey::VARCHAR)) AS uuid FROM supplier")
def config_uuids(spark, sf_dir):
    user = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("u"), F.col("s_nationkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", export.config_uuid(F.col("s_name"), F.lit("system_configuration"), F.col("s_nationkey"), user=user).alias("uuid"))


@registered("""SELECT '{"event_id":' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"event_type":"' || event_type || '"' END || ',"user_id":' || user_id || '}' AS value FROM events""")
def pruned_lines(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "  \n").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\t")))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("event_type"), "user_id", F.lit(None).cast("string").alias("gone"))
    return rows.select(export.pruned(rows).alias("value"))
