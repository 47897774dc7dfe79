"""Sources, triage text and streaming on small fixtures; every registered query against its SQL."""

import json
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.operators import detection
from tracewright.plans import catalog, detectors, knowledge, runs, tools  # noqa: F401
from tracewright.sources import logs, pack
from tracewright.sources.sqlite import SqliteSource

SF = "/root/testdata/sf0.001"


def test_claude_log(spark, tmp_path):
    rows = [
        {"type": "user", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"content": "hello"}},
        {"type": "assistant", "sessionId": "s1", "timestamp": "2024-01-01T00:00:01Z", "message": {"model": "m", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "write_file", "input": {"path": "a"}}]}},
        {"type": "user", "sessionId": "s1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}},
        {"type": "user", "message": {"content": "no session"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n\n")
    got = logs.read(spark, {"claude": str(tmp_path)})
    assert [(r.session_id, r.seq, r.role, r.content) for r in got.orderBy("seq").collect()] == [("claude_s1", 0, "user", "hello"), ("claude_s1", 1, "assistant", "ok"), ("claude_s1", 2, "user", "")]
    call = logs.tool_calls(got).collect()
    assert [(c.name, json.loads(c.arguments), c.result, c.status) for c in call] == [("write_file", {"path": "a"}, "done", "success")]


def test_codex_log(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "payload": p}
    rows = [{"type": "session_meta", "payload": {"id": "x", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/c"}}, item(type="message", role="user", content=[{"type": "input_text", "text": "go"}]), item(type="function_call", call_id="1", name="exec", arguments="{}"), item(type="function_call_output", call_id="1", output="fine"), item(type="function_call", call_id="2", name="exec", arguments="{}")]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    calls = logs.tool_calls(logs.codex(spark, str(tmp_path))).orderBy("id").collect()
    assert [(c.session_id, c.id, c.result, c.status) for c in calls] == [("codex_x", "1", "fine", "success"), ("codex_x", "2", None, "pending")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE kv (key TEXT, value BLOB)")
        db.executemany("INSERT INTO kv VALUES (?, ?)", [(f"bubbleId:{k}", b"v%d" % k) for k in range(20)] + [("other", None)])
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite").option("path", path).option("table", "kv")
    assert rows.load().count() == 21
    assert {r.value for r in rows.option("prefix_column", "key").option("prefix", "bubbleId:").load().collect()} == {f"v{k}" for k in range(20)}


def test_pack_round_trip(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", '[{"role":"user"}]', '{"ok":true}'), ("t2", "[]", "{}")], "task_id string, conversation string, result string")
    pack.pack(tasks, "b").orderBy("ord").select("value").coalesce(1).write.text(str(tmp_path / "p"))
    assert sorted(map(tuple, pack.inflate(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, tasks.collect()))


@pytest.mark.parametrize(("text", "want"), [("Benign\nConfidence: 90%", (False, 0.9)), ("SUSPICIOUS\n**Confidence:** 0.7.", (True, 0.7)), ("It is benign.\nmy confidence: rather 0.2, hard to tell", (False, 0.8)), ("", (True, 0.8)), ("benign\nconfidence: 150", (False, 0.8))])
def test_triage(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(detection.triage(F.col("t")).alias("r")).first().r
    assert (r.is_suspicious, pytest.approx(r.confidence)) == want


def test_queries(spark):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    show = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    for name, text in catalog.oracle_sql().items():
        got = catalog.queries()[name](spark, SF)
        names = sorted(got.columns)
        want = con.sql(text).select(*[f'"{n}"' for n in names]).fetchall()
        assert sorted(tuple(map(show, r)) for r in got.select(*names).collect()) == sorted(tuple(map(show, r)) for r in want), name
