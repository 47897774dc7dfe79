"""Runs, YAML with includes and SQLite, by round trips on files of their own."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewright.operators import knowledge, runs
from tracewright.sources import runs as found_runs
from tracewright.sources import sqlite, sqlite_sink, yaml_tree

# Runs


def log(folder, name, **value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value) if value else "{broken")


SAID = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes", "tool_calls": None}]


@pytest.fixture
def logs(tmp_path):
    for k in range(25):
        log(tmp_path, f"suite/user_task_{k:02}/a/injection_task_{k % 3}.json", suite_name="s", user_task_id=f"user_task_{k}", injection_task_id="i", security=k % 2 == 0, utility=True, messages=[] if k % 5 == 0 else SAID)
    log(tmp_path, "suite/user_task_30/a/injection_task_0.json", suite_name="s", messages=SAID)
    log(tmp_path, "suite/user_task_31/a/injection_task_0.json")
    log(tmp_path, "suite/user_task_32/a/injection_task_0.json", suite_name="s")
    return tmp_path


@pytest.mark.parametrize("shuffles", ["1", "7"])
def test_logs_are_numbered_without_gaps(spark, logs, shuffles):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        got = found_runs.numbered(spark, str(logs)).orderBy("number").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    with_talk = [k for k in range(25) if k % 5] + [30]
    assert [r.file.split("user_task_")[1][:2] for r in got] == [f"{k:02}" for k in with_talk]
    assert [(r.number, r.task_id) for r in got] == [(n, f"task_{n:03}") for n in range(1, 22)]
    assert [r.is_malicious for r in got] == [k % 2 == 0 for k in with_talk[:-1]] + [True] and got[-1].utility is False


def test_conversations_of_numbered_logs(spark, logs):
    rows = found_runs.conversations(spark, str(logs)).collect()
    assert len(rows) == 42 and {r.task_id for r in rows} == {f"task_{n:03}" for n in range(1, 22)}


def test_newest_run_and_its_layout(spark, tmp_path):
    for name in ("bench_20240101", "bench_20240301", "other_20250101", "bench_20240201"):
        log(tmp_path, f"{name}/task_001/x.json", a=1)
    (tmp_path / "bench_20990101").mkdir()
    (tmp_path / "bench_21000101").write_text("no folder")
    assert found_runs.newest(spark, str(tmp_path), "bench_") == "bench_20240301"
    with pytest.raises(FileNotFoundError, match="nothing_"):
        found_runs.newest(spark, str(tmp_path), "nothing_")
    assert found_runs.checked(spark, str(tmp_path), "bench_20240301", False).endswith("bench_20240301")
    with pytest.raises(found_runs.LayoutError, match="lacks"):
        found_runs.checked(spark, str(tmp_path), "bench_20240301", True)
    log(tmp_path, "bench_20240301/ground_truth.json", a=1)
    log(tmp_path, "bench_20240201/task_001/ground_truth.json", a=1)
    found_runs.checked(spark, str(tmp_path), "bench_20240301", True)
    found_runs.checked(spark, str(tmp_path), "bench_20240201", False)
    with pytest.raises(found_runs.LayoutError, match="should not"):
        found_runs.checked(spark, str(tmp_path), "bench_20240301", False)


def test_ground_truth_is_mandatory(spark):
    truth = spark.createDataFrame([("a", True), ("b", False)], "task string, bad boolean")
    verdicts = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "task string, n int")
    assert sorted((r.n, r.bad) for r in found_runs.with_ground_truth(verdicts, truth, "task", "bad").collect()) == [(1, True), (2, False), (3, True)]
    with pytest.raises(Exception, match="no ground truth for c"):
        found_runs.with_ground_truth(verdicts.unionByName(spark.createDataFrame([("c", 4)], "task string, n int")), truth, "task", "bad").collect()


def test_small_rules_of_runs(spark):
    df = spark.createDataFrame([("a b/c:ü.-_", "went wrong {'tool_use_id': 't1', 'tool_use_id': 't2'}", "det-wotriage-wopolicy"), ("", "no id", "det"), (None, None, None), ("x" * 300, "'tool_use_id': ''", "a-woeas-wosourcecode-wopolicy-wotriage")], "task string, error string, name string")
    got = df.select(runs.safe_path(F.col("task")).alias("p"), runs.failed_id(F.col("error")).alias("i"), runs.configuration(F.col("name")).alias("c")).collect()
    assert [r.p for r in got] == ["a_b_c_ü.-_", "unknown", "unknown", "x" * 128] and [r.i for r in got] == ["t1", None, None, None]
    assert [tuple(r.c) for r in got] == [(True, True, False, False), (True, True, True, True), (None,) * 4, (False,) * 4]
    assert runs.run_name("det", triage=False, threats=False) == "det-woeas-wotriage" and runs.run_name("det") == "det"
    texts = spark.range(1).select(runs.filled("{b} {a} {b}", {"a": F.lit("x"), "b": F.lit("y")}).alias("t"), runs.filled("{b}", {"b": F.lit(None).cast("string")}).alias("n"), runs.filled("plain", {"a": F.lit("x")}).alias("p")).first()
    assert tuple(texts) == ("{b} x {b}", "{b}", "plain")


# YAML


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_yaml", ".yaml").replace("_json", ".json").replace("_txt", ".txt")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_includes(spark, tmp_path):
    write(tmp_path, main_yaml="items:\n  - !include parts/one.yaml\n  - {name: two, text: !include parts/note.txt, data: !include parts/data.json}\n  - 3\n", parts__one_yaml="{name: one, again: !include data.json}", parts__data_json='{"é": [1, null]}', parts__note_txt="a: b\nc")
    rows = yaml_tree.read(spark, str(tmp_path / "main.yaml"), "items").orderBy("pos").collect()
    assert [json.loads(r.item) for r in rows] == [{"name": "one", "again": {"é": [1, None]}}, {"name": "two", "text": "a: b\nc", "data": {"é": [1, None]}}, 3]
    assert [(r.key, r.pos) for r in rows] == [(None, 0), (None, 1), (None, 2)]
    assert yaml_tree.read(spark, str(tmp_path), "no.such").collect() == []
    assert {r.file.rsplit("/", 1)[1] for r in yaml_tree.read(spark, str(tmp_path)).collect()} == {"main.yaml", "one.yaml"}


@pytest.mark.parametrize(("text", "fault"), [("a: !include main.yaml", "includes"), ("a: !include loop.yaml", "includes"), ("a: !include ../secret.yaml", "outside"), ("a: !include /etc/hostname", "outside"), ("a: !include gone.yaml", "does not exist"), ("a: !!python/object/apply:os.getcwd []", "constructor")])
def test_faulty_includes(spark, tmp_path, text, fault):
    write(tmp_path, root__main_yaml=text, root__loop_yaml="b: !include main.yaml", secret_yaml="x: 1")
    with pytest.raises(Exception, match=fault):
        yaml_tree.read(spark, str(tmp_path / "root" / "main.yaml")).collect()


def test_stores(spark, tmp_path):
    write(
        tmp_path,
        policies_yaml='policies:\n  - {name: P1, description: keys, category: crypto, policy: "Rotate keys", risk_areas: [keys, time]}\n  - {name: P2, category: access, policy: Passwords}\n',
        threats_yaml="threat_framework:\n  tactics:\n    first:\n      description: d\n      techniques:\n        - {id: T1, name: n1, description: x, detection_guidance: [g1, g2]}\n        - {id: T2, name: n2}\n    empty: {description: e}\n",
        servers_yaml="mcp_servers:\n  - {name: my_server, path: a/b.py, category: dev, description: d, capabilities: [f, g]}\n",
    )
    policies = yaml_tree.policies(spark, str(tmp_path / "policies.yaml"))
    assert [(r.name, r.risk_areas) for r in policies.orderBy("name").collect()] == [("P1", ["keys", "time"]), ("P2", None)]
    assert [r.name for r in knowledge.any_keyword(policies, ("name", "description", "policy"), ("ROTATE",)).collect()] == ["P1"]
    assert [(r.tactic, r.id, r.guidance) for r in yaml_tree.techniques(spark, str(tmp_path / "threats.yaml")).orderBy("id").collect()] == [("first", "T1", ["g1", "g2"]), ("first", "T2", None)]
    servers = yaml_tree.servers(spark, str(tmp_path / "servers.yaml"))
    wanted = spark.createDataFrame([("my-server",), ("none",)], "wanted string")
    assert {r.wanted: r.status for r in knowledge.looked_up(wanted, "wanted", servers, "name").collect()} == {"my-server": "found", "none": "not_found"}


# SQLite


def content(path, table="t"):
    with sqlite3.connect(path) as db:
        return sorted(db.execute(f"SELECT * FROM {table}").fetchall(), key=str)


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.db")
    rows = spark.createDataFrame([(1, "a", 1.5, True, bytearray(b"\x00\xff"), [1]), (2, None, None, None, None, None)], "id long, name string, v double, ok boolean, raw binary, xs array<int>")
    sqlite_sink.write(rows.repartition(3), path, "t", primary_key=["id"])
    assert content(path) == [(1, "a", 1.5, 1, b"\x00\xff", "[1]"), (2, None, None, None, None, None)]
    more = spark.range(10, 2510).select(F.col("id"), F.lit("b").alias("name"))
    sqlite_sink.write(more.repartition(4), path, "t")
    spark.dataSource.register(sqlite.SqliteSource)
    back = spark.read.format("sqlite").option("path", path).option("table", "t").load()
    assert back.count() == 2502 and back.where("name = 'b'").count() == 2500
    assert sqlite_sink.delete(path, "t", [("id", ">=", 10), ("id", "<", 2500), ("name", "=", "b")]) == 2490
    assert sqlite_sink.delete(path, "t", [("name", "=", "' OR 1=1 --")]) == 0
    sqlite_sink.write(rows.where("id = 1").select("id", "name"), path, "t", mode="overwrite")
    assert content(path) == [(1, "a", None, None, None, None)]
    assert sqlite_sink.clear(path, "t") == 1 and content(path) == []
    assert os.listdir(tmp_path) == ["x.db"]


def test_failed_writes_leave_the_file_as_it_was(spark, tmp_path):
    path = str(tmp_path / "x.db")
    sqlite_sink.write(spark.createDataFrame([(1, "a")], "id long, name string"), path, "t", primary_key=["id"])
    before = open(path, "rb").read()
    failing = spark.range(40).repartition(4).select("id", F.when(F.col("id") == 39, F.raise_error(F.lit("broken task"))).otherwise(F.lit("x")).alias("name"))
    with pytest.raises(Exception, match="broken task"):
        sqlite_sink.write(failing, path, "t", mode="overwrite")
    assert open(path, "rb").read() == before and content(path) == [(1, "a")]
    with pytest.raises(Exception, match="UNIQUE"):  # the commit itself fails after some rows
        sqlite_sink.write(spark.createDataFrame([(7, "new"), (1, "again")], "id long, name string"), path, "t")
    assert content(path) == [(1, "a")] and os.listdir(tmp_path) == ["x.db"]


def test_names_and_conditions_are_plain(spark, tmp_path):
    path = str(tmp_path / "x.db")
    sqlite_sink.create(path, "t", {"a": "INTEGER"})
    sqlite_sink.create(path, "t", {"a": "INTEGER"})
    for bad in (lambda: sqlite_sink.delete(path, "t", []), lambda: sqlite_sink.delete(path, "t", [("a", "LIKE", 1)]), lambda: sqlite_sink.delete(path, "t; DROP", [("a", "=", 1)]), lambda: sqlite_sink.create(path, "u", {"a": "INTEGER); --"}), lambda: sqlite_sink.write(spark.range(1).toDF("a b"), path, "t")):
        with pytest.raises(ValueError):
            bad()


# Tasks, results and logs


def test_tasks_and_labels(spark, tmp_path):
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": [{"task_id": 1, "ground_truth": "malicious", "mcp_servers": ["a"], "threat_tactic": "t"}, {"task_id": 12, "user_prompt": "p"}, {"task_id": 1234, "ground_truth": "benign"}, {"ground_truth": "malicious"}]}, indent=1))
    got = {r.task_id: (r.is_malicious, r.prompt, r.servers, r.tactic) for r in found_runs.listed_tasks(spark, str(tmp_path / "tasks.json")).collect()}
    assert got == {"task_001": (True, None, ["a"], "t"), "task_012": (False, "p", None, None), "task_1234": (False, None, None, None)}
    (tmp_path / "ground_truth.json").write_text(json.dumps({"task_3": {"is_malicious": True, "suite": "s"}, "task_0044_x": {"is_malicious": False}, "meta": {"is_malicious": True}, "task_5": {}}))
    assert {r.task_id: r.is_malicious for r in found_runs.labels(spark, str(tmp_path / "ground_truth.json")).collect()} == {"task_003": True, "task_044": False, "task_005": None}


def test_results_and_logs_by_their_places(spark, tmp_path):
    log(tmp_path / "runs", "pipe a/banking/user_task_0/direct/injection_task_1.json", utility=True)
    log(tmp_path / "runs", "pipe a/banking/user_task_0/none/none.json")
    rows = found_runs.task_results(spark, str(tmp_path / "runs")).select("pipeline", "suite", "user_task", "attack", "injection_task", F.try_variant_get("result", "$.utility", "boolean").alias("u"))
    assert sorted(map(tuple, rows.collect()), key=str) == [("pipe a", "banking", "user_task_0", "direct", "injection_task_1", True), ("pipe a", "banking", "user_task_0", "none", "none", None)]
    for name in ("task_001_output", "task_x_1_output", "task_002_triage_only", "other_output"):
        log(tmp_path / "debug", f"{name}.json", elapsed_time=1.5)
    logs = found_runs.debug_logs(spark, str(tmp_path / "debug"), {"reasoning": "output", "triage": "triage_only"})
    assert {(r.task_id, r.stage, r.t) for r in logs.select("task_id", "stage", F.try_variant_get("log", "$.elapsed_time", "double").alias("t")).collect()} == {("task_001", "reasoning", 1.5), ("task_x_1", "reasoning", 1.5), ("task_002", "triage", 1.5)}


def test_calendar(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"title": "a", "date": "2024-01-01"}, {"title": "b"}]')
    (tmp_path / "d.json").write_text('{"title": "a"}')
    (tmp_path / "e.json").write_text("{title")
    assert [found_runs.calendar(spark, str(tmp_path / f), "title:string").count() for f in ("d.json", "e.json")] == [1, 0]
    assert [tuple(r) for r in found_runs.calendar(spark, str(tmp_path / "c.json"), "title:string,date:date").select("title", F.col("date").cast("string")).collect()] == [("a", "2024-01-01"), ("b", None)]
