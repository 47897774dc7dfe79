"""Readers of applications' own stores, on small files made here."""

import json
import sqlite3

import pytest

from tracewright.sources import apps

CALL = "<use_mcp_tool>\n<server_name>git</server_name>\n<tool_name>log</tool_name>\n<arguments>{args}</arguments>\n</use_mcp_tool>"


def database(path, tables):
    with sqlite3.connect(path) as db:
        for name, (columns, rows) in tables.items():
            db.execute(f"CREATE TABLE {name} ({columns})")
            for row in rows:
                db.execute(f"INSERT INTO {name} VALUES ({','.join('?' * len(row))})", row)
    return str(path)


def test_cline(spark, tmp_path):
    text = lambda t: [{"type": "text", "text": t}]
    (tmp_path / "t1").mkdir()
    turns = [{"role": "user", "content": text("<task> do it </task> x <environment_details>secret")}, {"role": "assistant", "content": text("ok " + CALL.replace("{args}", '{"n": 1}') + CALL.replace("{args}", "{broken}"))}, {"role": "user", "content": []}]
    (tmp_path / "t1" / "api_conversation_history.json").write_text(json.dumps(turns, indent=1))
    (tmp_path / "t2").mkdir()
    (tmp_path / "t2" / "api_conversation_history.json").write_text("{broken")
    rows = apps.cline(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.session_id, r.role) for r in rows] == [("cline_t1", "user"), ("cline_t1", "assistant")]
    assert rows[0].content == "do it" and rows[0].ts is not None
    assert [(t.name, t.server, json.loads(t.arguments)) for t in rows[1].tools] == [("log", "git", {"n": 1})]


def test_cursor(spark, tmp_path):
    rich = json.dumps({"root": {"children": [{"text": "from"}, {"children": [{"text": 'ri"ch'}]}]}}, separators=(",", ":"))
    rows = [
        ("composerData:c1", json.dumps({"createdAt": 1704067200000}).encode()),
        ("composerData:c2", json.dumps({"name": "no time"})),
        ("bubbleId:c1:b1", json.dumps({"type": 1, "text": " hi there "})),
        ("bubbleId:c1:b2", json.dumps({"type": 2, "text": "", "toolFormerData": {"name": "list_dir", "params": '{"p":"/"}', "status": "completed", "result": " a b "}})),
        ("bubbleId:c1:b3", json.dumps({"type": 2, "text": "plain", "richText": rich})),
        ("bubbleId:c1:b4", json.dumps({"type": 7, "text": "other"})),
        ("bubbleId:c1:b5", "{broken"),
        ("bubbleId:c2:b1", json.dumps({"type": 1, "text": "dropped"})),
    ]
    path = database(tmp_path / "c.db", {"cursorDiskKV": ("key TEXT UNIQUE, value BLOB", rows)})
    got = apps.cursor(spark, path).orderBy("seq").collect()
    assert [(r.session_id, r.role, r.content) for r in got] == [("cursor_c1", "user", "hi there"), ("cursor_c1", "assistant", apps.DECIDED_TOOL), ("cursor_c1", "assistant", 'from ri"ch')]
    assert [(t.name, t.arguments, t.result, t.status, t.error) for t in got[1].tools] == [("list_dir", '{"p":"/"}', "a b", "completed", None)]
    assert str(got[0].ts).startswith("2024-01-01")
    assert apps.cursor(spark, path, since="2025-01-01").count() == 0


def test_warp(spark, tmp_path):
    action = lambda result: json.dumps([{"ActionResult": {"id": "a", "result": {"RequestCommandOutput": {"result": result}}}}])
    out = json.dumps({"Received": {"output": [{"Text": {"text": "so"}}, {"Code": {"code": "ls", "language": {"Bash": {}}}}]}})
    path = database(
        tmp_path / "w.db",
        {
            "agent_conversations": ("conversation_id TEXT PRIMARY KEY, conversation_data TEXT, last_modified_at TEXT", [("k", "{}", "2024-01-02T00:00:00"), ("old", "{}", "2020-01-01T00:00:00")]),
            "ai_queries": ("exchange_id TEXT, conversation_id TEXT, start_ts TEXT, input TEXT, working_directory TEXT, output_status TEXT, model_id TEXT", [
                ("e1", "k", "2024-01-01T00:00:00", json.dumps([{"Query": {"text": "list"}}]), "/a", "ok", "m1"),
                ("e2", "k", "2024-01-01T00:00:01", action({"Success": {"command": "ls", "output": "x", "exit_code": 0}}), "/b", "ok", "m2"),
                ("e3", "k", "2024-01-01T00:00:02", action({"Success": {"command": "rm", "output": "", "exit_code": 2}}), "/b", "ok", "m3"),
                ("e4", "k", "2024-01-01T00:00:03", "[]", "/c", "ok", "m4"),
                ("e5", "old", "2020-01-01T00:00:00", json.dumps([{"Query": {"text": "old"}}]), "/a", "ok", "m1"),
            ]),
            "ai_blocks": ("exchange_id TEXT, output TEXT", [("e2", out)]),
        },
    )
    got = apps.warp(spark, path, since="2023-01-01").orderBy("seq").collect()
    assert [(r.role, r.content, r.cwd, r.model) for r in got] == [("user", "list", "/c", "m4"), ("assistant", "so\n```bash\nls\n```", "/c", "m4"), ("assistant", "Executed: rm", "/c", "m4")]
    assert [(t.arguments, t.result, t.status, t.error) for r in got for t in r.tools] == [('{"command":"ls"}', "x", "success", None), ('{"command":"rm"}', "", "error", "Exit code: 2")]
    assert apps.warp(spark, path).count() == 4


def test_opencode(spark, tmp_path):
    message = lambda **d: json.dumps(d)
    path = database(
        tmp_path / "o.db",
        {
            "session": ("id TEXT PRIMARY KEY, directory TEXT, title TEXT, version TEXT, model TEXT, time_created INT, time_updated INT", [("ses_1", "/p", "t", "1", None, 1704067200000, 1704067201000)]),
            "message": ("id TEXT PRIMARY KEY, session_id TEXT, time_created INT, data TEXT", [("m1", "ses_1", 1, message(role="user")), ("m2", "ses_1", 2, message(role="assistant", modelID="big")), ("m3", "ses_1", 3, message(role="assistant")), ("m4", "ses_1", 4, "{broken")]),
            "part": ("id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INT, data TEXT", [
                ("p2", "m1", "ses_1", 2, message(type="file", filename="a.txt")),
                ("p1", "m1", "ses_1", 1, message(type="text", text="look")),
                ("p3", "m2", "ses_1", 3, message(type="tool", tool="git_log", state={"status": "completed", "input": {"n": 1}, "output": "done"})),
                ("p4", "m2", "ses_1", 4, message(type="tool", tool="bash", state={"status": "error", "error": "no"})),
                ("p5", "m3", "ses_1", 5, message(type="step-start")),
            ]),
        },
    )
    got = apps.opencode(spark, path).orderBy("seq").collect()
    assert [(r.session_id, r.role, r.content, r.cwd, r.model) for r in got] == [("opencode_1", "user", "look\n\n[Attached file: a.txt]", "/p", "big"), ("opencode_1", "assistant", apps.USED_TOOLS, "/p", "big")]
    assert [(t.name, t.server, t.arguments, t.result, t.status, t.error) for t in got[1].tools] == [("git_log", "git", '{"n":1}', "done", "success", None), ("bash", None, "{}", "no", "error", "no")]


@pytest.mark.parametrize("layout", ["projects", "legacy"])
def test_opencode_tree(spark, tmp_path, layout):
    new = layout == "projects"
    session = "session/p1/ses_1.json" if new else "session/info/ses_1.json"
    message, part = ("message/ses_1", "part") if new else ("session/message/ses_1", "session/part/ses_1")
    files = {
        session: {"id": "ses_1", "directory": "/p", "time": {"created": 1704067200000, "updated": 1704067201000}},
        f"{message}/m1.json": {"role": "user"},
        f"{message}/m2.json": {"id": "m2", "role": "assistant", "modelID": "big", "parts": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]},
        f"{message}/m3.json": {"id": "m3", "role": "assistant"},
        f"{part}/m1/b.json": {"type": "file", "filename": "a.txt"},
        f"{part}/m1/a.json": {"type": "text", "text": "look"},
        f"{part}/m2/a.json": {"type": "text", "text": "lost"},
        f"{part}/m3/a.json": {"type": "tool", "tool": "git_log", "state": {"status": "completed", "input": {"n": 1}, "output": "done"}},
    }
    for name, value in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    (tmp_path / message / "m4.json").write_text("{broken")
    got = apps.opencode_tree(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.session_id, r.role, r.content, r.cwd, r.model) for r in got] == [("opencode_1", "user", "look\n\n[Attached file: a.txt]", "/p", "big"), ("opencode_1", "assistant", "one\n\ntwo", "/p", "big"), ("opencode_1", "assistant", apps.USED_TOOLS, "/p", "big")]
    assert [(t.name, t.server, t.arguments, t.result, t.status) for t in got[2].tools] == [("git_log", "git", '{"n":1}', "done", "success")]
    assert not apps.opencode_tree(spark, str(tmp_path), since_ms=4102444800000).collect()


def test_read(spark, tmp_path):
    rows = [{"type": "assistant", "sessionId": "s", "timestamp": "2024-01-01T00:00:01Z", "message": {"content": [{"type": "tool_use", "id": "t1", "name": "mcp__fs__read", "input": {"path": "a"}}]}}, {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = apps.read(spark, {"claude": str(tmp_path), "cline": str(tmp_path)}).orderBy("seq").collect()
    assert [[(t.name, t.server, t.result, t.status) for t in r.tools] for r in got] == [[("mcp__fs__read", "fs", "done", "success")], []]


def test_desktop(spark, tmp_path):
    lines = [
        {"type": "system", "subtype": "init", "model": "x"},
        {"type": "user", "message": {"content": "hi"}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "id": "1", "name": "mcp__fs__read", "input": {}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "out"}]}},
    ]
    text = "\n".join(map(json.dumps, lines)) + "\n{broken\n"
    for folder in ("u/o/local_a", "u/o/agent/local_ditto_b", "u/o/local_old", "u/.hidden/local_c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "audit.jsonl").write_text(text)
    (tmp_path / "u/o/local_a.json").write_text(json.dumps({"lastActivityAt": 1704067200000, "cwd": "/w", "model": "m"}, indent=1))
    (tmp_path / "u/o/local_old.json").write_text(json.dumps({"lastActivityAt": 1}))
    got = apps.desktop(spark, str(tmp_path), since_ms=1000000).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.role, r.content) for r in got] == [(s, role, c) for s in (apps.INTERACTIVE + "a", apps.DISPATCHED + "b") for role, c in (("user", "hi"), ("assistant", "yes"))]
    assert [(t.name, t.server, t.result) for t in got[1].tools] == [("mcp__fs__read", "fs", "out")]
    assert (str(got[0].ts), got[0].cwd, got[0].model) == ("2024-01-01 00:00:00", "/w", "m")
    assert got[2].ts is not None and got[2].cwd is None
