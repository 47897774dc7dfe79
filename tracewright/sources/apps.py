"""Readers of agents that keep their sessions in JSON files or SQLite: one row per message with its tools.

Columns of all readers: session_id, file, seq, ts, cwd, model, role, content, tools (name, server, arguments, result, status,
error; arguments and result as text). Rows that are no JSON are left out; messages without content or tools too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.sources import logs
from tracewright.sources.sqlite import SqliteSource

COLUMNS = ("session_id", "file", "seq", "ts", "cwd", "model", "role", "content", "tools")
TOOL = "struct<name:string,server:string,arguments:string,result:string,status:string,error:string>"
#: What stands for the content of a message that only has tools.
USED_TOOLS, DECIDED_TOOL = "[Assistant used tools]", "[Assistant decided to use a tool]"
#: Beginnings of the ids of the desktop application's sessions.
INTERACTIVE, DISPATCHED = "claude_desktop_", "claude_desktop_dispatch_"
#: A call of a tool inside text: server, tool and arguments.
CALL = r"(?s)<use_mcp_tool>\s*<server_name>([^<]+)</server_name>\s*<tool_name>([^<]+)</tool_name>\s*<arguments>\s*(\{.*?\})\s*</arguments>\s*</use_mcp_tool>"
#: A text of a rich-text tree, as it is written in JSON.
RICH_TEXT = r'"text"\s*:\s*"((?:[^"\\]|\\.)*+)"'


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """The text, null if it is empty."""
    return F.nullif(text, F.lit(""))


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _json(c: Column) -> Column:
    """A variant as text: a string as it is, anything else as JSON."""
    return F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))


def _tool(name: Column, server: Column, arguments: Column, result: Column, status: Column, error: Column) -> Column:
    parts = {"name": name, "server": server, "arguments": scalars.truncate_middle(arguments), "result": scalars.truncate_middle(result), "status": status, "error": scalars.truncate_middle(error)}
    return F.struct(*[c.cast("string").alias(k) for k, c in parts.items()])


def _one(present: Column, tool: Column) -> Column:
    return F.when(present, F.array(tool)).otherwise(F.array().cast(f"array<{TOOL}>"))


def _said(rows: DataFrame, instead: str = USED_TOOLS) -> DataFrame:
    rows = rows.where((F.col("content") != "") | (F.size("tools") > 0))
    return rows.withColumn("content", F.when(F.col("content") == "", instead).otherwise(F.col("content"))).select(*COLUMNS)


def _table(spark: SparkSession, path: str, table: str, schema: str, prefix: str | None = None) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").schema(schema).option("path", path).option("table", table)
    return (reader.option("prefix_column", "key").option("prefix", prefix) if prefix else reader).load()


def cline(spark: SparkSession, path: str) -> DataFrame:
    """A folder for each task with one JSON array of messages; its time is that of the file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "api_conversation_history.json").text(path, wholetext=True)
    messages = F.try_variant_get(F.try_parse_json("value"), "$", "array<struct<role:string,content:variant>>")
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("ts"), F.posexplode(messages).alias("seq", "m"))

    def plain(part: Column) -> Column:
        text = F.coalesce(part["text"], F.lit(""))
        text = F.when(F.contains(text, F.lit("<environment_details>")), stripped(F.substring_index(text, "<environment_details>", 1))).otherwise(text)
        inner = r"(?s)<task>(.*?)</task>"
        return F.when(F.regexp_like(text, F.lit(inner)), stripped(F.regexp_extract(text, inner, 1))).otherwise(text)

    parts = F.filter(F.try_variant_get("m.content", "$", "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text")
    rows = rows.withColumn("content", F.coalesce(stripped(F.array_join(F.transform(parts, plain), " ")), F.lit("")))
    called = lambda t, k: F.regexp_extract(t, CALL, k)
    valid = F.filter(F.regexp_extract_all("content", F.lit(CALL), F.lit(0)), lambda t: F.try_parse_json(called(t, 3)).isNotNull())
    none = F.lit(None).cast("string")
    tools = F.transform(valid, lambda t: _tool(called(t, 2), called(t, 1), called(t, 3), none, none, none))
    rows = rows.withColumns({"role": F.col("m.role"), "tools": F.when(F.col("m.role") == "assistant", tools).otherwise(F.array().cast(f"array<{TOOL}>")), "cwd": none, "model": none})
    return _said(rows.where("role IN ('user', 'assistant')").withColumn("session_id", F.concat(F.lit("cline_"), F.regexp_extract("file", "([^/]+)/[^/]+$", 1))))


def cursor(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Bubbles by conversation, of conversations whose metadata has a time: the last update, else the creation. One whose time
    can't be read is kept with a null time; since leaves out older ones."""
    schema = "rowid long, key string, value string"
    meta = _table(spark, path, "cursorDiskKV", schema, "composerData:").select(F.expr("substr(key, 14)").alias("conv"), F.try_parse_json("value").alias("v"))
    meta = meta.withColumn("at", F.coalesce(_get("v", "$.lastUpdatedAt"), _get("v", "$.createdAt"))).where("at IS NOT NULL")
    # a conversation's metadata has one key; should the table repeat it, the latest counts
    meta = meta.groupBy("conv").agg(F.max(scalars.normal_timestamp(F.col("at"))).alias("ts"))
    if since:
        meta = meta.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(since).cast("timestamp")))
    bubbles = _table(spark, path, "cursorDiskKV", schema, "bubbleId:").withColumns({"conv": F.get(F.split("key", ":"), F.lit(1)), "v": F.try_parse_json("value")})
    rows = bubbles.where("size(split(key, ':')) >= 3 AND v IS NOT NULL").join(meta, "conv")
    rich = F.when(F.startswith(_get("v", "$.richText"), F.lit('{"root":')), _get("v", "$.richText"))
    unescape = lambda t: F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), t, F.lit('"'))), "$", "string"), F.lit(""))
    from_rich = stripped(F.array_join(F.transform(F.regexp_extract_all(rich, F.lit(RICH_TEXT), F.lit(1)), unescape), " "))
    name = F.coalesce(filled(_get("v", "$.toolFormerData.name")), filled(_get("v", "$.toolFormerData.tool")))
    arguments = F.coalesce(_json(_get("v", "$.toolFormerData.params", "variant")), _json(_get("v", "$.toolFormerData.rawArgs", "variant")))
    result = F.when(name == "list_dir", stripped(_get("v", "$.toolFormerData.result")))
    tool = _tool(name, F.lit(None), arguments, result, F.coalesce(_get("v", "$.toolFormerData.status"), F.lit("unknown")), filled(_get("v", "$.toolFormerData.error")))
    kind = _get("v", "$.type", "int")
    order = W.partitionBy("conv").orderBy(F.coalesce(_get("v", "$._bubble_id"), F.lit("")), "rowid")
    rows = rows.withColumns(
        {
            "session_id": F.concat(F.lit("cursor_"), "conv"),
            "file": F.lit(path),
            "seq": F.row_number().over(order) - 1,
            "cwd": F.lit(None).cast("string"),
            "model": F.lit(None).cast("string"),
            "role": F.when(kind == 1, "user").when(kind == 2, "assistant"),
            "content": F.coalesce(filled(from_rich), stripped(_get("v", "$.text")), F.lit("")),
            "tools": _one((kind == 2) & name.isNotNull() & (name != "unknown"), tool),
        }
    )
    return _said(rows.where("role IS NOT NULL"), DECIDED_TOOL)


def warp(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Exchanges of conversations with what the model put out. Time, folder and model are those of the latest exchange."""
    conversations = _table(spark, path, "agent_conversations", "conversation_id string, last_modified_at string").distinct()
    if since:
        at = scalars.normal_timestamp(F.col("last_modified_at"))
        conversations = conversations.where(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    queries = _table(spark, path, "ai_queries", "rowid long, exchange_id string, conversation_id string, start_ts string, input string, working_directory string, model_id string")
    blocks = _table(spark, path, "ai_blocks", "exchange_id string, output string")
    rows = queries.join(conversations, "conversation_id", "left_semi").join(blocks, "exchange_id", "left")
    whole = W.partitionBy("conversation_id")
    rows = rows.withColumns({"latest": F.max_by(F.struct("start_ts", "working_directory", "model_id"), F.struct("start_ts", -F.col("rowid"))).over(whole), "seq": F.row_number().over(whole.orderBy("start_ts", "rowid")) - 1})
    rows = rows.withColumns({"item": F.try_variant_get(F.try_parse_json("input"), "$[0]", "variant"), "out": F.try_parse_json("output")})
    is_query, is_action = (F.try_variant_get("item", p, "variant").isNotNull() for p in ("$.Query", "$.ActionResult"))
    command = "$.ActionResult.result.RequestCommandOutput.result"
    done, failed, code = _get("item", f"{command}.Success", "variant"), _get("item", f"{command}.Error", "variant"), _get("item", f"{command}.Success.exit_code", "long")
    ok, none = F.coalesce(code == 0, F.lit(False)), F.lit(None).cast("string")
    status, error = F.when(ok, "success").otherwise("error"), F.when(~ok, F.concat(F.lit("Exit code: "), F.coalesce(code.cast("string"), F.lit("None"))))
    ran = _tool(F.lit("execute_command"), none, F.to_json(F.struct(F.coalesce(_get("item", f"{command}.Success.command"), F.lit("")).alias("command"))), F.coalesce(_get("item", f"{command}.Success.output"), F.lit("")), status, error)
    broke = _tool(F.lit("execute_command"), none, F.lit("{}"), none, F.lit("error"), _json(failed))
    other = _tool(F.coalesce(_get("item", "$.ActionResult.id"), F.lit("unknown")), none, F.coalesce(F.to_json(_get("item", "$.ActionResult.context", "variant")), F.lit("{}")), F.coalesce(F.to_json(_get("item", "$.ActionResult.result", "variant")), F.lit("{}")), none, none)
    parts = F.try_variant_get("out", "$.Received.output", "array<struct<Text:struct<text:string>,Code:struct<code:string,language:variant>>>")
    language = lambda p: F.lower(F.get(F.map_keys(F.try_variant_get(p["Code"]["language"], "$", "map<string,variant>")), F.lit(0)))
    fenced = lambda p: F.concat(F.lit("```"), F.coalesce(language(p), F.lit("")), F.lit("\n"), p["Code"]["code"], F.lit("\n```"))
    told = F.array_join(F.transform(parts, lambda p: F.coalesce(p["Text"]["text"], fenced(p))), "\n")
    executed = F.when(done.isNotNull(), F.concat(F.lit("Executed: "), F.coalesce(_get("item", f"{command}.Success.command"), F.lit(""))))
    rows = rows.where(is_query | is_action).withColumns(
        {
            "session_id": F.concat(F.lit("warp_"), "conversation_id"),
            "file": F.lit(path),
            "ts": scalars.normal_timestamp(F.col("latest.start_ts")),
            "cwd": F.col("latest.working_directory"),
            "model": F.col("latest.model_id"),
            "role": F.when(is_query, "user").otherwise("assistant"),
            "content": F.coalesce(F.when(is_query, _get("item", "$.Query.text")).otherwise(F.coalesce(filled(told), executed)), F.lit("")),
            "tools": _one(~is_query, F.when(done.isNotNull(), ran).when(failed.isNotNull(), broke).otherwise(other)),
        }
    )
    return _said(rows)


def _part_text(p: Column) -> Column:
    get = lambda path: filled(F.try_variant_get(p, path, "string"))
    kind, prompt = get("$.type"), F.coalesce(get("$.prompt"), get("$.description"))
    subtask = F.concat(F.lit("[Subtask"), F.coalesce(F.concat(F.lit(": "), get("$.agent")), F.lit("")), F.lit("]\n"), prompt)
    attached = F.concat(F.lit("[Attached file: "), F.coalesce(get("$.filename"), get("$.url")), F.lit("]"))
    return F.when(kind == "text", get("$.text")).when(kind == "reasoning", F.concat(F.lit("[Reasoning]\n"), get("$.text"))).when(kind == "subtask", subtask).when(kind == "file", attached)


def _part_tool(p: Column) -> Column:
    get = lambda path: F.try_variant_get(p, path, "variant")
    text = lambda path: F.try_variant_get(p, path, "string")
    server = lambda name: F.when(F.contains(name, F.lit("_")), filled(F.substring_index(name, "_", 1)))
    state = lambda path, good: F.when(text(path) == good, "success").otherwise(text(path))
    error = filled(text("$.state.error"))
    now = _tool(filled(text("$.tool")), server(text("$.tool")), F.coalesce(_json(get("$.state.input")), F.lit("{}")), F.coalesce(error, _json(get("$.state.output"))), state("$.state.status", "completed"), error)
    old = _tool(filled(text("$.toolInvocation.toolName")), server(text("$.toolInvocation.toolName")), F.coalesce(_json(get("$.toolInvocation.args")), F.lit("{}")), _json(get("$.toolInvocation.result")), state("$.toolInvocation.state", "result"), F.lit(None))
    return F.when(text("$.type") == "tool", now).when(text("$.type") == "tool-invocation", old)


def _opencode(sessions: DataFrame, messages: DataFrame, parts: DataFrame, built_in: tuple[str, ...]) -> DataFrame:
    """Messages from sessions (id, file, directory, model, time_created, time_updated), messages (id, session_id, place, v) and
    their parts (message_id, sid, place, p; all parts of a message with a null sid belong to the message whatever its session)."""
    parts = parts.select("message_id", "sid", F.struct("place", _part_text(F.col("p")).alias("text"), _part_tool(F.col("p")).alias("tool")).alias("x"))
    ordered = F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1))
    parts = parts.groupBy("message_id", "sid").agg(ordered.alias("parts"))
    role = F.coalesce(filled(_get("v", "$.role")), F.lit("assistant"))
    whole = W.partitionBy("session_id")
    rows = messages.withColumns({"role": role, "seq": F.row_number().over(whole.orderBy("place")) - 1})
    named = F.when(F.col("role") == "assistant", filled(_get("v", "$.modelID")))
    rows = rows.withColumn("first_model", F.min_by(named, F.when(named.isNotNull(), F.col("seq"))).over(whole))
    rows = rows.join(parts, (F.col("id") == F.col("message_id")) & (F.col("sid").isNull() | (F.col("session_id") == F.col("sid"))), "left")
    own = sessions.select(F.col("id").alias("own_id"), "file", "directory", F.col("model").alias("own_model"), F.coalesce("time_updated", "time_created").cast("string").alias("at"))
    rows = rows.join(own, F.col("session_id") == F.col("own_id"))
    parsed = F.try_parse_json("own_model")
    from_json = F.coalesce(F.try_variant_get(parsed, "$.id", "string"), F.try_variant_get(parsed, "$.modelID", "string"))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    tools = F.filter(F.transform("parts", lambda x: x["tool"]), lambda t: t["name"].isNotNull())
    if built_in:
        tools = F.transform(tools, lambda t: t.withField("server", F.when(~t["name"].isin(*built_in), t["server"])))
    rows = rows.select(
        F.concat(F.lit("opencode_"), F.regexp_replace("session_id", "^ses_", "")).alias("session_id"),
        "file",
        "seq",
        scalars.normal_timestamp(F.col("at")).alias("ts"),
        filled(F.col("directory")).alias("cwd"),
        F.when(is_object, F.coalesce(from_json, "first_model")).otherwise(F.coalesce(filled(F.col("own_model")), "first_model")).alias("model"),
        "role",
        F.coalesce(stripped(F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n")), F.lit("")).alias("content"),
        F.coalesce(tools, F.array().cast(f"array<{TOOL}>")).alias("tools"),
    )
    return _said(rows)


def opencode(spark: SparkSession, path: str, since_ms: int | None = None, built_in: tuple[str, ...] = ()) -> DataFrame:
    """Sessions, messages and their parts from the database. The model is the session's, else the first that an assistant's
    message names; tools named server_tool belong to that server unless they are listed as built in."""
    sessions = _table(spark, path, "session", "id string, directory string, model string, time_created long, time_updated long").where("coalesce(id, '') <> ''")
    if since_ms:
        sessions = sessions.where(F.col("time_updated") >= since_ms)
    messages = _table(spark, path, "message", "id string, session_id string, time_created long, data string").withColumn("v", F.try_parse_json("data")).where("v IS NOT NULL")
    parts = _table(spark, path, "part", "id string, message_id string, session_id string, time_created long, data string").withColumn("p", F.try_parse_json("data")).where("p IS NOT NULL")
    place = F.struct("time_created", "id").alias("place")
    return _opencode(sessions.withColumn("file", F.lit(path)), messages.select("id", "session_id", place, "v"), parts.select("message_id", F.col("session_id").alias("sid"), place, "p"), built_in)


def opencode_tree(spark: SparkSession, path: str, since_ms: int | None = None, built_in: tuple[str, ...] = ()) -> DataFrame:
    """The older store: a JSON file for each session, message and part, ordered by file name; ids of messages that name none come
    from the file name. Parts within a message win over files of parts. Both layouts are read: session/<project>/, message/ and
    part/<message>/, or session/info/, session/message/ and session/part/<session>/<message>/. since_ms leaves out sessions whose
    file is older; files that are no JSON are skipped."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    files = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    found = lambda pattern, group: F.regexp_extract("file", pattern, group)
    session, message, part = r"/session/(?!message/|part/)[^/]+/[^/]+\.json$", r"/message/([^/]+)/([^/]+)\.json$", r"/part/(?:([^/]+)/)?([^/]+)/([^/]+)\.json$"
    sessions = files.where(F.col("file").rlike(session)).select(
        filled(_get("v", "$.id")).alias("id"), "file", "changed", _get("v", "$.directory").alias("directory"), _json(F.try_variant_get("v", "$.model", "variant")).alias("model"),
        _get("v", "$.time.created", "long").alias("time_created"), _get("v", "$.time.updated", "long").alias("time_updated"),
    ).where("id IS NOT NULL")
    if since_ms:
        sessions = sessions.where(F.col("changed") >= F.timestamp_millis(F.lit(since_ms)))
    messages = files.where(F.col("file").rlike(message)).select(F.coalesce(filled(_get("v", "$.id")), found(message, 2)).alias("id"), found(message, 1).alias("session_id"), F.struct(found(message, 2).alias("name")).alias("place"), "v")
    inside = messages.select("id", "session_id", F.posexplode(F.try_variant_get("v", "$.parts", "array<variant>")).alias("k", "p"))
    inside = inside.select(F.col("id").alias("message_id"), F.col("session_id").alias("sid"), F.struct("k", F.lit("").alias("name")).alias("place"), "p")
    beside = files.where(F.col("file").rlike(part)).select(found(part, 2).alias("message_id"), filled(found(part, 1)).alias("sid"), F.struct(F.lit(0).alias("k"), found(part, 3).alias("name")).alias("place"), F.col("v").alias("p"))
    embedding = inside.select(F.col("message_id").alias("m"), F.col("sid").alias("s")).distinct()
    beside = beside.join(embedding, (F.col("message_id") == F.col("m")) & (F.col("sid").isNull() | (F.col("sid") == F.col("s"))), "left_anti")
    return _opencode(sessions, messages, inside.unionByName(beside), built_in)


def with_tools(messages: DataFrame) -> DataFrame:
    """Messages of the line readers with their calls and results put together as tools."""
    empty = F.lit(None).cast("string")
    calls = logs.tool_calls(messages).withColumn("t", F.struct("name", scalars.mcp_parts(F.col("name"))["server"].alias("server"), "arguments", "result", "status", empty.alias("error")))
    of = calls.groupBy("session_id", "file", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]).alias("tools"))
    joined = messages.drop("tools").join(of, ["session_id", "file", "seq"], "left")
    return joined.withColumn("tools", F.coalesce("tools", F.array().cast(f"array<{TOOL}>"))).select(*COLUMNS)


#: A session of the desktop application: a folder for the user and one for the organisation, none of them hidden.
DESKTOP = r"/[^/.][^/]*/[^/.][^/]*/(?:agent/local_ditto_[^/]+|local_[^/]+)/audit\.jsonl$"


def desktop(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """A folder for each session with its lines, beside it a JSON file of the same name with time, folder and model.

    The time is that of the last activity, else of the creation, else of the file of lines; a session without metadata is kept,
    and since_ms leaves out those whose last activity is earlier."""
    name = F.regexp_extract("file", "/local_(?:ditto_)?([^/]+)/audit\\.jsonl$", 1)
    rows = with_tools(logs.claude(spark, path, "audit.jsonl", F.when(F.regexp_like("file", F.lit(DESKTOP)), name)))
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "local_*.json").text(path, wholetext=True)
    found = found.select(F.regexp_replace("_metadata.file_path", "\\.json$", "").alias("folder"), F.try_parse_json("value").alias("v"))
    meta = found.select("folder", _get("v", "$.lastActivityAt", "double").alias("active"), _get("v", "$.createdAt", "double").alias("created"), _get("v", "$.cwd").alias("own_cwd"), _get("v", "$.model").alias("own_model"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "audit.jsonl").load(path).select(F.col("_metadata.file_path").alias("file"), "modificationTime")
    rows = rows.withColumn("folder", F.regexp_replace("file", "/audit\\.jsonl$", "")).join(meta, "folder", "left").join(files, "file", "left")
    if since_ms:
        rows = rows.where(F.col("active").isNull() | (F.col("active") >= since_ms))
    at = F.coalesce(F.timestamp_millis(F.coalesce("active", "created").cast("long")), F.col("modificationTime"))
    prefix = F.when(F.contains("folder", F.lit("/agent/local_ditto_")), F.lit(DISPATCHED)).otherwise(F.lit(INTERACTIVE))
    rows = rows.withColumns({"session_id": F.concat(prefix, F.expr("substr(session_id, 8)")), "ts": at, "cwd": F.col("own_cwd"), "model": F.col("own_model")})
    return _said(rows)


SOURCES = {"claude": lambda spark, path: with_tools(logs.claude(spark, path)), "codex": lambda spark, path: with_tools(logs.codex(spark, path)), "claude_desktop": desktop, "cline": cline, "cursor": cursor, "warp": warp, "opencode": opencode, "opencode_tree": opencode_tree}


def read(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All sources by name as one table with the column source; an unknown name is an error."""
    out = None
    for name, path in paths.items():
        part = SOURCES[name](spark, path).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
