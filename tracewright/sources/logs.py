"""Readers of agent logs in JSON lines: one row per message, with tool calls as an array.

A text source has no line numbers, so a file is read whole and its lines are numbered; a session log fits a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars


def lines(spark: SparkSession, path: str, files: str = "*.jsonl") -> DataFrame:
    """file, line_no, v (variant) of each line that is JSON; bad lines are left out."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path, wholetext=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return rows.select("file", "line_no", F.try_parse_json("line").alias("v")).where("v IS NOT NULL")


def _text(path: str, kind: str = "string"):
    return F.try_variant_get("v", path, kind)


def claude(spark: SparkSession, path: str, files: str = "*.jsonl", sid: Column | None = None) -> DataFrame:
    """session_id, seq, ts, cwd, model, role, content, tool_calls(id, name, arguments), tool_results(id, result).

    Lines without sessionId (or without sid, a session's id by file) and of other types are left out; content is a string or
    a list of parts."""
    rows = lines(spark, path, files).withColumns({"sid": _text("$.sessionId") if sid is None else sid, "type": _text("$.type")}).where("coalesce(sid, '') <> '' AND type IN ('user', 'assistant')")
    part = "array<struct<type:string,text:string,id:string,name:string,input:variant,tool_use_id:string,content:variant>>"
    parts = F.coalesce(F.try_variant_get("v", "$.message.content", part), F.array().cast(part))
    rows = rows.withColumn("parts", parts)
    listed = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    result = lambda c: F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))
    return rows.select(
        F.concat(F.lit("claude_"), "sid").alias("session_id"),
        "file",
        F.col("line_no").alias("seq"),
        scalars.normal_timestamp(_text("$.timestamp")).alias("ts"),
        _text("$.cwd").alias("cwd"),
        _text("$.message.model").alias("model"),
        F.col("type").alias("role"),
        F.when(F.size("parts") > 0, listed).otherwise(F.coalesce(_text("$.message.content"), F.lit(""))).alias("content"),
        F.transform(F.filter("parts", lambda p: p["type"] == "tool_use"), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), F.to_json(p["input"]).alias("arguments"))).alias("tool_calls"),
        F.transform(F.filter("parts", lambda p: p["type"] == "tool_result"), lambda p: F.struct(p["tool_use_id"].alias("id"), result(p["content"]).alias("result"))).alias("tool_results"),
    )


def codex(spark: SparkSession, path: str) -> DataFrame:
    """As claude: messages, calls and outputs of the response items; the session's id is that of its file's session_meta."""
    rows = lines(spark, path).withColumns({"type": _text("$.type"), "item": _text("$.payload.type")})
    meta = rows.where("type = 'session_meta'").groupBy("file").agg(F.min_by(_text("$.payload.id"), "line_no").alias("sid"), F.min_by(_text("$.payload.timestamp"), "line_no").alias("at"), F.min_by(_text("$.payload.cwd"), "line_no").alias("cwd"))
    model = rows.where("type = 'turn_context'").groupBy("file").agg(F.max_by(_text("$.payload.model"), "line_no").alias("model"))
    items = rows.where("type = 'response_item'").join(meta.where("sid IS NOT NULL"), "file").join(model, "file", "left")
    part = "array<struct<type:string,text:string>>"
    shown = F.filter(F.try_variant_get("v", "$.payload.content", part), lambda p: p["type"].isin("input_text", "output_text"))
    call, output = F.col("item").isin("function_call", "custom_tool_call"), F.col("item").isin("function_call_output", "custom_tool_call_output")
    one = F.array(F.struct(_text("$.payload.call_id").alias("id"), _text("$.payload.name").alias("name"), F.coalesce(_text("$.payload.arguments"), _text("$.payload.input")).alias("arguments")))
    result = F.array(F.struct(_text("$.payload.call_id").alias("id"), _text("$.payload.output").alias("result")))
    return items.where((F.col("item") == "message") | call | output).select(
        F.concat(F.lit("codex_"), "sid").alias("session_id"),
        "file",
        F.col("line_no").alias("seq"),
        scalars.normal_timestamp(F.col("at")).alias("ts"),
        "cwd",
        "model",
        F.when(call, "assistant").when(output, "tool").otherwise(_text("$.payload.role")).alias("role"),
        F.coalesce(F.array_join(F.transform(shown, lambda p: p["text"]), ""), F.lit("")).alias("content"),
        F.when(call, one).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("tool_calls"),
        F.when(output, result).otherwise(F.array().cast("array<struct<id:string,result:string>>")).alias("tool_results"),
    )


SOURCES = {"claude": claude, "codex": codex}


def tool_calls(messages: DataFrame) -> DataFrame:
    """session_id, seq, id, name, arguments, result, status: calls with the last result of the same id in their session."""
    calls = messages.select("session_id", "file", "seq", F.explode("tool_calls").alias("c")).select("session_id", "file", "seq", "c.*")
    results = messages.select("session_id", "file", "seq", F.explode("tool_results").alias("r")).groupBy("session_id", "file", F.col("r.id").alias("id")).agg(F.max_by("r.result", "seq").alias("result"))
    joined = calls.join(results, ["session_id", "file", "id"], "left")
    return joined.withColumns({"arguments": scalars.truncate_middle(F.col("arguments")), "result": scalars.truncate_middle(F.col("result")), "status": F.when(F.col("result").isNotNull(), "success").otherwise("pending")})


def read(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All sources by name as one table; an unknown name is an error."""
    out = None
    for name, path in paths.items():
        part = SOURCES[name](spark, path).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
