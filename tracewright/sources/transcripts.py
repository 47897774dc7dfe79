"""Task transcripts with injections (one JSON file each) as numbered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Roles and message types by the role of the transcript; other roles stay, as system_init.
ROLES = {"human": "user"}
CONTEXT = "AGENTDOJO INJECTION CONTEXT (for detection reference):\n"
CALL = "struct<name:string,id:string,args:variant>"


def converted(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """file, message_id (from 1), role, content, tool_calls (name, id, args as JSON), message_type.

    Injections, where a transcript has any, come first as one system message, by their names. Files that are no JSON have no
    rows; content that is no string is JSON."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    kind = f"struct<role:string,content:variant,tool_calls:array<{CALL}>>"
    injections = F.map_entries(F.try_variant_get("v", "$.injections", "map<string,string>"))
    told = F.filter(injections, lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    context = F.concat(F.lit(CONTEXT), F.array_join(F.transform(told, lambda e: F.concat(F.lit("\n["), e["key"], F.lit("]: "), e["value"], F.lit("\n"))), ""))
    none = F.array().cast(f"array<{CALL}>")
    first = rows.where(F.size(injections) > 0).select("file", F.lit(-1).alias("at"), F.lit("system").alias("from"), context.alias("content"), none.alias("calls"))
    each = rows.select("file", F.posexplode(F.try_variant_get("v", "$.messages", f"array<{kind}>")).alias("at", "m"))
    text = F.coalesce(F.try_variant_get("m.content", "$", "string"), F.to_json("m.content"), F.lit(""))
    each = each.select("file", "at", F.coalesce("m.role", F.lit("")).alias("from"), text.alias("content"), F.when(F.col("m.role") == "assistant", F.coalesce("m.tool_calls", none)).otherwise(none).alias("calls"))
    role = F.col("from")
    called = F.when(F.size("calls") > 0, "tool_calling").otherwise("agent_response")
    return first.unionByName(each).select(
        "file",
        F.row_number().over(W.partitionBy("file").orderBy("at")).alias("message_id"),
        F.coalesce(F.get(F.array(*[F.when(role == k, v) for k, v in ROLES.items()]), F.lit(0)), role).alias("role"),
        "content",
        F.transform("calls", lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(F.to_json(c["args"]), F.lit("{}")).alias("args"))).alias("tool_calls"),
        F.when(role == "human", "user_prompt").when(role == "assistant", called).when(role == "tool", "tool_response").otherwise("system_init").alias("message_type"),
    )
