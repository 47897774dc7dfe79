"""Sessions from messages: fold, filter, summary, transcript, past traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import scalars


def fold(messages: DataFrame) -> DataFrame:
    """messages: session_id, seq, role, content, and n_tools if there are any. One row per session with its messages in order.

    A session is one conversation, so that its messages fit a row; order comes from seq, not from the scan."""
    if "n_tools" not in messages.columns:
        messages = messages.withColumn("n_tools", F.lit(0))
    message = F.struct("seq", "role", "content", "n_tools")
    folded = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(message)).alias("history"), F.sum(F.when(F.col("role") == "assistant", F.col("n_tools")).otherwise(0)).alias("n_tool_calls"))
    return folded.withColumn("n_messages", F.size("history"))


def meaningful(sessions: DataFrame) -> DataFrame:
    first = F.get("history", F.lit(0))
    return sessions.where(scalars.meaningful(F.col("n_messages"), first["n_tools"] > 0, first["content"]))


def summary(messages: DataFrame, *by: str) -> DataFrame:
    """Conversations, messages and tool calls by the given columns, with a total row where none are given."""
    return messages.groupBy(*by).agg(F.countDistinct("session_id").alias("n_sessions"), F.count("*").alias("n_messages"), F.sum(F.when(F.col("role") == "assistant", F.col("n_tools")).otherwise(0)).alias("n_tool_calls"))


def transcript(sessions: DataFrame) -> DataFrame:
    line = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return sessions.select("session_id", F.array_join(line, "\n").alias("transcript"))


def message_types(messages: DataFrame) -> DataFrame:
    """Adds message_type: the first message of a user is the prompt, later ones are tool results."""
    first = F.row_number().over(W.partitionBy("session_id", "role").orderBy("seq")) == 1
    kind = F.when((F.col("role") == "user") & first, "user_prompt").when(F.col("role") == "user", "tool_result").when(F.col("role") == "system", "system_init").otherwise("agent_response")
    return messages.withColumn("message_type", kind)


def past_traces(messages: DataFrame) -> DataFrame:
    """Adds the number of earlier messages of the session and of their characters."""
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumns({"n_past": F.count("*").over(before), "past_chars": F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))})


def until_first(messages: DataFrame, threat) -> DataFrame:
    """Messages up to the first for which threat holds, which ends the scan of its session."""
    at = F.min(F.when(threat, F.col("seq"))).over(W.partitionBy("session_id"))
    return messages.withColumn("__at", at).where(F.col("__at").isNull() | (F.col("seq") <= F.col("__at"))).drop("__at")


def unseen(sessions: DataFrame, exported: DataFrame) -> DataFrame:
    """Sessions (session_id, ts) that no export holds, or whose second is after their latest export's."""
    latest = exported.groupBy("session_id").agg(F.max(F.date_trunc("second", "ts")).alias("__last"))
    return sessions.join(latest, "session_id", "left").where(F.col("__last").isNull() | (F.date_trunc("second", "ts") > F.col("__last"))).drop("__last")
