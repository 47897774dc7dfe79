"""Runs of benchmarks: what is left to do, how suites and detectors went, which tasks needed servers; lists of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.evaluation import ratio
from tracewright.operators.progress import running


def remaining(tasks: DataFrame, done: DataFrame, key: str, again: bool = False) -> DataFrame:
    """The tasks without a result, or all of them to run again."""
    return tasks if again else tasks.join(done.select(key).distinct(), key, "left_anti")


def suite_success(results: DataFrame, suite: str, utility: Column, security: Column) -> DataFrame:
    """suite, n and the shares of results with utility and with security; a null verdict is a failure."""
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    return results.groupBy(suite).agg(F.count("*").alias("n"), share(utility).alias("utility_rate"), share(security).alias("security_rate"))


def path_split(results: DataFrame, method: str, actual: Column) -> DataFrame:
    """method, n, n_malicious, share of all results: which stage decided how many."""
    counts = results.groupBy(method).agg(F.count("*").alias("n"), F.count_if(actual).alias("n_malicious"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all"))), F.lit(True)).select(method, "n", "n_malicious", ratio(F.col("n"), F.col("__all")).alias("share"))


def necessity(tasks: DataFrame, needed: Column, used: Column, *by: str) -> DataFrame:
    """By the given columns: tasks that needed servers and used them, needed and did not, used without need, and neither."""
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    return tasks.groupBy(*by).agg(count(needed & used, "needed_used"), count(needed & ~used, "needed_unused"), count(~needed & used, "unneeded_used"), count(~needed & ~used, "unneeded_unused"))


def with_tools(sessions: DataFrame) -> DataFrame:
    """The folded sessions in which an assistant's message has a tool call."""
    return sessions.where(F.exists("history", lambda m: (m["role"] == "assistant") & (m["n_tools"] > 0)))


def keys_known(used: Column, known: Column) -> Column:
    """Whether every key that is used is known; no keys are."""
    return F.size(F.array_except(used, known)) == 0


def members(users: DataFrame, user: str, channels: str, channel: str) -> DataFrame:
    """The users whose list of channels holds the channel."""
    return users.where(F.array_contains(channels, channel)).select(user)


def consumers(topics: DataFrame, topic: str, subscriptions: DataFrame, group: str) -> DataFrame:
    """topic, n_messages, n_groups: subscriptions hold (topic, group); a topic without any has 0 groups."""
    groups = subscriptions.select(topic, group).distinct().groupBy(topic).agg(F.count("*").alias("__g"))
    counts = topics.groupBy(topic).agg(F.count("*").alias("n_messages"))
    return counts.join(groups, topic, "left").select(topic, "n_messages", F.coalesce("__g", F.lit(0)).cast("long").alias("n_groups"))


def order_lines(lines: DataFrame, product: str, quantity: str, products: DataFrame, key: str, price: str, order: str) -> DataFrame:
    """order, n_lines, n_unknown, total: the price of each known product times its quantity."""
    joined = lines.join(products.select(F.col(key).alias("__k"), F.col(price).alias("__p")), F.col(product) == F.col("__k"), "left")
    return joined.groupBy(order).agg(F.count("*").alias("n_lines"), F.count_if(F.col("__k").isNull()).alias("n_unknown"), F.coalesce(F.sum(F.col("__p") * F.col(quantity)), F.lit(0.0)).alias("total"))


def counters(state: DataFrame, calls: DataFrame, key: str, count: str) -> DataFrame:
    """state (key, count) after the calls: each adds one to its key's count, a new key starts at 0; a null key is left out."""
    added = calls.groupBy(key).agg(F.count("*").alias(count))
    return state.select(key, count).unionByName(added).where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(count).alias(count))


def trades_return(portfolios: DataFrame, value: str, start: float = 10000.0) -> DataFrame:
    """Adds gain over the starting value and gain_percent."""
    return portfolios.withColumn("gain", F.col(value) - start).withColumn("gain_percent", F.col("gain") * 100.0 / start)


def chosen(tasks: DataFrame, task: str, injections: DataFrame, injection: str, seed: int) -> DataFrame:
    """task, injection: one injection for each task, drawn by a hash of seed and task, so that a rerun draws the same. Injections are
    numbered in order and met by number: neither side is paired with all of the other. Without injections no task has one; null keys
    have and are none."""
    listed = running(injections.where(F.col(injection).isNotNull()).select(injection).distinct(), [injection], {"__nth": F.lit(1)})
    n = listed.agg(F.count("*").alias("__n"))
    drawn = tasks.where(F.col(task).isNotNull()).select(task).join(F.broadcast(n), F.lit(True)).where("__n > 0")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(task).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return drawn.withColumn("__nth", number % F.col("__n") + 1).join(listed, "__nth").select(task, injection)


def failed_id(error: Column) -> Column:
    """The first id of a tool's use that the text of an error names, null without one."""
    return F.nullif(F.regexp_extract(error, "'tool_use_id': '([^']+)'", 1), F.lit(""))


def without_failed(calls: DataFrame, call_id: str, errors: DataFrame, error: str) -> DataFrame:
    """The calls whose id no error names; a call without an id stays."""
    failed = errors.select(failed_id(F.col(error)).alias("__failed")).where("__failed IS NOT NULL").distinct()
    return calls.join(failed, F.col(call_id) == F.col("__failed"), "left_anti")


def safe_path(task_id: Column) -> Column:
    """A task's id as part of a path: letters, digits, _, . and - stay, at most 128 of them; unknown for an empty or null one."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(task_id, r"(?U)[^\w.-]", "_"), 1, 128), F.lit("")), F.lit("unknown"))


def by_suite(reports: DataFrame, suite: str, report: str, size: str) -> DataFrame:
    """suite, n_reports, total (of sizes), last_report. The reports of a suite are not gathered in a row."""
    return reports.groupBy(suite).agg(F.count("*").alias("n_reports"), F.sum(size).alias("total"), F.max(report).alias("last_report"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with the first of the placeholders {name} that it holds, in the order of values, replaced wherever it stands; others
    stay as they are. A null value leaves its placeholder."""
    for name, value in values.items():
        if (place := f"{{{name}}}") in template:
            return F.coalesce(F.replace(F.lit(template), F.lit(place), value.cast("string")), F.lit(template))
    return F.lit(template)


#: What the name of a run says that a detector went without.
WITHOUT = {"threats": "-woeas", "source_code": "-wosourcecode", "policies": "-wopolicy", "triage": "-wotriage"}


def configuration(name: Column) -> Column:
    """struct of booleans, which parts a run had on, from the endings of its name, in any order."""
    return F.struct(*[(~F.contains(name, F.lit(ending))).alias(part) for part, ending in WITHOUT.items()])


def run_name(base: str, **parts: bool) -> str:
    """A run's name with the endings of the parts that are off, in the fixed order."""
    return base + "".join(ending for part, ending in WITHOUT.items() if not parts.get(part, True))
