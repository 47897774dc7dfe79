"""Finished benchmark runs: which is the newest, whether its files are those of its kind, and its logs numbered from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.progress import running
from tracewright.operators.storage import kept
from tracewright.sources import transcripts

GROUND_TRUTH = "ground_truth.json"


class LayoutError(ValueError):
    pass


def files(spark: SparkSession, folder: str) -> DataFrame:
    """run (the first folder below), file (the path below that): the files under a folder, by Spark's own listing, contents unread."""
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    path = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path"))
    below = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    return path.select("path", below.alias("below")).select("path", F.split_part("below", F.lit("/"), F.lit(1)).alias("run"), F.regexp_replace("below", "^[^/]*/?", "").alias("file"))


def newest(spark: SparkSession, folder: str, prefix: str) -> str:
    """The name of the last run of a kind: the greatest one that begins with the prefix, since names end with their time. Folders
    without a file do not count."""
    name = files(spark, folder).where(F.col("run").startswith(prefix) & (F.col("file") != "")).agg(F.max("run")).first()[0]
    if name is None:
        raise FileNotFoundError(f"no run named {prefix}... in {folder}")
    return name


def checked(spark: SparkSession, folder: str, run: str, with_ground_truth: bool) -> str:
    """The run's path, if a file of labels lies in it exactly where its kind has one; LayoutError otherwise."""
    has = not files(spark, folder).where((F.col("run") == run) & (F.col("file") == GROUND_TRUTH)).isEmpty()
    if has != with_ground_truth:
        raise LayoutError(f"{run} {'lacks' if with_ground_truth else 'should not have'} a {GROUND_TRUTH}")
    return f"{folder.rstrip('/')}/{run}"


def task_id(number: Column) -> Column:
    """task_001, task_002, ...; from 1000 on as long as it has to be."""
    text = number.cast("string")
    return F.concat(F.lit("task_"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")))


def numbered(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """file, number, task_id and what the log says of itself (suite, user_task, injection_task, security, utility, is_malicious): the
    logs with a message, numbered from 1 without gaps in the order of their paths.

    Numbers are prefix sums over ranges of paths, so that they do not depend on the number of tasks. Files that are no JSON, or without
    messages, have no number. A log that does not say whether its injection came through counts as if it had."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    said = rows.where(F.size(field("messages", "array<variant>")) > 0).select(
        "file",
        field("suite_name", "string").alias("suite"),
        field("user_task_id", "string").alias("user_task"),
        field("injection_task_id", "string").alias("injection_task"),
        F.coalesce(field("security", "boolean"), F.lit(True)).alias("security"),
        F.coalesce(field("utility", "boolean"), F.lit(False)).alias("utility"),
    )
    out = running(said, ["file"], {"number": F.lit(1)})
    return out.withColumns({"task_id": task_id(F.col("number")), "is_malicious": F.col("security")})


def conversations(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """The messages of all numbered logs (see transcripts.converted) with their task_id and is_malicious."""
    tasks = kept(numbered(spark, path, names)).select("file", "task_id", "is_malicious")
    return transcripts.converted(spark, path, names).join(tasks, "file")


def with_ground_truth(verdicts: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """Verdicts with their label; one without fails the job with its key, where evaluation.judged() leaves it out."""
    own = truth.select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    joined = verdicts.join(own, F.col(key) == F.col("__key"), "left")
    missing = F.raise_error(F.concat(F.lit("no ground truth for "), F.coalesce(F.col(key).cast("string"), F.lit("a null key"))))
    value = F.coalesce("__label", missing.cast(dict(truth.dtypes)[label]))
    return joined.select(*verdicts.columns, value.alias(label))


def listed_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_id, is_malicious, description, prompt, servers, expected_tools, technique, tactic: the tasks of a file with a list of them. A
    task without a label is benign, one without a number is none."""
    schema = "tasks array<struct<task_id:int,description:string,user_prompt:string,mcp_servers:array<string>,expected_tools:array<string>,ground_truth:string,threat_technique:string,threat_tactic:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("tasks").alias("t")).where("t.task_id IS NOT NULL")
    told = F.coalesce(F.col("t.ground_truth"), F.lit("benign")) == "malicious"
    return rows.select(task_id(F.col("t.task_id")).alias("task_id"), told.alias("is_malicious"), "t.description", F.col("t.user_prompt").alias("prompt"), F.col("t.mcp_servers").alias("servers"), "t.expected_tools", F.col("t.threat_technique").alias("technique"), F.col("t.threat_tactic").alias("tactic"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """task_id, is_malicious: the labels of a run's own file, an object by task. Keys other than those of tasks are no labels; numbers
    get three digits at least."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("key", "v"))
    number = F.regexp_extract("key", "^task_([0-9]+)", 1).try_cast("long")
    return rows.where(number.isNotNull()).select(task_id(number).alias("task_id"), F.try_variant_get("v", "$.is_malicious", "boolean").alias("is_malicious"))


def task_results(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, suite, user_task, attack, injection_task, result (variant): the results under a folder, by their place
    <pipeline>/<suite>/<user task>/<attack>/<injection task>.json. A file that is no JSON has a null result."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parts = F.slice(F.split(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", ""), "/"), -5, 5)
    names = ("pipeline", "suite", "user_task", "attack", "injection_task")
    return rows.select(*[F.url_decode(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)], F.try_parse_json("value").alias("result"))


def debug_logs(spark: SparkSession, path: str, endings: dict[str, str]) -> DataFrame:
    """task_id, stage, log (variant): the logs of detector calls in a folder, named <task>_<ending>.json; endings tells the stage of
    each ending. Other files are not read."""
    out = None
    for stage, ending in endings.items():
        rows = spark.read.option("pathGlobFilter", f"task_*_{ending}.json").text(path, wholetext=True)
        name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        part = rows.select(F.regexp_replace(name, rf"_{ending}\.json$", "").alias("task_id"), F.lit(stage).alias("stage"), F.try_parse_json("value").alias("log"))
        out = part if out is None else out.unionByName(part)
    return out


def calendar(spark: SparkSession, path: str, events: str) -> DataFrame:
    """The events of a file with a list of them, with the given schema; a single object is a list of one, a file that is no JSON has
    none."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{events}>>").alias("events"))
    return rows.select(F.inline("events"))
