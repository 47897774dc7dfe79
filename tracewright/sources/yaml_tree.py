"""YAML files, with other files included by a tag, as a Spark data source; and the stores that the knowledge operators take."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import yaml
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class IncludeError(ValueError):
    """An include that leads out of the root folder, back to a file that includes it, or nowhere."""


def load(files: fs.FileSystem, path: str, root: str, above: tuple[str, ...] = ()) -> object:
    """The value of a YAML file. `!include name` stands for the value of a YAML or JSON file, or the text of any other, by its place
    beside the file that includes it; all of them lie under root. A file may be included often, but not by itself."""
    path = posixpath.normpath(path)
    if path != root and not path.startswith(root.rstrip("/") + "/"):
        raise IncludeError(f"{path} is outside of {root}")
    if path in above:
        raise IncludeError(" includes ".join([*above[above.index(path) :], path]))
    try:
        with files.open_input_stream(path) as f:
            text = f.read().decode("utf-8")
    except FileNotFoundError:
        raise IncludeError(f"{path} does not exist") from None
    if path.endswith(".json"):
        return json.loads(text)
    if not path.endswith((".yaml", ".yml")) and above:
        return text

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!include", lambda loader, node: load(files, posixpath.join(posixpath.dirname(path), loader.construct_scalar(node)), root, (*above, path)))
    return yaml.load(text, Loader)  # noqa: S506  a safe loader


def entries(value: object, at: str) -> Iterator[tuple[str | None, object]]:
    """key, item for each item of the list or mapping that stands at the keys of `at` (parted by dots; none: the whole value), of any
    other value one without a key. Nothing there gives nothing."""
    for key in filter(None, at.split(".")):
        value = value.get(key) if isinstance(value, dict) else None
    if isinstance(value, list):
        yield from ((None, v) for v in value)
    elif isinstance(value, dict):
        yield from ((str(k), v) for k, v in value.items())
    elif value is not None:
        yield None, value


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class YamlSource(DataSource):
    """Options: path (a file, or a folder with its *.yaml and *.yml files; any URI that pyarrow opens), root (what includes may not
    leave; the folder by default), at (see entries). Rows are file, key, pos (from 0 in a file), item (JSON). One task reads a file."""

    @classmethod
    def name(cls) -> str:
        return "yaml"

    def schema(self) -> str:
        return "file string, key string, pos int, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.at, self.path = options.get("at", ""), options["path"]
        self.root = options.get("root")

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        files, path = fs.FileSystem.from_uri(self.path)
        is_file = files.get_file_info(path).type == fs.FileType.File
        root = fs.FileSystem.from_uri(self.root)[1] if self.root else posixpath.dirname(path) if is_file else path
        return files, path, posixpath.normpath(root)

    def partitions(self) -> list[InputPartition]:
        files, path, _ = self._open()
        if files.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.extension in ("yaml", "yml")]

    def read(self, partition: _File) -> Iterator[tuple]:
        files, _, root = self._open()
        for pos, (key, item) in enumerate(entries(load(files, partition.path, root), self.at)):
            yield partition.path, key, pos, json.dumps(item, default=str, ensure_ascii=False)


def read(spark: SparkSession, path: str, at: str = "", root: str | None = None) -> DataFrame:
    spark.dataSource.register(YamlSource)
    reader = spark.read.format("yaml").option("path", path).option("at", at)
    return (reader.option("root", root) if root else reader).load()


def policies(spark: SparkSession, path: str) -> DataFrame:
    """name, description, category, who_affected, what_changed, policy, risk_areas: one row per policy."""
    schema = "name string, description string, category string, who_affected string, what_changed string, policy string, risk_areas array<string>"
    return read(spark, path, "policies").select(F.from_json("item", schema).alias("p")).select("p.*")


def techniques(spark: SparkSession, path: str) -> DataFrame:
    """tactic, tactic_description, id, name, description, guidance: one row per technique; a tactic without techniques has none."""
    schema = "description string, techniques array<struct<id:string,name:string,description:string,detection_guidance:array<string>>>"
    rows = read(spark, path, "threat_framework.tactics").select(F.col("key").alias("tactic"), F.from_json("item", schema).alias("t"))
    rows = rows.select("tactic", F.col("t.description").alias("tactic_description"), F.explode("t.techniques").alias("x"))
    return rows.select("tactic", "tactic_description", "x.id", "x.name", "x.description", F.col("x.detection_guidance").alias("guidance"))


def servers(spark: SparkSession, path: str) -> DataFrame:
    """name, path, category, description, capabilities: one row per registered server."""
    schema = "name string, path string, category string, description string, capabilities array<string>"
    return read(spark, path, "mcp_servers").select(F.from_json("item", schema).alias("s")).select("s.*")
