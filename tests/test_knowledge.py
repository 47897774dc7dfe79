"""Globs against fnmatch, percentiles against numpy, and the sinks read back."""

import fnmatch
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import evaluation, knowledge, monitoring, statistics
from tracewright.sources import export


@pytest.mark.parametrize("pattern", ["*", "a*", "*.b", "a?c", "[a-c]x", "[!a-c]x", "a.b", "a+(b)", "[", "a[", "[]x]", "x&&y", "", "[^a]x", "a\nb*"])
def test_glob(spark, pattern):
    values = ["", "a", "abc", "a.b", "axb", "ax", "dx", "a+(b)", "[", "a[", "]x", "x&&y", "^x", "a\nbc", "aXc"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v for r in rows.where(knowledge.glob(F.col("v"), pattern)).collect()}
    assert got == {v for v in values if fnmatch.fnmatchcase(v, pattern)}


def test_lookup_names_what_there_is(spark):
    known = spark.createDataFrame([("a_b", 1), ("c", 2)], "name string, id int")
    wanted = spark.createDataFrame([("a-b",), ("c",), ("d",), (None,)], "w string")
    got = {r.w: (r.match and r.match.id, r.status, r.available) for r in knowledge.looked_up(wanted, "w", known, "name").collect()}
    missing = (None, "not_found", ["a_b", "c"])
    assert got == {"a-b": (1, "found", None), "c": (2, "found", None), "d": missing, None: missing}


def test_filters_that_ask_nothing(spark):
    rows = spark.createDataFrame([(1, "A"), (2, None)], "id int, c string")
    assert knowledge.in_categories(rows, "c").count() == knowledge.in_ranges(rows, "id", "").count() == monitoring.matching(rows, id=None).count() == 2
    assert knowledge.any_keyword(rows, ("c",), ()).count() == 0
    assert [r.id for r in knowledge.any_keyword(rows, ("c",), ("a", "A")).collect()] == [1]


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {"one": [3.0], "ties": [1.0] * 300 + [2.0] * 7, "many": rng.normal(size=3000).tolist(), None: rng.normal(size=50).round(1).tolist()}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    got = {r.g: r for r in evaluation.spread(rows, "v", "g").collect()}
    for g, vs in groups.items():
        assert [got[g].median, got[g].p95, got[g].p99, got[g].n] == pytest.approx([*np.percentile(vs, [50, 95, 99]), len(vs)])
    places = {r.g: r for r in statistics.index_quartiles(rows, "g", "v").collect()}
    for g, vs in groups.items():
        q1, q3 = sorted(vs)[len(vs) // 4], sorted(vs)[3 * len(vs) // 4]
        assert (places[g].q1, places[g].q3, places[g].n) == (q1, q3, len(vs))
        assert places[g].n_outliers == sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in vs)
    assert evaluation.spread(rows.limit(0), "v", "g").count() == statistics.index_quartiles(rows.limit(0), "g", "v").count() == 0


def events(spark):
    rows = [("s1", " hi ", {"a": "b"}, []), ("s2", "  ", {}, ["x"]), ("s3", None, None, None)]
    return spark.createDataFrame(rows, "session_id string, text string, extra map<string,string>, tools array<string>")


PRUNED = [{"session_id": "s1", "text": "hi", "extra": {"a": "b"}, "tools": []}, {"session_id": "s2", "tools": ["x"]}, {"session_id": "s3"}]


def test_lines_and_envelope(spark, tmp_path):
    export.write_lines(events(spark), str(tmp_path / "lines"))
    assert sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()), key=str) == sorted(PRUNED, key=str)
    lines = export.envelope(events(spark), F.lit("2024-01-01T00:00:00")).orderBy("ord").collect()
    whole = json.loads("".join(r.value for r in lines))
    assert (whole["timestamp"], whole["total_entries"]) == ("2024-01-01T00:00:00", 3)
    assert sorted(whole["entries"], key=str) == sorted(PRUNED, key=str)
    empty = export.envelope(events(spark).limit(0), F.lit("t")).orderBy("ord").collect()
    assert json.loads("".join(r.value for r in empty)) == {"timestamp": "t", "total_entries": 0, "entries": []}


def test_a_file_for_each_session(spark, tmp_path):
    name = F.when(F.col("session_id") != "s3", F.concat(F.lit("adr."), "session_id", F.lit(".20240101_000000")))
    export.write_sessions(events(spark).withColumn("file", name), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("file=*")) == ["file=adr.s1.20240101_000000", "file=adr.s2.20240101_000000"]
    back = spark.read.text(str(tmp_path / "out")).where("file LIKE 'adr.s1%'").collect()
    assert [json.loads(r.value) for r in back] == PRUNED[:1]


def test_dead_letters(spark):
    rows = spark.createDataFrame([("a", "{}"), ("b", "{broken"), ("c", None)], "source string, raw string")
    got = sorted(json.loads(r.value)["source"] for r in export.dead_letters(rows, "raw", "source").collect())
    assert got == ["b", "c"]


def test_recent_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    files = spark.read.text(str(tmp_path))
    assert export.recent_files(files, 14, F.current_timestamp()).count() == 1
    assert export.recent_files(files, 14, F.expr("current_timestamp() + INTERVAL 30 DAYS")).count() == 0
