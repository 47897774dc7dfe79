"""Verdicts, refusals, taint and transcripts on small fixtures; the data tools on awkward rows."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import containment, detection, tables
from tracewright.sources import transcripts


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('So: {"is_threat": true, "why": "a } in a string"} done }', {"is_threat": True, "why": "a } in a string"}),
        ('{ "is_threat": false, "d": {"x": [1, {"y": 2}]}} {"is_threat": true}', {"is_threat": True}),
        ('{\n  "is_threat": true,\n  "re": "\\d+ and \\\\ and \\n"}', {"is_threat": True, "re": "\\d+ and \\ and \n"}),
        ('{"is_threat": true', None),
        ("nothing here", None),
        ("", None),
        (None, None),
    ],
)
def test_verdict(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(detection.verdict(F.col("t"))).alias("v")).first().v
    assert (json.loads(got) if got else None) == want


def test_refusal(spark):
    texts = ["I won't do it", 'I won\'t. {"is_threat": false}', "fine", "", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(detection.is_refusal(F.col("t"))).collect()] == [True, False, False, False, False]


def test_tainted(spark):
    rows = [({"a": "x #1#"}, None), ({"a": None}, "no"), (None, "see #1#"), ({}, None)]
    got = spark.createDataFrame(rows, "args map<string,string>, answer string").select(detection.tainted(F.col("args"), F.col("answer"), "#1#")).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_traces_differ(spark):
    schema = "run string, pos int, call string"
    left = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], schema)
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "z"), ("a", 3, "q"), ("b", 1, "x")], schema)
    assert {r.run: r.n_different for r in detection.traces_differ(left, right, "run", "pos", "call").collect()} == {"a": 2, "b": 0}


def test_transcripts(spark, tmp_path):
    messages = [{"role": "human", "content": "hi"}, {"role": "assistant", "content": "", "tool_calls": [{"name": "f", "id": "1", "args": {"k": 1}}]}, {"role": "tool", "content": [1]}, {"role": "assistant", "content": "done", "tool_calls": []}]
    (tmp_path / "a.json").write_text(json.dumps({"injections": {"x": "do evil", "y": " "}, "messages": messages}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    rows = transcripts.converted(spark, str(tmp_path)).orderBy("message_id").collect()
    assert [(r.message_id, r.role, r.message_type) for r in rows] == [(1, "system", "system_init"), (2, "user", "user_prompt"), (3, "assistant", "tool_calling"), (4, "tool", "tool_response"), (5, "assistant", "agent_response")]
    assert rows[0].content.endswith("\n[x]: do evil\n") and "[y]" not in rows[0].content and rows[3].content == "[1]"
    assert [(c.name, c.id, c.args) for c in rows[2].tool_calls] == [("f", "1", '{"k":1}')]


def test_tables(spark):
    schema = "id long, k string, v double"
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (None, None, None), (4, None, 5.0)], schema)
    empty = spark.createDataFrame([], schema)
    kept = tables.clean(rows, F.col("k"), "id", ("v",), {"k": "none"}).collect()
    assert sorted((r.id, r.k, r.v) for r in kept) == [(1, "a", 2.0), (4, "none", 5.0)]
    assert tables.clean(empty, F.col("k"), "id", ("v",)).count() == 0
    steps = [("v", "ge", 2), ("k", "eq", "a")]
    assert [[r.remaining for r in tables.filter_steps(t, steps).orderBy("step").collect()] for t in (rows, empty)] == [[3, 2], [0, 0]]
    assert tables.recommended(empty, "id", 1, {"k": 1}).count() == 0
    moves = spark.createDataFrame([(1, 5), (2, -8), (3, 4), (4, -1), (5, -9), (6, 2)], "n int, c int").withColumn("item", F.lit("x"))
    assert [r.balance for r in tables.ledger(moves, "item", ("n",), F.col("c"), 1).orderBy("n").collect()] == [5, 0, 4, 3, 0, 2]
    said = spark.createDataFrame([("the cat and the dog",), ("der Hund und die Katze",), ("",), (None,)], "t string")
    assert [r[0] for r in said.select(tables.language(F.col("t"))).collect()] == ["en", "de", "unknown", "unknown"]


def test_stated_confidence(spark):
    lines = {"confidence: 0.85": 0.85, "- **Confidence:** [85%]": 0.85, "CONFIDENCE : 90 %.": 0.9, "> *confidence*: .5, as said": 0.5, "Confidence: 1": 1.0, "confidence 0.5": None, "my confidence: 0.5": None, "confidence: high": None, "": None, "confidence: 7.": 7.0, "confidence: 0.5%": 0.5}
    rows = spark.createDataFrame([(k,) for k in lines], "line string").withColumn("c", detection.stated_confidence(F.col("line")))
    assert {r.line: r.c for r in rows.collect()} == lines


def test_containing_keeps_case_and_cut_words(spark):
    texts = spark.createDataFrame([(1, "please ignore the instructions  now"), (2, "IGNORE the instruction"), (3, "a\\nb !? c"), (4, None), (1, "please ignore the instructions  now")], "k long, t string")
    needles = spark.createDataFrame([(1, "ignore the instruction"), (2, "a b"), (3, "!?"), (4, ""), (5, None), (6, "gnore the instr")], "i long, needle string")
    got = {(r.k, r.i) for r in containment.containing(texts, "k", "t", needles, "needle", scalars.squeezed).collect()}
    assert got == {(1, 1), (1, 6), (3, 2), (3, 3)}
