"""Texts against Python's own functions, and runs with nulls, empty tables and repeated rows."""

import string

import pytest
from pyspark.sql import functions as F

from tracewright.functions import texts
from tracewright.operators import runs, sessions

TEXTS = ["", "hello world", "they're 3rd-rate x2y ÉCOLE", "a\nB\tc", "UPPER lower!", "*[~]*", None]
PYTHON = {"uppercase": str.upper, "lowercase": str.lower, "title_case": str.title, "sentence_case": str.capitalize, "reverse": lambda t: t[::-1], "remove_punctuation": lambda t: t.translate(str.maketrans("", "", string.punctuation))}


@pytest.mark.parametrize("kind", PYTHON)
def test_transformed(spark, kind):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", texts.transformed(F.col("t"), kind).alias("got")).collect()
    assert {r.t: r.got for r in rows} == {t: None if t is None else PYTHON[kind](t) for t in TEXTS}


def test_utc_offset(spark):
    degrees = [-180.0, -172.5, -7.5, 0.0, 7.5, 22.5, 37.5, 180.0, 400.0, -400.0]
    rows = spark.createDataFrame([(d,) for d in degrees], "d double").select("d", texts.utc_offset(F.col("d")).alias("h")).collect()
    assert {r.d: r.h for r in rows} == {d: max(-12, min(14, round(d / 15))) for d in degrees}


def test_votes(spark):
    rows = spark.createDataFrame([("Happy, happy and sad",), ("mad but afraid",), ("nothing",), ("",), (None,)], "t string")
    got = {r.t: r.v.best for r in rows.select("t", texts.votes(F.col("t")).alias("v")).collect()}
    assert got == {"Happy, happy and sad": "joy", "mad but afraid": "anger", "nothing": "neutral", "": "neutral", None: "neutral"}


def test_complexity(spark):
    rows = spark.createDataFrame([("# note\n\n  if a and b:\n\tx = 1  # for",), ("",), ("\n \n",), (None,)], "t string")
    got = {r.t: tuple(r.c)[:5] for r in rows.select("t", texts.complexity(F.col("t"), F.lit(0)).alias("c")).where("t IS NOT NULL").collect()}
    assert got == {"# note\n\n  if a and b:\n\tx = 1  # for": (4, 3, 1, 1, 4), "": (1, 0, 0, 1, 1), "\n \n": (3, 0, 0, 3, 1)}


def test_remaining(spark):
    tasks = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    done = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    left = lambda *a: sorted((r.k or 0) for r in runs.remaining(tasks, *a).collect())
    assert left(done, "k") == [0, 2, 2]
    assert left(done, "k", True) == left(done.limit(0), "k") == [0, 1, 2, 2]


def test_counters_and_tools(spark):
    state = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    calls = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "k string")
    assert sorted(map(tuple, runs.counters(state, calls, "k", "n").collect())) == [("a", 4), ("b", 1), ("c", 2)]
    messages = spark.createDataFrame([("s", 0, "user", "x", 1), ("s", 1, "assistant", None, 0), ("t", 0, "assistant", "y", 2)], "session_id string, seq int, role string, content string, n_tools int")
    assert [r.session_id for r in runs.with_tools(sessions.fold(messages)).collect()] == ["t"]


def test_order_lines(spark):
    lines = spark.createDataFrame([(1, "p", 2.0), (1, "q", 1.0), (2, None, 5.0)], "o int, p string, n double")
    products = spark.createDataFrame([("p", 1.5)], "k string, price double")
    assert sorted(map(tuple, runs.order_lines(lines, "p", "n", products, "k", "price", "o").collect())) == [(1, 2, 1, 3.0), (2, 1, 1, 0.0)]
