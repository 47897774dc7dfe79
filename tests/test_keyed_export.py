"""The keyed export against the batch rule over a replayed stream, with restarts and a table that was exported before."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import sessions
from tracewright.streaming import keyed

SCHEMA = "session_id string, ts timestamp, value long"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    had = {name: spark.conf.get(name) for name in keyed.SETTINGS}
    for name, value in keyed.SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in had.items():
        spark.conf.set(name, value)


def replay(batches, exported=()):
    """Of plain rows what sessions.unseen passes, batch after batch."""
    last, out = {}, []
    for s, t in exported:
        last[s] = max(last.get(s, T0 - timedelta(days=9)), t.replace(microsecond=0))
    for batch in batches:
        newest = {}
        for row in batch:
            if row[0] not in newest or row[1] > newest[row[0]][1]:
                newest[row[0]] = row
        for s, row in newest.items():
            if s not in last or row[1].replace(microsecond=0) > last[s]:
                last[s] = row[1].replace(microsecond=0)
                out.append(row)
    return sorted(out)


def test_replay_restarts_and_bootstrap(spark, store, tmp_path):
    rng = random.Random(3)
    batches = [[(f"s{rng.randrange(6)}", T0 + timedelta(milliseconds=rng.randrange(12_000) + 3000 * b), 100 * b + k) for k in range(12)] for b in range(5)]
    exported = [("s0", T0 + timedelta(seconds=6.5)), ("s0", T0), ("s1", T0 + timedelta(days=1)), ("other", T0)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    before = spark.createDataFrame(exported, "session_id string, ts timestamp")

    def run():
        stream = keyed.unseen(spark.readStream.schema(SCHEMA).parquet(source), exported=before)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    for batch in batches:  # each batch is met by a query of its own, which starts again from the checkpoint
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == replay(batches, exported) and 0 < len(got) < 30
    assert not [r for r in got if r[0] == "s1"]
    run()
    assert spark.read.parquet(out).count() == len(got)


def test_first_batch_agrees_with_the_batch_operator(spark, store, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + timedelta(seconds=5), 2), ("b", T0, 3), (None, T0, 4), ("c", None, 5), ("d", T0 + timedelta(milliseconds=900), 6)]
    before = spark.createDataFrame([("b", T0), ("d", T0)], "session_id string, ts timestamp")
    source = spark.createDataFrame(rows, SCHEMA)
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = keyed.unseen(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), exported=before)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    latest = source.groupBy("session_id").agg(F.max_by(F.struct("*"), F.coalesce("ts", F.lit(datetime(1970, 1, 1)))).alias("r")).select("r.*")
    assert got == {tuple(r) for r in sessions.unseen(latest, before).collect()} == {("a", T0 + timedelta(seconds=5), 2), (None, T0, 4), ("c", None, 5)}
