"""Counters, containment, overlaps, farthest points, nested values and outside calls against brute force."""

import json
import math
import random
import threading
import time
from datetime import datetime, timedelta
from functools import partial

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright.functions import expressions, scalars
from tracewright.operators import containment, farthest, intervals, progress, scoring, variants
from tracewright.plans import catalog, detectors

T0 = datetime(2024, 1, 1)


# Overlaps


def plain_overlaps(rows):
    ok = [r for r in rows if None not in r and r[2] <= r[3]]
    return sorted({tuple(sorted((a[0], b[0]))) for a in ok for b in ok if a[0] != b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]})


@pytest.mark.parametrize("whole", [False, True])
def test_overlaps_of_any_length(spark, whole):
    rng = random.Random(1)
    lengths = [0, 1, 1, 7, 60, 3600, 86400 * 20]
    rows = []
    for k in range(260):
        start = rng.randrange(-86400 * 30, 86400 * 30) if k % 3 else rng.randrange(40)
        rows.append((k, rng.choice("ab"), start, start + rng.choice(lengths)))
    rows += [(900, None, 0, 9), (901, "a", None, 9), (902, "a", 0, None), (903, "a", 9, 0), (904, "a", 5, 5), (905, "a", 0, 10), (906, "a", 10, 20), (906, "a", 10, 20), (None, "a", 0, 9)]
    at = (lambda s: s) if whole else (lambda s: None if s is None else T0 + timedelta(seconds=s))
    kind = "long" if whole else "timestamp"
    df = spark.createDataFrame([(i, g, at(s), at(e)) for i, g, s, e in rows], f"i long, g string, s {kind}, e {kind}").repartition(5)
    got = [tuple(r) for r in intervals.overlaps(df, "i", "s", "e", "g").collect()]
    assert sorted(set(got)) == plain_overlaps(rows) and (904, 905) in got
    assert len([p for p in got if 906 not in p]) == len({p for p in got if 906 not in p})


def test_overlaps_meet_few_others(spark):
    """Short intervals that follow one another beside a few long ones: what meets in bins stays near what overlaps."""
    rows = [(k, k * 10, k * 10 + 9) for k in range(4000)] + [(10_000 + k, k * 13_000, k * 13_000 + 12_000) for k in range(3)]
    df = spark.createDataFrame(rows, "i long, s long, e long")
    got = intervals.overlaps(df, "i", "s", "e").count()
    assert got == sum(1 for k, s, e in rows[:4000] for _, s2, e2 in rows[4000:] if s < e2 and s2 < e)


def test_overlaps_without_rows_or_groups(spark):
    df = spark.createDataFrame([], "i long, s long, e long")
    assert intervals.overlaps(df, "i", "s", "e").collect() == []


# Counters


def plain_progress(rows):
    c, out = dict.fromkeys(progress.COUNTERS, 0), []
    for _, p, a, e in sorted(rows, key=lambda r: r[0]):
        if p is None or a is None:
            c["dropped"] += 1
        else:
            c[{(1, 1): "tp", (0, 0): "tn", (1, 0): "fp", (0, 1): "fn"}[int(p), int(a)]] += 1
            c["escalated"] += bool(e)
        out.append(tuple(c.values()))
    return out


def results(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(f"f{k:05}", rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([True, False, None])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "file string, p boolean, a boolean, e boolean")


@pytest.mark.parametrize("parts", [1, 13])
def test_progress(spark, parts):
    rows, df = results(spark, 700)
    out = progress.progress(df.repartition(parts), ["file"], F.col("p"), F.col("a"), F.col("e")).orderBy("file").collect()
    assert [tuple(r[k] for k in progress.COUNTERS) for r in out] == plain_progress(rows)
    last = out[-1]
    scored = last.tp + last.tn + last.fp + last.fn
    assert last.completed == 700 and last.accuracy == pytest.approx((last.tp + last.tn) * 100 / scored)
    assert "Window" not in progress.progress(df.limit(0), ["file"], F.col("p"), F.col("a"), F.col("e")).collect().__repr__()


def test_running_with_equal_places_and_nulls(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(200)], "o long, v long")
    out = progress.running(df.repartition(9), ["o"], {"upto": F.col("v")}).collect()
    for o in (None, 0, 1, 2):
        before = sum(r.v for r in out if (r.o is not None and o is not None and r.o < o) or (r.o is None and o is not None))
        own = sorted(r.upto for r in out if r.o == o)
        assert own[-1] == before + sum(r.v for r in out if r.o == o)
    assert {r.v: r.upto for r in progress.running(df.repartition(2), ["o"], {"upto": F.col("v")}).collect()} == {r.v: r.upto for r in out}


def test_streamed_progress(spark, tmp_path):
    """The listener's totals over two runs of a stream are those of the batch form; a restart tells no batch anew."""
    heard = progress.Progress()
    spark.streams.addListener(heard)
    try:
        told = []
        for seed in (1, 2):
            rows, df = results(spark, 150, seed)
            told += [(f"{seed}{f}", p, a, e) for f, p, a, e in rows]
            df.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = progress.observed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), F.col("p"), F.col("a"), F.col("e"))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            for _ in range(100):
                if sum(heard.totals()[k] for k in ("tp", "tn", "fp", "fn", "dropped")) == len(told):
                    break
                time.sleep(0.1)
            assert tuple(heard.totals().values()) == plain_progress(told)[-1]
    finally:
        spark.streams.removeListener(heard)


# Farthest points


def km(a, b):
    (p, q), (r, s) = a, b
    x = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(max(0, 1 - x)))


@pytest.mark.parametrize("kind", ["globe", "city", "poles", "line", "clusters"])
def test_farthest_pair(spark, monkeypatch, kind):
    monkeypatch.setattr(farthest, "LEAST_PAIRS", 2000)
    rng = random.Random(7)
    make = {
        "globe": lambda k: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)),
        "city": lambda k: (52 + rng.random() / 50, 179.99 + rng.random() / 50),
        "poles": lambda k: (rng.choice([89.9, -89.95, 90.0]) - rng.random() / 100, rng.uniform(-180, 540)),
        "line": lambda k: (0.0, k * 0.02),
        "clusters": lambda k: (rng.choice([10, -40]) + rng.random(), rng.choice([0, 100, -75]) + rng.random()),
    }[kind]
    rows = [(k, *make(k)) for k in range(900)]
    df = spark.createDataFrame([*rows, (5000, None, 1.0), (5001, 1.0, None), (None, 80.0, 1.0), (5002, 91.0, 0.0)], "k long, lat double, lon double")
    got = farthest.farthest(df, "k", "lat", "lon").first()
    at = {k: (la, lo) for k, la, lo in rows if abs(la) <= 90}
    best = max(km(a, b) for a in at.values() for b in at.values())
    assert got.km == pytest.approx(best, abs=1e-6) and km(at[got.a], at[got.b]) == pytest.approx(best, abs=1e-6)
    assert got.a < got.b and got.n_compared < len(at) ** 2 / 5


def test_farthest_of_few(spark):
    make = lambda rows: farthest.farthest(spark.createDataFrame(rows, "k long, lat double, lon double"), "k", "lat", "lon").collect()
    assert make([]) == [] and make([(1, None, None)]) == []
    assert [tuple(r)[:4] for r in make([(3, 1.0, 1.0), (2, 1.0, 1.0)])] == [(2, 2, 0.0, 1)]
    assert make([(1, 0.0, 0.0), (2, 0.0, 180.0), (3, 0.0, 90.0)])[0][:3] == (1, 2, pytest.approx(math.pi * 6371))


def test_farthest_ranks_by_the_haversine(spark):
    """Kilometres round both pairs to the same number, and turning by 180 degrees rounds both longitudes to one."""
    near, far = 60.3, 60.30000000000001
    assert km((0, 0), (0, near)) == km((0, 0), (0, far)) and (near + 180) - 180 == (far + 180) - 180
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, near), (3, 0.0, far), (4, 0.0, far)], "k long, lat double, lon double")
    got = farthest.farthest(df, "k", "lat", "lon").first()
    assert (got.a, got.b, got.n_points) == (1, 3, 3)


def test_farthest_pair_with_a_haversine_over_one(spark, tmp_path):
    """Of the opposite pairs (118, 69118) and (599, 50622) the second has the larger haversine, by rounding over 1; half the circumference all the same."""
    customer = pa.table({"c_custkey": [118, 69118, 599, 50622, *range(1000, 1200)]})
    pq.write_table(customer, tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.sql(catalog.oracle_sql()["farthest_pair"]).fetchall()[0]
    got = detectors.farthest_pair(spark, str(tmp_path)).first()
    assert (got.a, got.b, got.n_points) == (want[0], want[1], want[3]) == (599, 50622, 204)
    assert got.km == round(math.pi * 6371, 6)


# Containment


@pytest.mark.parametrize("normal", [lambda c: c, scalars.squeezed])
def test_containing_by_brute_force(spark, normal):
    rng = random.Random(6)
    words = ["the", "the", "the", "a", "ab", "\U0001f600", "é", "the  the", "x.y", "zq"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, text(rng.randrange(60))) for k in range(60)] + [(100, ""), (101, None), (102, "the " * 500), (103, "zqzqzq"), (103, "zqzqzq")]
    needles = []
    for k in range(150):
        source = rng.choice(texts)[1] or "the"
        i = rng.randrange(len(source) + 1)
        needles.append((k, source[i : i + rng.randrange(1, 60)] if k % 3 else text(rng.randrange(1, 9))))
    needles += [(200, "the"), (201, "e"), (202, ""), (203, None), (204, "the " * 300), (205, "qz"), (206, "never there at all, whatever one looks for")]
    n = spark.createDataFrame(needles, "i long, needle string")
    t = spark.createDataFrame(texts, "k long, t string").repartition(4)
    got = {(r.k, r.i) for r in containment.containing(t, "k", "t", n, "needle", normal).collect()}
    same = {r.x: r.y for r in spark.createDataFrame([(x,) for x in {x for _, x in texts + needles}], "x string").select("x", normal(F.col("x")).alias("y")).collect()}
    assert got == {(k, i) for k, x in texts for i, y in needles if x is not None and y is not None and same[y] and same[y] in same[x]}


def test_containing_is_not_keyed_by_common_blocks(spark):
    """Needles that share all but one word with every text meet only the texts of that word."""
    texts = spark.range(2000).select("id", F.concat(F.lit("this very common sentence is in each and every text, word "), F.col("id").cast("string"), F.lit(" and so on, as ever")).alias("t"))
    needles = spark.range(0, 2000, 10).select(F.col("id").alias("n"), F.concat(F.lit("every text, word "), F.col("id").cast("string"), F.lit(" and so on")).alias("needle"))
    assert {(r.id, r.n) for r in containment.containing(texts, "id", "t", needles, "needle").collect()} == {(k, k) for k in range(0, 2000, 10)}


def test_leaks(spark):
    texts = spark.createDataFrame([(1, "see <C---a---> here"), (2, "<C---a---> <C---b"), (3, None)], "k long, t string")
    canaries = spark.createDataFrame([("a", "<C---a--->"), ("b", "<C---b--->"), ("none", None)], "name string, c string")
    got = {r.name: (r.n_texts, r.leaked) for r in containment.leaks(texts, "k", "t", canaries, "name", "c").collect()}
    assert got == {"a": (2, True), "b": (0, False), "none": (0, False)}


# Nested values

QUERIES = {
    "person": {"name": "string", "tags": ["string"], "note": "prompt", "home": {"city": "string", "rooms": [{"size": "number"}]}},
    "list": [{"a": "prompt", "b": "string"}],
    "any": "string",
    "empty": [],
    "nothing": {},
}
VALUES = [
    ("person", {"name": "Ann", "tags": ["x", "y"], "note": "hi", "home": {"city": "Rome", "rooms": [{"size": 3}, {"size": 4.5}]}, "extra": 1}),
    ("person", {"name": "Ann", "tags": [], "note": {"deep": [1]}, "home": {"city": None, "rooms": []}}),
    ("person", {"name": "Ann", "tags": ["x"], "note": "hi", "home": {"city": "Rome", "rooms": [{"size": 3}, {}]}}),
    ("person", {"name": "Ann", "tags": "x", "note": "hi", "home": {"city": "Rome", "rooms": []}}),
    ("person", {"name": "Ann", "tags": ["x"], "home": {"city": "Rome", "rooms": []}}),
    ("person", []),
    ("list", [{"a": 'q"\\', "b": "2"}, {"a": "3", "b": {"c": "4"}}]),
    ("list", [{"a": 1, "b": 2}, 5]),
    ("list", {"a": 1, "b": 2}),
    ("list", []),
    ("any", {"x": [1, {"y": 2}]}),
    ("any", "text"),
    ("empty", [1, {"z": 1}]),
    ("empty", {}),
    ("nothing", {"gone": 1}),
    ("nothing", [1]),
    ("unlisted", {"a": 1}),
]


def fits(v, q):
    if isinstance(q, list):
        return isinstance(v, list) and (not q or all(fits(x, q[0]) for x in v))
    if isinstance(q, dict):
        return isinstance(v, dict) and all(k in v and fits(v[k], q[k]) for k in q)
    return True


def cut(v, q):
    if isinstance(q, list):
        return [cut(x, q[0]) for x in v] if q else []
    return {k: cut(v[k], q[k]) for k in sorted(q)} if isinstance(q, dict) else v


def prompts(v, q):
    if isinstance(q, list):
        return [y for x in v for y in prompts(x, q[0])] if q and isinstance(v, list) else []
    if isinstance(q, dict):
        return [y for k in sorted(q) if k in v for y in prompts(v[k], q[k])] if isinstance(v, dict) else []
    return [v] if q == "prompt" else []


def frames(spark, values=VALUES):
    rows = [(k, f"r{k % 2}", q, json.dumps(v)) for k, (q, v) in enumerate(values)] + [(99, "r0", "any", None)]
    df = spark.createDataFrame(rows, "k long, run string, q string, j string").withColumn("v", F.try_parse_json("j")).drop("j")
    queries = spark.createDataFrame([(n, json.dumps(q)) for n, q in QUERIES.items()], "q string, j string").select("q", F.parse_json("j").alias("s"))
    return df, queries


def test_validated(spark):
    df, queries = frames(spark)
    got = {r.k: r.valid for r in variants.validated(df, "k", "v", "q", queries, "s").collect()}
    assert got == {k: q in QUERIES and fits(v, QUERIES[q]) for k, (q, v) in enumerate(VALUES)} | {99: False}


def test_prompt_values_and_pruned(spark):
    df, queries = frames(spark)
    found = {}
    for r in variants.prompt_values(df, "k", "v", "q", queries, "s").orderBy("k", "place").collect():
        found.setdefault(r.k, []).append(json.loads(r.value))
    assert found == {k: p for k, (q, v) in enumerate(VALUES) if q in QUERIES and (p := prompts(v, QUERIES[q]))}
    valid = [(q, v) for q, v in VALUES if q in QUERIES and fits(v, QUERIES[q])]
    df, queries = frames(spark, valid)
    got = {r.k: json.loads(r.j) for r in variants.pruned(df, "k", "v", "q", queries, "s").select("k", F.to_json("value").alias("j")).collect()}
    assert got == {k: cut(v, QUERIES[q]) for k, (q, v) in enumerate(valid)}


def test_sealed_and_back(spark):
    values = [(q, v) for q, v in VALUES if q in QUERIES and fits(v, QUERIES[q])] + [("any", f"v{k}") for k in range(30)]
    df, queries = frames(spark, values)
    built, tokens = variants.sealed(df.repartition(5), "k", "run", "k", "v", "q", queries, "s")
    shut = {r.k: json.loads(r.j) for r in built.select("k", F.to_json("value").alias("j")).collect()}
    listed = sorted((r.run, r.number, r.token, r.format, r.value, r.k) for r in tokens.collect())
    want, numbers = {}, {}

    def seal(v, q, run, k):
        if isinstance(q, list):
            return [seal(x, q[0], run, k) for x in v] if q else []
        if isinstance(q, dict):
            return {n: seal(v[n], q[n], run, k) for n in sorted(q)}
        if q == "prompt":
            return v
        numbers.setdefault(run, []).append((q, v, k))
        return f"#DATA{len(numbers[run]) - 1}"

    for k, (q, v) in enumerate(values):
        want[k] = seal(v, QUERIES[q], f"r{k % 2}", k)
    assert shut == want
    assert [(r[0], r[1], r[2], r[3], json.loads(r[4]), r[5]) for r in listed] == [(run, n, f"#DATA{n}", *x) for run in sorted(numbers) for n, x in enumerate(numbers[run])]
    back = variants.unsealed(built, "k", "run", "value", tokens).select("k", F.to_json("value").alias("j"))
    assert {r.k: json.loads(r.j) for r in back.collect()} == {k: cut(v, QUERIES[q]) for k, (q, v) in enumerate(values)}


def test_tokens_inside_texts_and_of_other_runs(spark):
    tokens = spark.createDataFrame([("r", 0, "#DATA0", '"Ann"'), ("r", 1, "#DATA1", "3.5"), ("r", 11, "#DATA11", '{"a":"#DATA0"}'), ("s", 2, "#DATA2", '"no"')], "run string, number long, token string, value string")
    rows = [(1, "r", {"x": "#DATA0", "y": "to #DATA0, #DATA1 and #DATA11!", "z": ["#DATA1", "#DATA2", "#DATA111", 7, None, "#DATA0#DATA0"]}), (2, "s", "#DATA0 #DATA2"), (3, None, "#DATA0")]
    df = spark.createDataFrame([(k, r, json.dumps(v)) for k, r, v in rows], "k long, run string, j string").withColumn("v", F.parse_json("j"))
    got = {r.k: json.loads(r.j) for r in variants.unsealed(df, "k", "run", "v", tokens).select("k", F.to_json("value").alias("j")).collect()}
    assert got == {1: {"x": "Ann", "y": 'to Ann, 3.5 and {"a":"#DATA0"}!', "z": [3.5, "#DATA2", "#DATA111", 7, None, "AnnAnn"]}, 2: "#DATA0 no", 3: "#DATA0"}


def test_resealed(spark):
    tokens = spark.createDataFrame([("r", 0, "#DATA0", '"Ann"'), ("r", 1, "#DATA1", '"Ann Lee"'), ("r", 2, "#DATA2", '"1"'), ("r", 3, "#DATA3", '"Ann"'), ("r", 4, "#DATA4", '"a\\\\E.*"'), ("r", 5, "#DATA5", '""'), ("s", 0, "#DATA0", '"Bob"')], "run string, number long, token string, value string")
    rows = [(1, "r", "Ann Lee and Ann have 1, see #DATA1 \n a\\E.* Bob"), (2, "s", "Ann and Bob"), (3, None, "Ann"), (4, "r", None)]
    got = {r.k: r.t for r in variants.resealed(spark.createDataFrame(rows, "k long, run string, t string"), "k", "run", "t", tokens).collect()}
    assert got == {1: "#DATA1 and #DATA0 have #DATA2, see #DATA1 \n #DATA4 Bob", 2: "Ann and #DATA0", 3: "Ann", 4: None}


# Outside calls


class Fake:
    """Answers by rules and writes each call down; made by each task."""

    def __init__(self, log):
        self.log = log

    def __call__(self, prompt):
        with open(self.log, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        if "slow" in prompt:
            time.sleep(3)
        if "broken" in prompt:
            raise ConnectionError("no line")
        if "refuse" in prompt and "compact" not in prompt:
            return scoring.Answer("I won't do that", 5, 1)
        if "stubborn" in prompt:
            return scoring.Answer("I won't do that", 5, 1)
        if "chatty" in prompt:
            return scoring.Answer("well, hard to say", 5, 1)
        if "triage" in prompt:
            return scoring.Answer("BENIGN\nconfidence: 0.7\nreason: fine" if "good" in prompt else "SUSPICIOUS\nthreat_tactic: permission_abuse\nconfidence: 0.6\nreason: odd", 5, 1)
        return scoring.Answer('So {"is_threat": %s, "confidence": 0.9, "explanation": "x"}' % json.dumps("bad" in prompt), 7, 2)


def calls(log):
    return sorted(open(log).read().splitlines()) if log.exists() else []


def make_fake(log):
    import tests.test_detectors as here

    return here.Fake(log)


def test_calls_once_and_failures(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "answers")
    prompts = ["bad", "good", "bad", "broken", "slow", None, "chatty"] * 3
    df = spark.createDataFrame(list(enumerate(prompts)), "k long, p string").repartition(6)
    run = lambda: scoring.called(df, "p", partial(make_fake, str(log)), "m", folder, seconds=1.0)
    status = {r.k: (r.status, r.error) for r in run().collect()}
    want = {"bad": ("ok", None), "good": ("ok", None), "chatty": ("ok", None), "broken": ("error", "ConnectionError: no line"), "slow": ("timeout", "no answer within 1.0 s"), None: ("error", "no prompt")}
    assert status == {k: want[p] for k, p in enumerate(prompts)}
    assert calls(log) == ["bad", "broken", "chatty", "good", "slow"]
    run().collect()  # only failures are tried again
    assert calls(log) == sorted(["bad", "broken", "chatty", "good", "slow", "broken", "slow"])


def test_a_lost_task_calls_nothing_twice(tmp_path):
    """A task that is lost after some answers, and runs again from the start, reads those."""
    log, folder = tmp_path / "log", str(tmp_path / "answers")
    prompts = [f"bad {k}" for k in range(12)]
    batches = [pa.RecordBatch.from_pylist([{"digest": scoring.request_digest("m", p), "prompt": p} for p in prompts[k : k + 4]]) for k in (0, 4, 8)]
    go = lambda: scoring._calls(iter(batches), partial(Fake, str(log)), folder, 5.0, 3)
    lost = go()
    next(lost), next(lost)
    lost.close()
    assert len(calls(log)) == 8
    assert sum(b.num_rows for b in go()) == 12 and calls(log) == sorted(prompts)


def test_a_hanging_call_blocks_no_other(tmp_path):
    store, stop = scoring.Stored(str(tmp_path)), threading.Event()
    began = time.monotonic()
    out = scoring.answer_one("ab", "x", lambda p: stop.wait(20), store, 0.3)
    assert out["status"] == "timeout" and time.monotonic() - began < 5 and store.get("ab") is None
    stop.set()


def test_reasoning_retries_refusals(spark, tmp_path):
    log = tmp_path / "log"
    rows = [(1, "bad", "compact"), (2, "fine", "compact"), (3, "refuse bad", "compact bad"), (4, "refuse stubborn", "compact stubborn"), (5, "chatty", "compact"), (6, "broken", "compact"), (7, "refuse fine", None)]
    df = spark.createDataFrame(rows, "k long, p string, again string")
    found = scoring.reasoned(df, "p", "again", partial(make_fake, str(log)), "m", str(tmp_path / "answers"), 5.0)
    got = {r.k: (r.is_malicious, r.confidence, r.status, r.n_calls, r.input_tokens) for r in found.collect()}
    assert got == {1: (True, 0.9, "ok", 1, 7), 2: (False, 0.9, "ok", 1, 7), 3: (True, 0.9, "ok", 2, 12), 4: (None, None, "refused", 2, 10), 5: (None, None, "no verdict", 1, 5), 6: (None, None, "error", 1, 0), 7: (None, None, "error", 2, 5)}
    assert {r.k: r.status for r in scoring.dead(found, "k").collect()} == {4: "refused", 5: "no verdict", 6: "error", 7: "error"}
    assert {r.k: r.is_malicious for r in scoring.defaulted(found, True, 0.5).collect()}[4] is True
    assert len(calls(log)) == 9


def test_cascade_of_both_calls(spark, tmp_path):
    log = tmp_path / "log"
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "odd"), (4, "broken bad")], "k long, t string").withColumn("p", F.concat(F.lit("triage "), "t"))
    fake = partial(make_fake, str(log))
    run = lambda **on: {r.k: (r.is_malicious, r.method) for r in scoring.detected(df, "k", "p", F.concat(F.lit("judge "), F.replace("t", F.lit("broken "), F.lit(""))), F.lit("compact"), fake, fake, ("a", "b"), str(tmp_path / "answers"), **on).collect()}
    assert run() == {1: (False, "triage"), 2: (True, "reasoning"), 3: (False, "reasoning"), 4: (True, "reasoning")}
    assert run(with_reasoning=False) == {1: (False, "triage"), 2: (True, "triage"), 3: (True, "triage"), 4: (True, "triage")}
    assert run(with_triage=False) == {1: (False, "reasoning"), 2: (True, "reasoning"), 3: (False, "reasoning"), 4: (True, "reasoning")}
    with pytest.raises(ValueError, match="no stage"):
        run(with_triage=False, with_reasoning=False)


# Expressions

SAFE = {n: getattr(math, n) for n in ("sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "log", "log10", "exp", "floor", "ceil", "factorial", "pi", "e")} | {"abs": abs, "round": round, "min": min, "max": max, "pow": pow}


@pytest.mark.parametrize(
    "text",
    ["2 + 3 * 4", "-2 ** 2", "2 ** -1", "2 ** 3 ** 2", "(1 + 2) * -3", "7 // 2 + -7 // 2", "7 % 3 + -7 % 3 + 7 % -3", "sqrt(16) + pi", "log(8, 2) + log(e)", "round(2.5) + round(3.5)", "min(3, 1, 2) - max(1, 2)", "factorial(5) / 3", "floor(-2.5) + ceil(-2.5)", "abs(-3) ** 0.5", "1e3 + .5", "sin(1) ** 2 + cos(1) ** 2", "pow(2, 10) % 7", "- - 3", "exp(1) - e", "x * 2 + y", "x - y / 4 // 1 % 3", "1/2/4/8/16/32/64/128/x", "((((((((1))))))))"],
)
def test_expressions(spark, text):
    got = spark.createDataFrame([(3.0, -5.5)], "x double, y double").select(expressions.compiled(text, {"x": F.col("x"), "y": F.col("y")}).alias("v")).first().v
    assert got.fault is None and got.result == pytest.approx(float(eval(text, {"__builtins__": {}}, SAFE | {"x": 3.0, "y": -5.5})), rel=1e-12)  # noqa: S307  texts of this file


@pytest.mark.parametrize(
    ("text", "fault"),
    [("1 / 0", "division by zero"), ("1 % (x - 3)", "division by zero"), ("5 // 0", "division by zero"), ("sqrt(-1)", "below zero"), ("min(1, sqrt(-1))", "below zero"), ("log(0)", "not above zero"), ("log(2, 1)", "division by zero"), ("asin(2)", "not within -1 and 1"), ("factorial(2.5)", "not a whole number from 0 on"), ("factorial(171)", "too large"), ("(-8) ** 0.5", "not a real number"), ("0 ** -1", "division by zero"), ("10 ** 400", "too large"), ("exp(1000)", "too large"), ("1e308 * 10", "too large"), ("z + 1 / 0", "z is null"), ("1 / 0 + z", "division by zero")],
)
def test_faults(spark, text, fault):
    names = {"x": F.lit(3), "z": F.lit(None)}
    got = spark.range(1).select(expressions.compiled(text, names).alias("v")).first().v
    assert (got.result, got.fault) == (None, fault)


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1)", "foo(1)", "nobody", "1 2", "sqrt(1, 2)", "sqrt()", "__import__('os')", "x.y", "1 ; 2", "lambda: 1", "(" * 200 + "1" + ")" * 200, "-" * 500 + "1", "1 if 1 else 2", "[1]"])
def test_no_expressions(text):
    with pytest.raises(expressions.ExpressionError):
        expressions._Reader(text, {})
        expressions.compiled(text)
