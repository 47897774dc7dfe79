"""Calls of an outside scorer (a model behind a service): at most one call for a request, whatever tasks are lost.

Spark deals the distinct requests over its tasks; a task makes a few calls at once. Each answer is stored under the digest of its request
as soon as it is there, so that a task that starts again, a second run, or another row with the same request reads it instead of calling.
"""

from __future__ import annotations

import hashlib
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import detection
from tracewright.operators.storage import kept

#: Seconds that a call may take, and calls that a task makes at once.
SECONDS, AT_ONCE = 90.0, 5
_ANSWER = "digest string, answer string, status string, error string, seconds double, input_tokens long, output_tokens long"


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


#: Made once in each task: a scorer takes a prompt and returns an Answer, or raises.
Scorer = Callable[[str], Answer]


class Stored:
    """Answers under their requests' digests in a folder that all executors see: any URI that pyarrow opens, or a mounted path. A file
    appears under its name only when it is whole."""

    def __init__(self, folder: str):
        self.files, self.path = fs.FileSystem.from_uri(folder)

    def _at(self, digest: str) -> str:
        return f"{self.path}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> dict | None:
        try:
            with self.files.open_input_stream(self._at(digest)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, digest: str, answer: dict) -> None:
        self.files.create_dir(f"{self.path}/{digest[:2]}", recursive=True)
        part = f"{self._at(digest)}.{threading.get_ident()}.{time.time_ns()}"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(answer).encode())
        self.files.move(part, self._at(digest))


def _within(seconds: float, scorer: Scorer, prompt: str) -> Answer:
    """The answer, or TimeoutError; a call that does not come back holds up nobody."""
    got: queue.Queue = queue.Queue()

    def call() -> None:
        try:
            got.put((scorer(prompt), None))
        except Exception as error:  # noqa: BLE001  whatever a service's client raises is this request's failure, not the task's
            got.put((None, error))

    threading.Thread(target=call, daemon=True).start()
    try:
        answer, error = got.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if error is not None:
        raise error
    return answer


def answer_one(digest: str, prompt: str, scorer: Scorer, store: Stored, seconds: float) -> dict:
    """The stored answer, else that of a call. Failures are not stored: another run may call again."""
    if (had := store.get(digest)) is not None:
        return had
    began = time.monotonic()
    out = {"answer": None, "status": "ok", "error": None, "input_tokens": 0, "output_tokens": 0}
    try:
        a = asdict(_within(seconds, scorer, prompt))
        out |= {"answer": a["text"], "input_tokens": a["input_tokens"], "output_tokens": a["output_tokens"]}
    except TimeoutError as error:
        out |= {"status": "timeout", "error": str(error)}
    except Exception as error:  # noqa: BLE001  see above
        out |= {"status": "error", "error": f"{type(error).__name__}: {error}"}
    out["seconds"] = time.monotonic() - began
    if out["status"] == "ok":
        store.put(digest, out)
    return out


def _calls(batches: Iterator[pa.RecordBatch], make: Callable[[], Scorer], folder: str, seconds: float, at_once: int) -> Iterator[pa.RecordBatch]:
    store, scorer = Stored(folder), make()
    with ThreadPoolExecutor(at_once) as pool:
        for batch in batches:
            rows = batch.to_pylist()
            found = pool.map(lambda r: answer_one(r["digest"], r["prompt"], scorer, store, seconds), rows)
            whole = [{"digest": r["digest"]} | a for r, a in zip(rows, found, strict=True)]
            yield pa.RecordBatch.from_pylist(whole, schema=pa.schema([("digest", pa.string()), ("answer", pa.string()), ("status", pa.string()), ("error", pa.string()), ("seconds", pa.float64()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64())]))


def called(rows: DataFrame, prompt: str, make: Callable[[], Scorer], model: str, folder: str, seconds: float = SECONDS, at_once: int = AT_ONCE) -> DataFrame:
    """rows with answer, status (ok, timeout, error), error, seconds, input_tokens, output_tokens; `model` is part of a request.

    Rows with the same prompt share one call. A null prompt is no request: its status is error. `make` must be importable on the
    executors, or plain enough to be sent there. Names of the new columns must be free."""
    digest = F.sha2(F.concat_ws("\n", F.lit(model), F.col(prompt)), 256)
    asked = rows.withColumn("__digest", F.when(F.col(prompt).isNotNull(), digest))
    requests = asked.where(F.col("__digest").isNotNull()).groupBy(F.col("__digest").alias("digest")).agg(F.first(prompt).alias("prompt"))
    answers = kept(requests.mapInArrow(partial(_calls, make=make, folder=folder, seconds=seconds, at_once=at_once), _ANSWER))
    out = asked.join(answers.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
    return out.withColumns({"status": F.coalesce("status", F.lit("error")), "error": F.when(F.col("status").isNull(), F.lit("no prompt")).otherwise(F.col("error"))})


def request_digest(model: str, prompt: str) -> str:
    return hashlib.sha256(f"{model}\n{prompt}".encode()).hexdigest()


def triaged(rows: DataFrame, prompt: str, make: Callable[[], Scorer], model: str, folder: str, seconds: float = SECONDS) -> DataFrame:
    """rows with triage (is_suspicious, threat_tactic, confidence, reason), status, error and the tokens of the call. A call that fails
    escalates: suspicious at 0.9, for its error as the reason."""
    out = called(rows, prompt, make, model, folder, seconds)
    failed = F.struct(F.lit(True).alias("is_suspicious"), F.lit("N/A").alias("threat_tactic"), F.lit(0.9).alias("confidence"), F.concat(F.lit("Triage error, escalating: "), F.coalesce("error", F.lit(""))).alias("reason"))
    return out.withColumn("triage", F.when(F.col("status") == "ok", detection.triage(F.col("answer"))).otherwise(failed)).drop("answer", "seconds")


def reasoned(rows: DataFrame, prompt: str, retry_prompt: str, make: Callable[[], Scorer], model: str, folder: str, seconds: float = SECONDS) -> DataFrame:
    """rows with is_malicious, confidence, explanation, status, error, n_calls and the tokens of all calls.

    An answer without a verdict that refuses is asked for once more with the compact prompt. status tells what came of it: ok, refused
    (twice), no verdict, timeout, error. Without a verdict is_malicious is null, for the caller to default (see defaulted) and to keep
    as a dead letter (see dead)."""
    first = kept(called(rows, prompt, make, model, folder, seconds).withColumn("verdict", detection.verdict(F.col("answer"))))
    again = first.where(F.col("verdict").isNull() & detection.is_refusal(F.col("answer")))
    tokens = ["input_tokens", "output_tokens"]
    held = again.drop("answer", "status", "error", "seconds", "verdict").withColumnsRenamed({c: f"__{c}" for c in tokens})
    second = called(held, retry_prompt, make, model, folder, seconds).withColumn("verdict", detection.verdict(F.col("answer")))
    second = second.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0)) for c in tokens} | {"n_calls": F.lit(2)}).drop(*[f"__{c}" for c in tokens])
    once = first.where(F.col("verdict").isNotNull() | ~detection.is_refusal(F.col("answer"))).withColumn("n_calls", F.lit(1))
    out = once.unionByName(second)
    threat = F.try_variant_get("verdict", "$.is_threat", "boolean")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("verdict").isNotNull(), "ok").when(detection.is_refusal(F.col("answer")), "refused").otherwise("no verdict")
    found = {"is_malicious": F.when(F.col("verdict").isNotNull(), F.coalesce(threat, F.lit(False))), "confidence": F.when(F.col("verdict").isNotNull(), F.coalesce(F.try_variant_get("verdict", "$.confidence", "double"), F.lit(0.5))), "explanation": F.try_variant_get("verdict", "$.explanation", "string"), "status": status}
    return out.withColumns(found).drop("answer", "verdict", "seconds")


def defaulted(rows: DataFrame, is_malicious: bool = False, confidence: float = 0.0) -> DataFrame:
    """The rows of reasoned() with a default verdict where there is none."""
    return rows.withColumns({"is_malicious": F.coalesce("is_malicious", F.lit(is_malicious)), "confidence": F.coalesce("confidence", F.lit(confidence))})


def dead(rows: DataFrame, key: str) -> DataFrame:
    """key, status, error: what has no verdict, to be tried again."""
    return rows.where(F.col("status") != "ok").select(key, "status", "error")


def detected(rows: DataFrame, key: str, triage_prompt: str, reasoning_prompt: Column, retry_prompt: Column, triage_scorer: Callable[[], Scorer], reasoning_scorer: Callable[[], Scorer], models: tuple[str, str], folder: str, with_triage: bool = True, with_reasoning: bool = True) -> DataFrame:
    """key, is_malicious, confidence, method, status, error: the cascade of both calls. What triage finds benign ends there, the rest gets
    the second call's verdict. Without triage every row is reasoned about; without reasoning triage has the last word. Prompts of the
    second stage may use the column triage, which is null without that stage."""
    if not (with_triage or with_reasoning):
        raise ValueError("no stage is on")
    none = F.lit(None).cast("struct<is_suspicious:boolean,threat_tactic:string,confidence:double,reason:string>")
    first = triaged(rows, triage_prompt, triage_scorer, models[0], folder) if with_triage else rows.withColumns({"triage": none, "status": F.lit("ok"), "error": F.lit(None).cast("string")})
    ends = ~F.col("triage.is_suspicious") if with_reasoning else F.lit(True)
    ended = first.where(ends) if with_triage else first.limit(0)
    quick = ended.select(key, F.col("triage.is_suspicious").alias("is_malicious"), F.col("triage.confidence").alias("confidence"), F.lit("triage").alias("method"), "status", "error")
    if not with_reasoning:
        return quick
    rest = (first.where(~ends) if with_triage else first).select(key, reasoning_prompt.alias("__prompt"), retry_prompt.alias("__retry"))
    slow = defaulted(reasoned(rest, "__prompt", "__retry", reasoning_scorer, models[1], folder))
    return quick.unionByName(slow.select(key, "is_malicious", "confidence", F.lit("reasoning").alias("method"), "status", "error"))
