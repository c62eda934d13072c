"""Short intents from a language model.

Records in scope go to a client in batches of rows; a refusal of the client is
kept with its record, any other fault ends the job.  :func:`enriched` asks for every record and stores the result at
once, since each later read would ask the model again; speculation should be off.

:func:`enriched_once` asks once for equal code, and keeps the answers in a folder that outlives the job: questions go in parts,
each part's answers are written before the next is asked, and a job that is killed and run again asks only
what has no answer yet.  After every part it can tell how far it is.
"""

from __future__ import annotations

import json
import time
import uuid
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from echoloom.operators.ranking import numbered
from echoloom.schema import KINDS
from echoloom.scratch import scratch_path, stored

PROMPT = "Describe in one or two plain sentences what this Python code is meant to do. Answer with the description alone."
# The hosted provider's base URL, its one model, and names and hosts that mean it.
OPENAI_URL, OPENAI_MODEL = "https://api.openai.com/v1", "gpt-5.2-codex"
OPENAI_HOSTS = ("openai.com", "www.openai.com", "api.openai.com")


class IntentError(Exception):
    """The client has no intent for this code."""


class Client(Protocol):
    def intent(self, code: str) -> str: ...


class OfflineClient:
    """Deterministic: the length of the code; codes that hold ``fails_on`` fail."""

    def __init__(self, fails_on: str | None = None) -> None:
        self.fails_on = fails_on

    def intent(self, code: str) -> str:
        if self.fails_on and self.fails_on in code:
            raise IntentError("refused")
        return f"intent::{len(code)}"


class _HttpClient:
    """Posts one JSON request for each code."""

    def __init__(self, url: str, model: str, key: str = "", send: Callable[[urllib.request.Request], bytes] | None = None) -> None:
        self.url, self.model, self.key, self.send = url.rstrip("/"), model, key, send

    def _posted(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode(), head)
        try:
            if self.send:
                return json.loads(self.send(request))
            with urllib.request.urlopen(request, timeout=120) as answer:  # noqa: S310
                return json.loads(answer.read())
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError) as fault:
            raise IntentError(str(fault)) from fault

    @staticmethod
    def _worded(text: object) -> str:
        said = text.strip() if isinstance(text, str) else ""
        if not said:
            raise IntentError("empty answer")
        return said


class OllamaClient(_HttpClient):
    def intent(self, code: str) -> str:
        return self._worded(self._posted("/api/generate", {"model": self.model, "system": PROMPT, "prompt": code, "stream": False}).get("response"))


class OpenAIClient(_HttpClient):
    def intent(self, code: str) -> str:
        answer = self._posted("/responses", {"model": self.model, "instructions": PROMPT, "input": code})
        parts = [c.get("text") for item in answer.get("output") or [] for c in item.get("content") or [] if isinstance(c, dict)]
        return self._worded(answer.get("output_text") or "".join(p for p in parts if isinstance(p, str)))


def normalized_provider(url: str) -> str:
    """A usable base URL; the hosted provider's names and hosts give its default."""
    text = url.strip()
    if not text:
        raise ValueError("provider URL is empty")
    if text.lower().rstrip("/") in ("openai", *OPENAI_HOSTS):
        return OPENAI_URL
    text = text if "://" in text else f"https://{text}"
    parts = urlparse(text)
    if not parts.scheme or not parts.netloc:
        raise ValueError(f"provider URL has no host: {url}")
    return OPENAI_URL if parts.netloc.lower() in OPENAI_HOSTS else text.rstrip("/")


def chosen_client(url: str, model: str, key: str = "") -> _HttpClient:
    """The hosted provider, with its own fixed model, or a local server."""
    if "openai.com" in url.lower() or url.strip().lower() == "openai":
        return OpenAIClient(normalized_provider(url), OPENAI_MODEL, key)
    return OllamaClient(url, model)


def parsed_scopes(text: str | None) -> list[str]:
    """Kinds to enrich; classes, functions and methods unless told; ``all`` adds files."""
    named = [x.strip() for x in (text or "").split(",") if x.strip()]
    if not named:
        return ["class", "function", "method"]
    unknown = [x for x in named if x not in ("class", "function", "method", "all")]
    if unknown:
        raise ValueError(f"unknown scope: {', '.join(unknown)}")
    return list(KINDS) if "all" in named else list(dict.fromkeys(named))


#: Text that a task takes at a time, and what Spark sends of it to Python at once: rows and bytes.
CHARACTERS_A_TASK = 64 << 20
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
SAID = "intent string, intent_status string, intent_error string, elapsed double"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python in small batches meanwhile."""
    usual = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def _asker(make: Callable[[], Client], clock: Callable[[], float]) -> Callable[[str], Column]:
    """Answers to a column of code, which alone goes to Python."""

    def ask(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for codes in texts:
            found: list[tuple] = []
            for code in codes:
                began = clock()
                try:
                    answer = (client.intent(code), "success", None)
                except IntentError as fault:
                    answer = (None, "failed", str(fault))
                found.append((*answer, clock() - began))
            yield pd.DataFrame(found, columns=["intent", "intent_status", "intent_error", "elapsed"], dtype=object)

    ask.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not to be computed twice, nor once for each field.
    return F.pandas_udf(ask, SAID).asNondeterministic()


def enriched(records: DataFrame, make: Callable[[], Client], scopes: list[str], workers: int = 4, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Records whose kind is in ``scopes`` with an intent, or with the reason that there is none.

    At most ``workers`` clients ask at a time, about CHARACTERS_A_TASK each; then come the next records.  Other records keep
    status ``skipped``.  ``elapsed`` is added: the seconds that the client took, null for records that were not asked about.
    """
    if workers <= 0:
        raise ValueError("workers must be > 0")
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "enriched")
    timed = records.withColumn("elapsed", F.lit(None).cast("double"))
    asked = timed.where(F.col("kind").isin(scopes))
    turns = -(-(asked.agg(F.sum(F.length("raw_code"))).first()[0] or 1) // (workers * CHARACTERS_A_TASK))
    if turns > 1:
        asked = stored(asked.withColumn("_turn", F.pmod(F.monotonically_increasing_id(), F.lit(turns)).cast("int")), "asked", "_turn")
    ask, rest = _asker(make, clock), [c for c in records.columns if c not in ("intent", "intent_status", "intent_error")]
    timed.where(~F.col("kind").isin(scopes)).write.parquet(path)
    with _small_batches(spark):
        for turn in range(turns):
            some = asked.where(F.col("_turn") == turn).drop("_turn") if turns > 1 else asked
            told = some.repartition(workers).select(*rest, ask("raw_code").alias("_said"))
            told.select(*rest, "_said.*").select(*timed.columns).write.mode("append").parquet(path)
    return spark.read.schema(timed.schema).parquet(path)


ANSWER = f"code_md5 string, {SAID}"
ANSWERS = f"{ANSWER}, client string, asked_in string"


@dataclass(frozen=True)
class Progress:
    """How far the questions of a job are."""

    n: int
    total: int
    failed: int
    seconds: float  #: that the clients took for the n answers

    @property
    def percent(self) -> float:
        return 100.0 if self.total == 0 else self.n * 100.0 / self.total

    @property
    def eta_seconds(self) -> int:
        """Of all remaining calls, by the mean so far; half to even."""
        return round((self.total - self.n) * self.seconds / self.n) if self.n else 0


class AnswerLog:
    """Answers by client and MD5 of the code: a Parquet folder, partitioned by client and by the job that asked."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self, client: str) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(self.folder).where(F.col("client") == client)

    def given(self, client: str, asked_in: str | None = None) -> DataFrame:
        """One answer for each code: intents, and with ``asked_in`` also what that job was refused; of several, an intent, the least by text."""
        usable = F.col("intent_status") == "success"
        rows = self._rows(client).where(usable if asked_in is None else usable | (F.col("asked_in") == asked_in))
        fields = ("intent", "intent_status", "intent_error", "elapsed", "asked_in")
        order = F.struct((~usable).alias("refused"), *[f for f in fields if f != "elapsed"])
        return rows.groupBy("code_md5").agg(F.min_by(F.struct(*fields), order).alias("a")).select("code_md5", "a.*")

    def add(self, answers: DataFrame, client: str, asked_in: str) -> None:
        rows = answers.withColumns({"client": F.lit(client), "asked_in": F.lit(asked_in)})
        rows.write.mode("append").partitionBy("client", "asked_in").parquet(self.folder)


def enriched_once(
    records: DataFrame,
    make: Callable[[], Client],
    scopes: list[str],
    log: str,
    client: str,
    workers: int = 4,
    per_part: int = 1000,
    tell: Callable[[Progress], None] | None = None,
    order: tuple[str, ...] = (),
    clock: Callable[[], float] = time.perf_counter,
) -> DataFrame:
    """X5 with memory: as :func:`enriched`, but no code is asked about that ``client`` (a name for provider and model) has an intent for.

    ``log`` is the folder of answers.  Questions are asked in the order of the columns ``order`` of their first record (else by
    MD5), ``per_part`` at a time, by at most ``workers`` clients; a task that is run again repeats at most its share of
    one part.  After each part ``tell`` gets the progress, counted where the answers are written, so that a
    repeated task counts once; with no question it is told once.  Refused questions are asked again by the next job.
    ``elapsed`` is null where the answer was known before; a null code is asked about as the empty text.

    Until a question is asked only its MD5 and place move; the answers are joined to the records when the frame is read.
    """
    if workers <= 0 or per_part <= 0:
        raise ValueError("workers and per_part must be > 0")
    spark, answers, run = records.sparkSession, AnswerLog(records.sparkSession, log), uuid.uuid4().hex
    code = F.coalesce("raw_code", F.lit(""))
    scope = F.coalesce(F.col("kind").isin(scopes), F.lit(False))
    first = F.min(F.struct(*order)) if order else F.lit(0)
    coded = records.where(scope).select(F.md5(code).alias("code_md5"), code.alias("raw_code"))
    distinct = records.where(scope).groupBy(F.md5(code).alias("code_md5")).agg(first.alias("_first"))
    asked = distinct.join(answers.given(client).select("code_md5"), "code_md5", "left_anti")
    part = F.floor((F.col("n") - 1) / per_part).cast("int").alias("part")
    places = stored(numbered(asked, "_first", "code_md5", name="n").select("code_md5", part), "places")
    texts = coded.join(places, "code_md5").dropDuplicates(["code_md5"])
    questions = stored(texts.repartition("part"), "questions", "part")
    total = questions.count()
    done = Progress(0, total, 0, 0.0)
    ask = _asker(make, clock)
    for i in range(-(-total // per_part)):
        seen = Observation()
        told = questions.where(F.col("part") == i).repartition(workers).select("code_md5", ask("raw_code").alias("said")).select("code_md5", "said.*")
        with _small_batches(spark):
            answers.add(told.observe(seen, F.count("*").alias("n"), F.count_if(F.col("intent_status") == "failed").alias("failed"), F.sum("elapsed").alias("seconds")), client, run)
        done = Progress(done.n + seen.get["n"], total, done.failed + seen.get["failed"], done.seconds + seen.get["seconds"])
        if tell:
            tell(done)
    if tell and not total:
        tell(done)
    given = stored(answers.given(client, run).withColumn("elapsed", F.when(F.col("asked_in") == run, F.col("elapsed"))).drop("asked_in"), "answers")
    rest = [c for c in records.columns if c not in ("intent", "intent_status", "intent_error", "elapsed")]
    rows = records.where(scope).select(*rest, F.md5(code).alias("code_md5")).join(given, "code_md5").drop("code_md5")
    other = records.where(~scope).withColumn("elapsed", F.lit(None).cast("double"))
    return rows.select(*other.columns).unionByName(other)
