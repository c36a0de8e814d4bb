"""The language model as a pluggable table function.

A client turns requests (task, study_id, item_id, prompt) into responses
(task, study_id, item_id, attempt, payload). Responses are a relation: write
them before using them, so that a task that runs again pays for no second call.
"""

from __future__ import annotations

import json
import os
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions import json_schema
from studyloom.functions.text import boolean
from studyloom.operators.annotation import PAYLOAD, SINGLE
from studyloom.operators.screening import process_responses
from studyloom.streaming.journal import Journal

RESPONSES = "task string, study_id string, item_id string, attempt int, payload string"
SCREENING = (
    "decision string, confidence double, reason string, fulltext_incomplete string, inclusion_criteria_applied array<string>, exclusion_criteria_applied array<string>"
)
ANALYSES = (
    "analyses array<struct<name:string,description:string,points:array<struct<coordinates:array<double>,space:string,values:array<struct<value:string,kind:string>>>>>>"
)
DECISIONS = ("INCLUDED", "EXCLUDED")


class ModelClient(ABC):
    """Answers requests (task, study_id, item_id, prompt): ``workers`` partitions at
    once, ``at_once`` requests of each. Answers that are ``paid`` for are journalled."""

    workers = at_once = 1
    paid = True

    @abstractmethod
    def respond(self, requests: DataFrame) -> DataFrame: ...

    def name(self, task: str) -> str:
        """Who answers: answers of another are not taken for its own."""
        return type(self).__name__


class Pace:
    """Lets amounts pass at a steady rate a minute, from any number of threads. Each
    amount waits until those before it have had their share of time."""

    def __init__(self, per_minute: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_minute, self.clock, self.sleep, self.lock, self.free = per_minute, clock, sleep, threading.Lock(), 0.0

    def take(self, amount: float) -> None:
        if not self.per_minute:
            return
        with self.lock:
            begin = max(self.clock(), self.free)
            self.free = begin + amount * 60 / self.per_minute
        if (left := begin - self.clock()) > 0:
            self.sleep(left)


def concurrently(call: Callable, rows: Iterator, most: int) -> Iterator[tuple]:
    """(row, call(*row)) of all rows as they come, ``most`` calls at a time; no row is
    taken before there is room for it."""
    with ThreadPoolExecutor(max(1, most)) as pool:
        running: dict = {}
        try:
            for row in rows:
                if len(running) >= most:
                    for f in wait(running, return_when=FIRST_COMPLETED).done:
                        yield running.pop(f), f.result()
                running[pool.submit(call, *row)] = row
            while running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    yield running.pop(f), f.result()
        finally:
            for f in running:
                f.cancel()


class ReplayClient(ModelClient):
    """Answers from a table of stored responses, the last attempt up to ``tries``."""

    paid = False

    def __init__(self, stored: DataFrame, tries: int = 3):
        self.stored, self.tries = stored, tries

    def respond(self, requests: DataFrame) -> DataFrame:
        last = self.stored.where(F.col("attempt") <= self.tries).groupBy("task", "study_id", "item_id").agg(F.max_by("payload", "attempt").alias("payload"), F.max("attempt").alias("attempt"))
        same = requests["task"].eqNullSafe(last["task"]) & requests["study_id"].eqNullSafe(last["study_id"]) & requests["item_id"].eqNullSafe(last["item_id"])
        return requests.join(last, same, "left").select(requests["task"], requests["study_id"], requests["item_id"], F.coalesce("attempt", F.lit(1)).alias("attempt"), "payload")


class RuleClient(ModelClient):
    """A fixed rule in place of a model, for tests: a prompt that names ``word`` is
    included; each pair of neighbouring cells of a table gives an analysis."""

    paid = False

    def __init__(self, word: str = "study"):
        self.word = word

    def respond(self, requests: DataFrame) -> DataFrame:
        hit = F.contains(F.lower(F.coalesce("prompt", F.lit(""))), F.lit(self.word))
        screening = F.to_json(F.struct(F.when(hit, "INCLUDED").otherwise("EXCLUDED").alias("decision"), F.lit(0.9).alias("confidence"), F.concat(F.lit("word "), F.lit(self.word)).alias("reason"), F.lit("false").alias("fulltext_incomplete")))
        size = F.length(F.coalesce("prompt", F.lit("")))
        point = F.struct(F.array((size % 70).cast("double"), (size % 50).cast("double"), (size % 40).cast("double")).alias("coordinates"), F.lit("MNI").alias("space"))
        names = F.array(F.lit("first"), F.lit("second"))
        tables = F.to_json(F.struct(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("description"), F.array(point).alias("points"))).alias("analyses")))
        payload = F.when(F.col("task") == "tables", tables).otherwise(screening)
        return requests.select("task", "study_id", "item_id", F.lit(1).alias("attempt"), payload.alias("payload"))


#: What a task's answer must look like; other tasks are screenings.
ANSWERS = {"tables": ANALYSES, "annotation": PAYLOAD, "annotation_single": SINGLE}


def answer_schema(task: str) -> dict:
    return json_schema.of_ddl(ANSWERS.get(task, SCREENING))


class HttpClient(ModelClient):
    """Calls a chat-completion service from the partitions, with retries and waits.

    ``model`` is a name, or a name for each task (abstract, fulltext, tables,
    annotation). Requests carry the JSON schema of their task's answer. The key
    comes from the argument or OPENAI_API_KEY on the driver; a missing key is an
    error at the first call. A request that fails after all tries answers null,
    which screening takes as a failure. ``workers`` is the number of partitions
    that ask at once, ``at_once`` that of requests on their way from one of them;
    ``requests_a_minute`` and ``tokens_a_minute`` (some four characters each) hold
    for all partitions together, each has its share."""

    def __init__(self, model: str | dict[str, str], base_url: str = "https://api.openai.com/v1", api_key: str | None = None, tries: int = 3, timeout: float = 60.0, workers: int = 1, opener=None, at_once: int = 1, requests_a_minute: float | None = None, tokens_a_minute: float | None = None):
        self.model, self.base_url, self.tries, self.timeout, self.workers, self.opener = model, base_url.rstrip("/"), tries, timeout, workers, opener
        self.at_once, self.requests_a_minute, self.tokens_a_minute = at_once, requests_a_minute, tokens_a_minute
        self.api_key = api_key or os.environ.get("OPENAI_API_KEY")

    def model_of(self, task: str) -> str:
        return self.model if isinstance(self.model, str) else self.model[task.removesuffix("_single")]

    def name(self, task: str) -> str:
        return f"{self.base_url} {self.model_of(task)}"

    def body(self, task: str, prompt: str, schema: dict | None = None) -> dict:
        form = {"type": "json_schema", "json_schema": {"name": task, "schema": schema or answer_schema(task)}}
        return {"model": self.model_of(task), "messages": [{"role": "user", "content": prompt}], "response_format": form}

    def respond(self, requests: DataFrame) -> DataFrame:
        if not self.api_key:
            raise RuntimeError("no API key for the model service")
        url, key, tries, timeout, body, opener = f"{self.base_url}/chat/completions", self.api_key, self.tries, self.timeout, self.body, self.opener
        at_once, flush = self.at_once, 4 * self.at_once
        screening, others = answer_schema(""), {task: answer_schema(task) for task in ANSWERS}  # made here: Spark reads the types
        share = [x and x / self.workers for x in (self.requests_a_minute, self.tokens_a_minute)]

        def call(paces: list[Pace], task: str, prompt: str | None) -> tuple[int, str | None]:
            from urllib.request import Request, urlopen

            if prompt is None:
                return 1, None
            data = json.dumps(body(task, prompt, others.get(task, screening))).encode()
            for attempt in range(1, tries + 1):
                for pace, amount in zip(paces, (1, len(data) / 4)):
                    pace.take(amount)
                try:
                    with (opener or urlopen)(Request(url, data, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}), timeout=timeout) as got:
                        return attempt, json.load(got)["choices"][0]["message"]["content"]
                except (OSError, ValueError, KeyError):
                    if attempt < tries:
                        time.sleep(2 ** (attempt - 1))
            return tries, None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            paces, made = [Pace(x) for x in share], []
            rows = (row for batch in batches for row in batch[["task", "study_id", "item_id", "prompt"]].itertuples(index=False, name=None))
            for row, (attempt, payload) in concurrently(lambda task, _s, _i, prompt: call(paces, task, prompt), rows, at_once):
                made.append((*row[:3], attempt, payload))
                if len(made) >= flush:
                    yield pd.DataFrame(made, columns=["task", "study_id", "item_id", "attempt", "payload"])
                    made = []
            if made:
                yield pd.DataFrame(made, columns=["task", "study_id", "item_id", "attempt", "payload"])

        return requests.select("task", "study_id", "item_id", "prompt").repartition(self.workers).mapInPandas(run, RESPONSES)


def ask(client: ModelClient, requests: DataFrame, store: Callable[[DataFrame, str], DataFrame], name: str, bad: Callable[[DataFrame], DataFrame] | None = None, tries: int = 3, journal: Journal | None = None) -> DataFrame:
    """Responses to ``requests``, one for each. They are stored before they are used,
    so nothing is asked twice; studies whose payload is ``bad`` (study_id) are asked
    again, up to ``tries`` times in all, and their last answer counts. With a
    ``journal`` answers are kept as they come, and what it has is not asked for."""

    def respond(rows: DataFrame, k: int) -> DataFrame:
        task = rows.select("task").first() if journal is not None and client.paid else None
        if task is None:
            return store(client.respond(rows), f"{name}_{k}")
        return journal.ask(client.respond, rows, k, client.name(task["task"]), client.workers, client.at_once)

    answers = respond(requests, 1)
    for k in range(2, tries + 1):
        if bad is None:
            break
        again = store(bad(answers.where("payload is not null")).select("study_id").distinct(), f"{name}_again_{k}")
        if again.isEmpty():
            break
        more = respond(requests.join(again, "study_id", "left_semi"), k)
        answers = answers.join(again, "study_id", "left_anti").unionByName(more)
    return answers


def parse_screening(responses: DataFrame) -> DataFrame:
    """Screening rows of payloads; a payload that is broken, or whose decision is
    neither word, has a null decision, which counts as a failure."""
    rows = responses.select("study_id", F.from_json("payload", SCREENING).alias("p")).select("study_id", "p.*")
    bad = ~F.coalesce(F.col("decision").isin(*DECISIONS) & F.col("confidence").between(0, 1) & F.col("reason").isNotNull(), F.lit(False))
    rows = rows.withColumn("decision", F.when(~bad, F.col("decision"))).withColumn("reason", F.when(bad, F.lit("no valid response")).otherwise(F.col("reason")))
    return rows.withColumn("fulltext_incomplete", F.coalesce(boolean(F.col("fulltext_incomplete")) & ~bad, F.lit(False)))


def screen(studies: DataFrame, client: ModelClient, stage: str, reporting: bool = False, threshold: float | None = None, model: str = "replay", journal: Journal | None = None) -> DataFrame:
    """Screening results of all ``studies`` (pmid, and prompt if the client reads it)."""
    prompt = F.col("prompt") if "prompt" in studies.columns else F.lit(None).cast("string")
    asked = studies.select(F.lit(stage).alias("task"), F.col("pmid").alias("study_id"), F.lit(None).cast("string").alias("item_id"), prompt.alias("prompt"))
    got = ask(client, asked, lambda df, _: df, stage, journal=journal)
    return process_responses(parse_screening(got), stage, reporting, threshold).withColumn("model_used", F.lit(model))


def parse_tables(tables: DataFrame, client: ModelClient, store: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, journal: Journal | None = None) -> DataFrame:
    """Analyses of tables (pmid, table_pos, table_id, raw_table): one row each, in
    table order. Points without three numbers go; a broken payload gives none."""
    asked = tables.select(F.lit("tables").alias("task"), F.col("pmid").alias("study_id"), F.col("table_id").alias("item_id"), F.col("raw_table").alias("prompt"))
    got = ask(client, asked, store, "table_responses", journal=journal).select(F.col("study_id").alias("pmid"), F.col("item_id").alias("table_id"), F.from_json("payload", ANALYSES).alias("p"))
    rows = got.join(tables.select("pmid", "table_id", "table_pos"), ["pmid", "table_id"]).select("pmid", "table_id", "table_pos", F.posexplode("p.analyses").alias("pos", "a"))
    points = F.filter(F.coalesce("a.points", F.array().cast("array<struct<coordinates:array<double>,space:string,values:array<struct<value:string,kind:string>>>>")), lambda p: (F.size(p["coordinates"]) == 3) & F.forall(p["coordinates"], lambda c: c.isNotNull()))
    made = F.transform(points, lambda p: F.struct(p["coordinates"].alias("coordinates"), p["space"].alias("space"), F.transform(p["values"], lambda v: F.struct(v["value"].alias("value_text"), v["value"].try_cast("double").alias("value_num"), v["kind"].alias("kind"))).alias("values")))
    return rows.select("pmid", "table_id", "table_pos", "pos", F.col("a.name").alias("name"), F.col("a.description").alias("description"), F.lit(True).alias("parsed"), made.alias("points"))
