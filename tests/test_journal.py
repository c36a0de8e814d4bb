"""Model answers that survive a failed job; requests at once, at a steady rate."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from studyloom.operators import models
from studyloom.streaming.journal import Journal


def requests(spark, n, task="abstract"):
    return spark.range(n).coalesce(1).select(F.lit(task).alias("task"), F.col("id").cast("string").alias("study_id"), F.lit(None).cast("string").alias("item_id"), F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))


class Failing(models.ModelClient):
    """Answers one request after the other; fails at the ``at``-th."""

    def __init__(self, spark, at=None):
        self.spark, self.at, self.asked = spark, at, []

    def respond(self, rows):
        made = []
        for r in rows.collect():
            self.asked.append((r["task"], r["study_id"]))
            if self.at is not None and len(self.asked) >= self.at:
                raise RuntimeError("the service is down")
            made.append((r["task"], r["study_id"], r["item_id"], 1, json.dumps({"decision": "INCLUDED", "confidence": 0.9, "reason": "r", "fulltext_incomplete": "false"})))
        return self.spark.createDataFrame(made, models.RESPONSES)


@pytest.mark.parametrize(("task", "n", "at"), [("abstract", 100, 60), ("tables", 24, 20), ("annotation", 24, 20)])
def test_a_failed_job_keeps_what_was_answered(spark, tmp_path, task, n, at):
    journal, same = (Journal(spark, f"{tmp_path}/journal") for _ in range(2))
    first, second = Failing(spark, at), Failing(spark)
    ask = lambda client, j: models.ask(client, requests(spark, n, task), lambda df, _: df, "x", journal=j)
    with pytest.raises(Exception, match="the service is down"):
        ask(first, journal).count()
    got = ask(second, same).collect()
    assert len(got) == n and all(r["payload"] for r in got)
    kept = (at - 1) // 12 * 12  # whole micro-batches before the failure
    assert len(second.asked) == n - kept and len({*first.asked[:kept], *second.asked}) == n
    third = Failing(spark)
    assert ask(third, same).count() == n and not third.asked
    same.compact()
    assert Journal(spark, f"{tmp_path}/journal").answers().count() == n
    assert ask(third, same).count() == n and not third.asked
    changed = requests(spark, n, task).withColumn("prompt", F.when(F.col("study_id") == "7", "another").otherwise(F.col("prompt")))
    assert models.ask(third, changed, lambda df, _: df, "x", journal=same).count() == n and third.asked == [(task, "7")]


def test_empty_requests_and_answers(spark, tmp_path):
    journal = Journal(spark, f"{tmp_path}/journal")
    assert journal.rows().count() == 0
    journal.compact()
    assert models.ask(Failing(spark), requests(spark, 0), lambda df, _: df, "x", journal=journal).count() == 0

    class Silent(Failing):
        def respond(self, rows):
            return super().respond(rows).withColumn("payload", F.when(F.col("study_id") != "1", F.col("payload")))

    silent, speaking = Silent(spark), Failing(spark)
    got = {r["study_id"]: r["payload"] for r in models.ask(silent, requests(spark, 3), lambda df, _: df, "x", journal=journal).collect()}
    assert got["1"] is None and got["0"] and got["2"]
    speaking.name = silent.name
    assert all(r["payload"] for r in models.ask(speaking, requests(spark, 3), lambda df, _: df, "x", journal=journal).collect()) and speaking.asked == [("abstract", "1")]
    other = Failing(spark)  # another client is asked for itself
    models.ask(other, requests(spark, 3), lambda df, _: df, "x", journal=journal).count()
    assert len(other.asked) == 3


def service(wait):
    """A service that answers after a time; the answer tells how many were waiting."""
    busy = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            busy.pop()

        def read(self):
            time.sleep(wait)
            return json.dumps({"choices": [{"message": {"content": json.dumps({"n": len(busy), "at": time.time()})}}]}).encode()

    def open_(_request, timeout):
        busy.append(timeout)
        return Answer()

    return open_


def test_requests_at_once(spark):
    client = models.HttpClient("m", api_key="k", opener=service(0.2), at_once=10)
    client.respond(requests(spark, 1)).collect()  # starts the worker
    begun = time.time()
    rows = client.respond(requests(spark, 100)).collect()
    assert time.time() - begun < 4 and {r["study_id"] for r in rows} == {str(k) for k in range(100)}
    most = [json.loads(r["payload"])["n"] for r in rows]
    assert 5 <= max(most) <= 10
    one = models.HttpClient("m", api_key="k", opener=service(0.0)).respond(requests(spark, 5)).collect()
    assert [r["study_id"] for r in one] == [str(k) for k in range(5)] and {json.loads(r["payload"])["n"] for r in one} == {1}


def test_requests_keep_to_the_rate(spark):
    client = models.HttpClient("m", api_key="k", opener=service(0.0), at_once=10, requests_a_minute=1200)
    at = sorted(json.loads(r["payload"])["at"] for r in client.respond(requests(spark, 40)).collect())
    for k in range(len(at)):  # 20 a second: no second has more, but for the jitter of one
        assert sum(at[k] <= t < at[k] + 1 for t in at) <= 21


def test_pace_is_shared_by_threads():
    now, slept, lock = [0.0], [], threading.Lock()

    def sleep(s):
        with lock:
            slept.append(s)

    pace = models.Pace(60, lambda: now[0], sleep)
    for _ in range(4):
        pace.take(2)
    assert slept == [2.0, 4.0, 6.0]
    models.Pace(None).take(1e9)


def test_concurrent_calls_fail_as_one():
    with pytest.raises(ValueError):
        list(models.concurrently(lambda x: [ValueError, int][x != 3](x) if x != 3 else (_ for _ in ()).throw(ValueError("3")), ((k,) for k in range(6)), 2))
    assert sorted(models.concurrently(lambda x: x * x, ((k,) for k in range(6)), 3)) == [((k,), k * k) for k in range(6)]
