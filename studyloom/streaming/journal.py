"""Journal of model answers: what has been paid for survives the job that asked.

Requests are a stream of small files. A micro-batch takes one file for each worker,
asks the client, and appends the answers as a committed write, so a failure loses
one micro-batch. Before anything is asked, answers of earlier runs are looked up by
key: task, study, item, round, the prompt's digest and who answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.sources.sinks import _fs, new_version, recover

#: Requests of a worker in one micro-batch, at least; two for each that may be on its
#: way at once.
FLUSH = 12
ROWS = "key string, task string, study_id string, item_id string, attempt int, payload string, answered_at timestamp"
_REQUEST = "task string, study_id string, item_id string, prompt string, key string"


def request_key(round_: int, asker: str) -> Column:
    """Key of a request; two requests with the same key get the same answer."""
    parts = F.to_json(F.struct("task", "study_id", "item_id", F.lit(round_).alias("round"), F.lit(asker).alias("asker"), F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt")), {"ignoreNullFields": "false"})
    return F.sha2(parts, 256)


class Journal:
    """Answers below ``path``: each call of ``ask`` appends to a folder of its own in
    ``parts``, so that reads of different times are of different paths (Spark takes
    reads of one path for equal), and ``base`` is the table that ``compact`` makes of
    them. One process writes at a time."""

    def __init__(self, spark: SparkSession, path: str, flush: int = FLUSH):
        self.spark, self.path, self.flush = spark, path.rstrip("/"), flush
        self.schema = T._parse_datatype_string(ROWS)

    def _parts(self) -> list[str]:
        _sc, place, fs = _fs(self.spark.range(0), f"{self.path}/parts")
        return sorted(s.getPath().toString() for s in fs.listStatus(place)) if fs.exists(place) else []

    def rows(self) -> DataFrame:
        """All answers, the newest of each key."""
        found = [self.spark.read.schema(self.schema).parquet(p) for p in (f"{self.path}/base",) if recover(self.spark, p)]
        if parts := self._parts():
            found.append(self.spark.read.schema(self.schema).parquet(*parts))
        if not found:
            return self.spark.createDataFrame([], self.schema)
        every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        fields = [f.name for f in self.schema.fields if f.name != "key"]
        newest = F.max_by(F.struct(*fields), F.struct(F.col("payload").isNotNull(), "answered_at"))
        return every.groupBy("key").agg(newest.alias("r")).select("key", *[F.col(f"r.{f}").alias(f) for f in fields])

    def answers(self) -> DataFrame:
        """Answers with a payload: the others are asked for again."""
        return self.rows().where("payload is not null")

    def compact(self) -> None:
        """One table of all answers in place of the parts. A crash on the way leaves rows
        in both, which are the same by key."""
        if not self._parts():
            return
        new_version(self.rows(), f"{self.path}/base")
        _sc, place, fs = _fs(self.spark.range(0), f"{self.path}/parts")
        fs.delete(place, True)

    def ask(self, respond: Callable[[DataFrame], DataFrame], requests: DataFrame, round_: int = 1, asker: str = "", workers: int = 1, at_once: int = 1) -> DataFrame:
        """Responses to ``requests`` (task, study_id, item_id, prompt), one for each; a
        request that stays without an answer has a null payload."""
        keyed = requests.select("task", "study_id", "item_id", "prompt").withColumn("key", request_key(round_, asker))
        todo = keyed.join(self.answers().select("key"), "key", "left_anti").dropDuplicates(["key"])
        self._stream(respond, todo, workers, max(self.flush, 2 * at_once))
        done = self.rows().select("key", "attempt", "payload")
        return keyed.join(done, "key", "left").select("task", "study_id", "item_id", F.coalesce("attempt", F.lit(1)).alias("attempt"), "payload")

    def _stream(self, respond: Callable[[DataFrame], DataFrame], todo: DataFrame, workers: int, flush: int) -> None:
        name = uuid.uuid4().hex
        inbox, part = f"{self.path}/inbox-{name}", f"{self.path}/parts/{name}"
        schema = T._parse_datatype_string(_REQUEST)
        todo.select(*schema.names).write.option("maxRecordsPerFile", flush).parquet(f"{inbox}/requests")

        def answer(batch: DataFrame, _: int) -> None:
            of = ("task", "study_id", "item_id")
            got = respond(batch.drop("key")).select(*[F.col(c).alias(f"_{c}") for c in of], "attempt", "payload")
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of]
            rows = batch.join(got, same[0] & same[1] & same[2]).select("key", *of, "attempt", "payload", F.current_timestamp().alias("answered_at"))
            rows.write.mode("append").parquet(part)

        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, workers)).parquet(f"{inbox}/requests")
        query = stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{inbox}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
            _sc, place, fs = _fs(self.spark.range(0), inbox)
            fs.delete(place, True)
