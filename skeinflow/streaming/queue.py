"""A queue with redelivery and completion, as two streaming queries with keyed state.

Messages (job, element, payload) are files of an inbox folder. The first query keeps each message's attempts: a new message is delivered; one whose
handler failed, or was lost, is delivered again when its timer runs out, after pauses that grow; after the last attempt it counts as failed for good. Handlers' outcomes are
files too and come back as events, so a restart goes on where it stopped. A message's repeated sends and outcomes change nothing.

Of each batch the first query counts finished elements by job, before anything is keyed by job, so a job of a third of all messages is a row a batch. The second
query adds these counts up and names each job once: complete when all expected elements are finished, or forced when it has waited too long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .inbox import BACKOFF

MESSAGE = "job string, element string, payload string"
OUTCOME = "job string, element string, ok boolean"
DELIVERY = "job string, element string, payload string, attempt int, event string"
COUNT = "job string, batch long, n_done long, n_failed long, n_expected long"
COMPLETION = "job string, state string, n_expected long, n_done long, n_failed long"
#: Deliveries of one message.
ATTEMPTS = 6
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Redelivery(StatefulProcessor):
    """State of one message: its payload, attempts, and whether it is waiting, finished or failed for good."""

    def __init__(self, backoff: tuple[float, ...], attempts: int) -> None:
        self.backoff, self.attempts = backoff, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", "payload string, attempt int, state string")

    def _deliver(self, payload: str | None, attempt: int, now: int) -> tuple[str | None, int, str]:
        """Due again after the pause, unless an outcome comes before; a lost handler is one that never answers."""
        self.message.update((payload, attempt, "waiting"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + int(1000 * self.backoff[min(attempt, len(self.backoff)) - 1]))
        return payload, attempt, "deliver"

    def _rows(self, key: Any, *rows: tuple) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=["job", "element", "payload", "attempt", "event"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for kind, payload in zip(frame["kind"], frame["payload"]):
                known = self.message.get() if self.message.exists() else None
                if kind == "sent":
                    if known is None:
                        out.append(self._deliver(payload, 1, now))
                elif known is not None and known[2] == "waiting":
                    # a failure waits for its timer, which the delivery has set
                    if kind == "done":
                        self.message.update((None, known[1], "finished"))
                        for timer in list(self.handle.listTimers()):
                            self.handle.deleteTimer(timer)
                        out.append((None, known[1], "finished"))
        yield from self._rows(key, *out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        payload, attempt, state = self.message.get()
        if state != "waiting":
            return
        if attempt >= self.attempts:
            self.message.update((None, attempt, "failed"))
            yield from self._rows(key, (None, attempt, "failed"))
        else:
            yield from self._rows(key, self._deliver(payload, attempt + 1, timerValues.getCurrentProcessingTimeInMs()))

    def close(self) -> None:
        pass


class Completion(StatefulProcessor):
    """State of one job: what is expected and what is finished so far, and whether it has been named."""

    def __init__(self, force_after: float) -> None:
        self.force_after = force_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "n_expected long, n_done long, n_failed long, last_batch long, named boolean")

    def _named(self, key: Any, state: str, values: tuple) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, state, *values[:3])], columns=["job", "state", "n_expected", "n_done", "n_failed"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.job.exists()
        expected, done, failed, last, named = self.job.get() if known else (None, 0, 0, -1, False)
        for row in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: -1 if pd.isna(r.batch) else r.batch):
            if not pd.isna(row.n_expected):
                expected = int(row.n_expected)
            elif row.batch > last:  # a batch that is written again counts once
                done, failed, last = done + int(row.n_done), failed + int(row.n_failed), int(row.batch)
        if not known:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.force_after))
        complete = not named and expected is not None and done + failed >= expected
        values = (expected, done, failed, last, named or complete)
        self.job.update(values)
        if complete:
            yield from self._named(key, "complete", values)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        values = self.job.get()
        if not values[4]:
            self.job.update((*values[:4], True))
            yield from self._named(key, "forced", values)

    def close(self) -> None:
        pass


def _stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def send(messages: DataFrame, folder: str) -> None:
    """Messages into the inbox, and their numbers by job beside them for the completion of jobs."""
    messages.select("job", "element", "payload").write.mode("append").parquet(f"{folder}/inbox")
    expect(messages.groupBy("job").agg(F.count_distinct("element").alias("n_expected")), folder)


def expect(jobs: DataFrame, folder: str) -> None:
    """How many elements jobs (job, n_expected) have."""
    none = F.lit(None).cast("long")
    jobs.select("job", none.alias("batch"), none.alias("n_done"), none.alias("n_failed"), F.col("n_expected").cast("long")).write.mode("append").parquet(f"{folder}/counts/expected")


def prepare(spark: SparkSession, folder: str) -> None:
    """The queue's folders, so that queries can start before the first message."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for name, schema in (("inbox", MESSAGE), ("outcomes", OUTCOME), ("counts", COUNT)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}/empty" if name != "inbox" else f"{folder}/{name}")


def deliver(spark: SparkSession, folder: str, handle: Callable[[DataFrame], DataFrame], trigger: dict, backoff: tuple[float, ...] = BACKOFF, attempts: int = ATTEMPTS) -> StreamingQuery:
    """Start the first query. `handle` takes deliveries (job, element, payload, attempt) and gives outcomes (job, element, ok); those it leaves out count as lost."""
    sent = _stream(spark, f"{folder}/inbox", MESSAGE).withColumn("kind", F.lit("sent"))
    back = _stream(spark, f"{folder}/outcomes", OUTCOME).select("job", "element", F.lit(None).cast("string").alias("payload"), F.when(F.col("ok"), "done").otherwise("failed").alias("kind"))
    events = sent.unionByName(back).groupBy("job", "element").transformWithStateInPandas(Redelivery(tuple(backoff), attempts), DELIVERY, "Append", "ProcessingTime")

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            due = rows.where("event = 'deliver'").select("job", "element", "payload", "attempt")
            handle(due).select("job", "element", "ok").write.mode("overwrite").parquet(f"{folder}/outcomes/batch-{number}")
            ended = rows.where("event <> 'deliver'").groupBy("job").agg(F.count_if(F.col("event") == "finished").alias("n_done"), F.count_if(F.col("event") == "failed").alias("n_failed"))
            counted = ended.select("job", F.lit(number).cast("long").alias("batch"), "n_done", "n_failed", F.lit(None).cast("long").alias("n_expected"))
            counted.write.mode("overwrite").parquet(f"{folder}/counts/batch-{number}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoints/deliver").outputMode("append").trigger(**trigger).start()


def complete(spark: SparkSession, folder: str, trigger: dict, force_after: float = 3600.0) -> StreamingQuery:
    """Start the second query: jobs (job, state, n_expected, n_done, n_failed) that are complete or forced go to the folder `completions`, each once."""
    counts = _stream(spark, f"{folder}/counts", COUNT)
    named = counts.groupBy("job").transformWithStateInPandas(Completion(force_after), COMPLETION, "Append", "ProcessingTime")
    return named.writeStream.format("parquet").option("path", f"{folder}/completions").option("checkpointLocation", f"{folder}/checkpoints/complete").outputMode("append").trigger(**trigger).start()
