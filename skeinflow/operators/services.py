"""Calls of external services from Spark: each text is asked once, at a rate, with retries, and what fails is a row.

A ledger keeps the answers: a folder of Parquet files for each service, rows (content_hash, answer, error, attempts, asked_at). New texts are dealt by
hash to a fixed number of tasks, which share the service's rate; their answers are written before anything reads them, so a plan
may be run as often as Spark likes without another call. A text that failed is asked again by the next run; one that a service has answered never is. Where a
task is lost, only what it had not yet written is asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers
from ..functions.text import blank_to_null
from ..session import ship
from . import store
from .versions import first_per

VECTOR = "array<float>"


@dataclass(frozen=True)
class Service:
    """A callable that takes a text. `result` is the answer's type, `name` tells services (and models) apart in the ledger.

    All tasks together call at `per_second` (none: as fast as they can): of any T seconds at most per_second * T + tasks calls fall into them. Where
    a call raises `providers.Throttled` it is tried again after growing pauses; other errors, and an answer of None, are failures of their row.
    """

    name: str
    call: Callable[[str], object]
    result: str = VECTOR
    tasks: int = 4
    per_second: float | None = None
    pause: float = providers.CHAT_PAUSE
    attempts: int = providers.ATTEMPTS


def embedding(name: str, call: Callable[[str], object], tasks: int = 4) -> Service:
    """An embedding service at the rates of such calls."""
    return Service(name, call, VECTOR, tasks, min(providers.RATES["all"], providers.RATES["embed"]), providers.EMBED_PAUSE)


def annotation(name: str, call: Callable[[str], object], result: str, tasks: int = 4) -> Service:
    """An annotation service at the rates of such calls."""
    return Service(name, call, result, tasks, min(providers.RATES["all"], providers.RATES["annotate"]))


def ledger_folder(spark: SparkSession) -> str:
    """A new ledger in the shared folder, for runs that keep none."""
    return f"{store.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def answers(spark: SparkSession, ledger: str, service: Service) -> DataFrame:
    """The ledger's rows of a service: of each text the first answer, or else the last failure."""
    rows = store.read_path(spark, f"{ledger}/{service.name}", _schema(service))
    return first_per(rows, ["content_hash"], F.col("answer").isNull(), F.col("asked_at").desc())


def _schema(service: Service) -> str:
    return f"content_hash string, answer {service.result}, error string, attempts int, asked_at timestamp"


def _caller(service: Service) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = [0]

        def once(text: str) -> object:
            tried[0] += 1
            return service.call(text)

        rate = providers.Rate(service.per_second / service.tasks) if service.per_second else None
        call = providers.retried(providers.limited(once, rate) if rate else once, service.pause, attempts=service.attempts)
        for frame in frames:
            rows = []
            for digest, text in zip(frame["content_hash"], frame["text"]):
                tried[0], answer, error = 0, None, None
                try:
                    answer = call(text)
                    error = "no answer" if answer is None else None
                except Exception as e:  # the row carries it
                    error = f"{type(e).__name__}: {e}"
                rows.append((digest, answer, error, tried[0], pd.Timestamp.now("UTC")))
            yield pd.DataFrame(rows, columns=["content_hash", "answer", "error", "attempts", "asked_at"])

    return run


def ask(rows: DataFrame, text: str, service: Service, ledger: str) -> DataFrame:
    """`rows` with `answer` and `error` of their texts; both null for blank texts, which aren't asked.

    The calls run now and are written to the ledger; the result only joins it. One run at a time a ledger.
    """
    spark = rows.sparkSession
    ship(spark)
    digest = F.sha2(F.col(text), 256)
    wanted = rows.where(blank_to_null(F.col(text)).isNotNull()).groupBy(digest.alias("content_hash")).agg(F.first(text).alias("text"))
    have = answers(spark, ledger, service).where("answer is not null").select("content_hash")
    new = wanted.join(have, "content_hash", "left_anti").repartition(service.tasks, "content_hash")
    made = new.mapInPandas(_caller(service), _schema(service))
    made.write.mode("append").parquet(f"{ledger}/{service.name}")
    known = answers(spark, ledger, service).select(F.col("content_hash").alias("_hash"), "answer", "error")
    kept = [c for c in rows.columns if c not in ("answer", "error")]
    return rows.select(*kept, digest.alias("_digest")).join(known, F.col("_digest") == F.col("_hash"), "left").drop("_digest", "_hash")
