"""A queue as a folder: appended files are read as a stream and handled at least once, idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Seconds before another attempt, by the number of attempts so far; the last holds for all more.
BACKOFF = (30, 60, 120, 240, 300)


def send(messages: DataFrame, inbox: str) -> None:
    messages.write.mode("append").parquet(inbox)


def messages(spark: SparkSession, inbox: str, schema: StructType, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(inbox)


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handle all that is there and stop. `handle` must stand a batch that comes again."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_attempt(now: Column, attempts: Column) -> Column:
    at = F.get(F.array(*map(F.lit, BACKOFF)), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(len(BACKOFF) - 1)))
    return F.timestamp_seconds(F.unix_seconds(now) + at)


def completed(expected: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """Jobs whose elements have all arrived, by a count of whole tables; `queue.complete` keeps such counts as state."""
    have = elements.groupBy(key).agg(F.count("*").alias("n_done"))
    return expected.join(have, key, "left").withColumn("complete", F.coalesce("n_done", F.lit(0)) >= F.col("n_expected"))
