"""Counts of runs while they run: observed on their way, without another pass, and kept as rows."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "run string, step string, name string, n long, at timestamp"


@dataclass
class Progress:
    """Counts of one run. Whoever writes a counted DataFrame makes its counts known; `save` appends them to a folder."""

    spark: SparkSession
    run: str
    _steps: list[tuple[str, Observation, float]] = field(default_factory=list)

    def counted(self, df: DataFrame, step: str, **conditions: Column) -> DataFrame:
        """`df`, whose first complete run counts its rows (`rows`) and those of each condition."""
        seen = Observation(f"{self.run}/{step}")
        self._steps.append((step, seen, time.time()))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])

    def rows(self) -> DataFrame:
        """Rows (run, step, name, n, at) of the steps so far; waits for those that are still to run."""
        made = [(self.run, step, name, int(n), at) for step, seen, at in self._steps for name, n in seen.get.items()]
        return self.spark.createDataFrame(made, "run string, step string, name string, n long, at double").withColumn("at", F.timestamp_seconds("at"))

    def save(self, folder: str) -> None:
        self.rows().coalesce(1).write.mode("append").parquet(folder)


class BatchCounts(StreamingQueryListener):
    """Counts of each batch of the session's streaming queries: (query, batch, rows in, rows of state)."""

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
