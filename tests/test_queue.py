"""The queue: failed and lost messages come back, jobs complete once, also after a restart."""

import time

import pytest
from pyspark.sql import functions as F

from skeinflow.streaming import queue


def until(test, seconds=100):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.5)
    return test()


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_redelivery_and_completion(spark, tmp_path, few_partitions):
    folder = f"{tmp_path}/queue"
    queue.prepare(spark, folder)
    queue.send(spark.createDataFrame([("a", "1", "fine"), ("a", "2", "fails once"), ("a", "1", "fine"), ("b", "1", "lost once"), ("b", "2", "always fails"), ("c", "1", "fine")], queue.MESSAGE), folder)
    seen = []

    def handle(due):
        rows = due.collect()
        seen.extend((r.job, r.element, r.attempt, time.time()) for r in rows)
        known = due.where(~((F.col("payload") == "lost once") & (F.col("attempt") == 1)))
        return known.withColumn("ok", ~F.col("payload").contains("fails") | ((F.col("payload") == "fails once") & (F.col("attempt") > 1)))

    every = {"processingTime": "300 milliseconds"}

    def start():
        return [queue.deliver(spark, folder, handle, every, backoff=(3.0, 2.0), attempts=3), queue.complete(spark, folder, every)]

    def named():
        try:
            return sorted((r.job, r.state, r.n_expected, r.n_done, r.n_failed) for r in spark.read.schema(queue.COMPLETION).parquet(f"{folder}/completions").collect())
        except Exception:
            return []

    running = start()
    try:
        assert until(lambda: len(seen) >= 4), seen
        for q in running:  # a restart in the middle
            q.stop()
        running = start()
        want = [("a", "complete", 2, 2, 0), ("b", "complete", 2, 1, 1), ("c", "complete", 1, 1, 0)]
        assert until(lambda: named() == want), (named(), seen)
        running.pop().stop()
        running.append(queue.complete(spark, folder, every, force_after=2.0))
        queue.expect(spark.createDataFrame([("d", 1)], "job string, n_expected long"), folder)  # a job of which nothing comes
        assert until(lambda: named() == [*want, ("d", "forced", 1, 0, 0)]), named()
    finally:
        for q in running:
            q.stop()
    times = {}
    for j, e, n, t in seen:  # a batch that a restart repeats is handled again
        times.setdefault((j, e, n), t)
    assert set(times) == {("a", "1", 1), ("a", "2", 1), ("a", "2", 2), ("b", "1", 1), ("b", "1", 2), ("b", "2", 1), ("b", "2", 2), ("b", "2", 3), ("c", "1", 1)}
    # the timer starts with the batch that delivers, whose handler may be late
    assert all(times[j, e, 2] - times[j, e, 1] > 0.5 for j, e in (("a", "2"), ("b", "1"), ("b", "2")))
