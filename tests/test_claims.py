"""Leases of several workers, counts of runs, and objects of which some are missing."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import leases, progress
from skeinflow.sources import json_items


def pending(spark, n):
    at = datetime.datetime(2020, 1, 1)
    return spark.createDataFrame([(i, "text" if i % 7 else " ", at + datetime.timedelta(minutes=n - i)) for i in range(n)], "id long, t string, saved_at timestamp"), spark.createDataFrame([(1,)], "id long")


def test_a_lease_ends_and_its_number_is_refused(spark, tmp_path):
    now = [1000.0]
    book = leases.Leases(spark, f"{tmp_path}/claims", 60.0, clock=lambda: now[0])
    rows, done = pending(spark, 12)
    take = lambda who, k: book.claim(who, rows, done, "id", "t", "saved_at", k)
    a, b = take("a", 4), take("b", 4)
    ids = lambda c: [r.id for r in c.rows.collect()]
    assert (a.number, ids(a)) == (1, [11, 10, 9, 8]) and (b.number, ids(b)) == (2, [6, 5, 4, 3])  # 7 is blank, 1 is done
    assert book.finish(a.number, [11, 10]) == ["10", "11"] and book.finish(a.number, [11]) == []
    now[0] += 61
    c = take("c", 3)  # a and b are dead
    assert ids(c) == [9, 8, 6] and book.finish(a.number, [9]) == [] and book.finish(c.number, [9, 8, 6, 2]) == ["6", "8", "9"]
    assert sorted(ids(take("d", 9))) == [2, 3, 4, 5] and take("e", 5).number == 0
    assert book.claim("f", rows.limit(0), done, "id", "t", "saved_at", 5).rows.count() == 0


def test_workers_at_once_share_no_row(spark, tmp_path):
    book = leases.Leases(spark, f"{tmp_path}/claims")
    rows, done = pending(spark, 40)
    rows, done = rows.cache(), done.cache()
    got, errors = [], []

    def work(name):
        try:
            for _ in range(2):
                got.extend((name, r.id) for r in book.claim(name, rows, done, "id", "t", "saved_at", 4).rows.collect())
        except Exception as e:  # seen by the test
            errors.append(e)

    threads = [threading.Thread(target=work, args=(str(k),)) for k in range(3)]
    [t.start() for t in threads]
    [t.join(150) for t in threads]
    assert not errors and len(got) == 24 and len({i for _, i in got}) == 24
    assert leases.put_new(spark, f"{tmp_path}/claims/x", "a") and not leases.put_new(spark, f"{tmp_path}/claims/x", "b")


def test_counts_of_a_run(spark, tmp_path):
    run = progress.Progress(spark, "run 1")
    found = run.counted(spark.range(50), "items", even=F.col("id") % 2 == 0)
    queued = run.counted(found.where("id % 5 <> 0"), "queued", none=F.lit(False))
    queued.write.parquet(f"{tmp_path}/queued")
    run.save(f"{tmp_path}/counts")
    rows = {(r.step, r.name): r.n for r in spark.read.parquet(f"{tmp_path}/counts").collect()}
    assert rows == {("items", "rows"): 50, ("items", "even"): 25, ("queued", "rows"): spark.read.parquet(f"{tmp_path}/queued").count(), ("queued", "none"): 0}


def test_counts_of_batches(spark, tmp_path):
    listener = progress.BatchCounts()
    spark.streams.addListener(listener)
    try:
        for part in (range(3), range(4)):
            spark.createDataFrame([(i,) for i in part], "i long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("i long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").groupBy("i").count()
        query = stream.writeStream.queryName("counts").format("memory").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(90)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(n for name, _, n, _ in listener.batches if name == "counts") == 7 and listener.batches[-1][3] == 4


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_objects_that_are_missing_are_null(spark, tmp_path, scheme):
    for name, text in (("a.json", '{"copy":"x"}'), ("deep/b{1}.json", '{"copy":"y"}'), ("deep/a.json", '{"copy":"z"}'), ("other.json", "{}")):
        path = tmp_path / "bucket" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = json_items.read_objects(spark, f"{scheme}{tmp_path}/bucket/", ["a.json", "none.json", "deep/b{1}.json", "deep/none.json", "a.json"])
    assert {r.key: r.json for r in got.collect()} == {"a.json": '{"copy":"x"}', "none.json": None, "deep/b{1}.json": '{"copy":"y"}', "deep/none.json": None}
    assert got.count() == 4 and json_items.extract_items(got).count() == 2
    assert [r.json for r in json_items.read_objects(spark, f"{scheme}{tmp_path}/absent", ["a"]).collect()] == [None] and json_items.read_objects(spark, f"{scheme}{tmp_path}/bucket", []).count() == 0
