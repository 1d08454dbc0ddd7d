"""The shuffle's exact counts, its laws, and the files that it writes."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import sharding
from skeinflow.llm.queries import op13_sharding


def written(spark, tmp_path, rows, files=3):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def whole(rows, n_shards, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n and set(by) <= set(range(n_shards))
    for s in range(n_shards):
        assert sorted(by[s]) == list(range(n // n_shards + (s < n % n_shards)))


@pytest.mark.parametrize("n,n_shards", [(1000, 24), (7, 24), (1, 1), (0, 3), (48, 24)])
def test_exact_sizes(spark, tmp_path, monkeypatch, n, n_shards):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)
    monkeypatch.setattr(sharding, "FAN_BITS", 2)  # a tree of several levels
    monkeypatch.setattr(sharding, "PART_BYTES", 64)
    rows = sharding.shards(written(spark, tmp_path, [(i, "x" * (i % 50)) for i in range(n)]), n_shards).collect()
    whole(rows, n_shards, n)
    assert sorted(r.doc_id for r in rows) == list(range(n))


def test_same_result_whatever_the_splits(spark, tmp_path):
    docs = written(spark, tmp_path, [(i, str(i)) for i in range(3000)])
    first = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 5).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 5).collect()} == first
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 5, seed=1).collect()} != first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    slots = np.array([v for _, v in sorted(first.items())])
    assert abs(np.corrcoef(np.arange(3000), slots[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(slots[1:, 1], slots[:-1, 1])[0, 1]) < 0.1


def test_a_large_matrix_is_not_broadcast(spark, tmp_path, monkeypatch):
    docs = written(spark, tmp_path, [(i, str(i)) for i in range(500)])
    small = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 5).collect()}
    monkeypatch.setattr(sharding, "MATRIX_BYTES", 0)
    far = sharding.shards(docs, 5)
    assert "BroadcastHashJoin" not in far._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.shard, r.slot) for r in far.collect()} == small


def test_frames_that_are_no_plain_scans(spark, tmp_path):
    docs = written(spark, tmp_path, [(i, None if i % 7 == 0 else "é" * i) for i in range(200)])
    whole(sharding.shards(docs.where("doc_id % 3 = 0"), 4).collect(), 4, 67)
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    whole(sharding.shards(twice, 4).collect(), 4, 400)
    made = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot", "3 as n", "4 as first", "5 as `a.b`", "6 as counts", "7 as part")
    got = sharding.shards(made, 2)
    assert got.columns == ["doc_id", "text", "n", "first", "a.b", "counts", "part", "shard", "slot"]
    whole(got.collect(), 2, 4)
    assert {(r.n, r["a.b"], r.part) for r in got.collect()} == {(3, 5, 7)} and sharding.shards(made.limit(0), 2).count() == 0


def test_files(spark, tmp_path):
    docs = written(spark, tmp_path, [(i, f"text {i}") for i in range(101)])
    sharding.write_shards(docs, 3, f"{tmp_path}/out")
    want = {(r.shard, r.slot): (r.doc_id, r.text) for r in sharding.shards(docs, 3).collect()}
    for s in range(3):
        rows = sharding.read_shard(spark, f"{tmp_path}/out", s).collect()
        assert [(r.doc_id, r.text) for r in rows] == [want[s, k] for k in range(len(rows))] and len(rows) in (33, 34)


def test_every_assignment_is_equally_likely():
    """Six rows in blocks of 4, 1 and 1, shards of 2, 2 and 2: each of the 90 ways about as often."""
    seen = Counter()
    for k in range(9000):
        rng = np.random.default_rng([k, 1])
        counts = sharding.deal(rng, np.array([2, 2, 2]), np.array([4, 1, 1]))
        assert counts.sum(axis=0).tolist() == [2, 2, 2] and counts.sum(axis=1).tolist() == [4, 1, 1]
        seen[tuple(s for b, row in enumerate(counts) for s in sharding.permuted(k, b, tuple(row.tolist())).tolist())] += 1
    assert len(seen) == 90 and sum((c - 100) ** 2 / 100 for c in seen.values()) < 140  # 0.9995 of chi square at 89


def test_counts_beyond_the_sampler():
    rng = np.random.default_rng(0)
    good, bad, n = 3 * 10**9, 5 * 10**9, 2 * 10**9
    draws = np.array([sharding._binary_hypergeometric(rng, good, bad, n) for _ in range(300)], float)
    p, total = good / (good + bad), good + bad
    sd = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
    assert abs(draws.mean() - n * p) < 5 * sd / 300**0.5 and 0.8 < draws.std() / sd < 1.2
    out = sharding.deal(rng, np.array([10**9, 10**9, 10**9]), np.array([10**9 + 7, 2 * 10**9 - 7]))
    assert out.sum(axis=0).tolist() == [10**9] * 3 and out.sum(axis=1).tolist() == [10**9 + 7, 2 * 10**9 - 7] and (out >= 0).all()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op13_sharding(spark, d).collect()
    whole(rows, 24, len(docs))
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert len({r.doc_id for r in rows}) == len(docs)
