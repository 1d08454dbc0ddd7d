"""The log's replay against a plain one, over many short segments too; running totals against plain ones."""

import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import running, txlog
from skeinflow.llm.queries import op12_transactions

SCHEMA = "source string, position long, action int, key long, value long"


def plain(records, size=16):
    """(undone rows, state rows) of records in the order of the log, one after another."""
    undone, states, store, open_ones, commits = [], [], {}, defaultdict(lambda: [[], 0]), 0

    def state():
        states.append((len(states) + 1, len(store), sum(store.values())))

    for source, pos, action, key, value in records:
        live = open_ones[source]
        if action == txlog.CHANGE:
            live[0].append((pos, key, value))
        elif action == txlog.SAVEPOINT:
            live[1] = len(live[0])
        elif action == txlog.ROLLBACK:
            undone += [("rollback", p, pos, k) for p, k, _ in live[0][live[1] :]]
            del live[0][live[1] :]
        else:
            if action == txlog.ABORT:
                undone += [("abort", p, pos, k) for p, k, _ in live[0]]
            else:
                for _, k, v in live[0]:
                    store.pop(k, None) if v is None else store.__setitem__(k, v)
                commits += 1
                if commits % size == 0:
                    state()
            del open_ones[source]
    undone += [("abort", p, None, k) for live, _ in open_ones.values() for p, k, _ in live]
    if commits % size:
        state()
    return sorted(undone, key=str), states


def replayed(log, size=16):
    done = txlog.replay(log, size)
    return sorted((tuple(r) for r in done.undone.collect()), key=str), sorted(tuple(r) for r in done.states.collect())


@pytest.mark.parametrize("seed,bits,weights", [(1, 3, (20, 2, 3, 2, 1)), (2, 10, (10, 2, 2, 1, 1)), (3, 2, (30, 1, 1, 0.3, 0.1)), (4, 10, (5, 0, 1, 0, 0))])
def test_random_logs(spark, monkeypatch, seed, bits, weights):
    monkeypatch.setattr(running, "BITS", bits)
    monkeypatch.setattr(txlog, "BITS", bits)
    rng = random.Random(seed)
    places = sorted(rng.sample(range(-300, 900), 500)) if seed % 2 else sorted({rng.randrange(-(2**40), 2**40) for _ in range(300)})
    rows = []
    for p in places:
        a = rng.choices(range(5), weights)[0]
        rows.append((rng.choice(["hot", "hot", "hot", "a", "", None]), p, a, rng.randrange(9) if a == 0 else None, rng.choice([None, *range(5)]) if a == 0 else None))
    shuffled = rng.sample(rows, len(rows))
    assert replayed(spark.createDataFrame(shuffled, SCHEMA), 3) == plain(rows, 3)


def test_rows_that_are_odd(spark):
    rows = [("s", 1, 0, 1, 5), ("s", 1, 0, 1, None), ("s", None, 3, None, None), ("s", 2, None, 1, 1), ("s", 3, 0, None, 1), ("s", 4, 3, None, None), ("t", 4, 3, None, None), ("s", 4, 3, None, None), ("s", 5, 0, 2, 7), ("s", 5, 0, 2, 7), ("s", 6, 2, None, None)]
    log = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as blk", "2 as `a.b`", "3 as epoch", "4 as src", "5 as number")
    undone, states = replayed(log, 2)
    assert undone == [("rollback", 5, 6, 2)] * 2 and states == [(1, 1, 5), (2, 1, 5)]  # of one position the null comes first
    assert replayed(log.limit(0)) == ([], [])
    assert replayed(log.where("action = 0"))[1] == [] and len(replayed(log.where("action = 0"))[0]) == 4


@pytest.mark.parametrize("bits", [2, 10])
@pytest.mark.parametrize("how,following,inclusive", [("sum", False, False), ("sum", True, True), ("min", True, False), ("max", False, False), ("max", False, True)])
def test_running_totals(spark, monkeypatch, bits, how, following, inclusive):
    monkeypatch.setattr(running, "BITS", bits)
    rng = random.Random(bits)
    rows = [(k, p, rng.choice([None, 1, 2, 50])) for k in "ab" for p in rng.sample(range(-40, 90), 50)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.k, r.p): r.running_v for r in running.running(df, ["k"], "p", "v", how, running.ends(df, "p"), following, inclusive).collect()}
    f = {"sum": sum, "min": lambda x: min(x, default=None), "max": lambda x: max(x, default=None)}[how]
    for k, p, _ in rows:
        assert got[k, p] == f([v for j, q, v in rows if j == k and v is not None and ((q > p) if following else (q < p)) or j == k and v is not None and inclusive and q == p]), (k, p)


def test_query_against_a_plain_replay(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, source, text, doc_id in (select doc_id from '{d}/labels.parquet' where toxic = 1) from '{d}/documents.parquet' order by doc_id").fetchall()
    records = []
    for i, source, text, toxic in docs:
        h = zlib.crc32(str(i).encode())
        kind = h % 41
        action = txlog.COMMIT if kind < 2 else txlog.ABORT if kind == 2 else txlog.SAVEPOINT if kind < 5 else txlog.ROLLBACK if kind < 7 else txlog.CHANGE
        key = h // 100 % 3000
        records.append((source, i, action, key, None if text is None or toxic else zlib.crc32(f"{key}:{text}".encode())))
    undone, states = plain(records)
    got = [tuple(r) for r in op12_transactions(spark, d).select("kind", "id", "n", "value").collect()]
    assert sorted(got, key=str) == sorted([("state", *s) for s in states] + undone, key=str)


def test_labels_and_texts_of_the_log(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ((10, "x"), (11, None), (12, ""), (None, "x"), (10, "x"))], "doc_id long, text string, source string").withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(10, 1), (10, 1), (10, 0), (12, 0), (None, 1)], "doc_id long, toxic int")
    rows = {(r.position, r.action): r for r in txlog.document_log(docs, labels).collect()}
    assert txlog.document_log(docs, labels).count() == 4 and {p for p, _ in rows} == {10, 11, 12}
    for i, text in ((10, None), (11, None), (12, "")):
        row = next(r for (p, _), r in rows.items() if p == i)
        h = zlib.crc32(str(i).encode())
        if row.action == txlog.CHANGE:
            key = h // 100 % 3000
            assert row.key == key and row.value == (None if text is None else zlib.crc32(f"{key}:{text}".encode()))
