"""Calls of services: once a text, at a rate, failures as rows; and tables that are replaced by key."""

import datetime
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import providers
from skeinflow.operators import chat, enrich, ingest, lifecycle, services, store


def counting(folder, fail=(), throttle=()):
    """A provider that notes each call in a file; texts with a word of `fail` raise, those of `throttle` do so twice."""

    def call(text):
        name = f"{folder}/{abs(hash(text))}"
        with open(name, "a") as f:
            f.write(f"{time.time()} {text}\n")
        with open(name) as f:
            n = len(f.readlines())
        if any(w in text for w in fail):
            raise RuntimeError(f"refused {text}")
        if any(w in text for w in throttle) and n < 3:
            raise providers.Throttled
        return [float(len(text)), 2.0]

    return call


def calls(folder):
    return sorted(line.split(" ", 1)[1].strip() for name in glob.glob(f"{folder}/*") for line in open(name))


@pytest.fixture
def notes(tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONHASHSEED", "0")
    os.mkdir(f"{tmp_path}/notes")
    return f"{tmp_path}/notes"


def test_each_text_is_asked_once(spark, tmp_path, notes):
    service, ledger = services.Service("count", counting(notes, fail=["bad"], throttle=["slow"]), pause=0.01), f"{tmp_path}/ledger"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two", "one", "bad", "slow", None, " ", ""])], "id int, t string")
    done = services.ask(rows, "t", service, ledger)
    for _ in range(3):
        assert done.count() == 8
    got = {r.id: (r.answer, r.error) for r in done.collect()}
    assert got[0] == got[2] == ([3.0, 2.0], None) and got[3] == (None, "RuntimeError: refused bad") and got[4] == ([4.0, 2.0], None) and got[5] == got[6] == got[7] == (None, None)
    assert calls(notes) == ["bad", "one", "slow", "slow", "slow", "two"]
    assert {r.content_hash: r.attempts for r in services.answers(spark, ledger, service).collect()}[spark.range(1).select(F.sha2(F.lit("slow"), 256)).first()[0]] == 3
    again = services.ask(rows.unionByName(spark.createDataFrame([(9, "new")], "id int, t string")), "t", service, ledger)
    assert again.where("id = 9").first().answer == [3.0, 2.0] and calls(notes) == ["bad", "bad", "new", "one", "slow", "slow", "slow", "two"]
    assert services.ask(rows.limit(0), "t", service, f"{tmp_path}/none").count() == 0


def test_tasks_share_the_rate(spark, tmp_path, notes):
    service = services.Service("rate", counting(notes), tasks=4, per_second=20.0)
    rows = spark.createDataFrame([(f"text {i}",) for i in range(60)], "t string")
    services.ask(rows, "t", service, f"{tmp_path}/ledger")
    times = sorted(float(line.split(" ")[0]) for name in glob.glob(f"{notes}/*") for line in open(name))
    assert len(times) == 60 and all(times[i + 25] - times[i] > 1 for i in range(len(times) - 25))  # of a second at most 20 + 4


def worker(spark):
    jobs = spark.createDataFrame([(1, "PARTIALLY_ENRICHED"), (2, "PARTIALLY_ENRICHED")], "id long, status string")
    elements = spark.createDataFrame([(1, "ENRICHED"), (2, "ENRICHED")], "cleansed_id long, status string")
    at = datetime.datetime(2020, 1, 1)
    sections = spark.createDataFrame([(10, 1, "s", "/a", "good text. " * 80, "PENDING_EMBEDDING", at), (20, 2, "s", "/b", "bad text", "PENDING_EMBEDDING", at)], "id long, cleansed_id long, source_uri string, section_path string, cleansed_text string, status string, saved_at timestamp")
    return jobs, elements, sections, spark.createDataFrame([], "section_id long, position int, chunk_text string, source_field string, section_path string, vector array<float>")


def test_the_worker_calls_once_and_leaves_failures_pending(spark, tmp_path, notes):
    service, ledger = services.Service("embed", counting(notes, fail=["bad"])), f"{tmp_path}/ledger"
    done = enrich.embed_pending(*worker(spark), service, ledger=ledger)
    assert {r.id: r.status for r in done.sections.collect()} == {10: "EMBEDDED", 20: "PENDING_EMBEDDING"}
    assert {r.id: r.status for r in done.jobs.collect()} == {1: "ENRICHED_COMPLETE", 2: "PARTIALLY_ENRICHED"}
    chunks = done.chunks.collect()
    assert {r.section_id for r in chunks} == {10} and all(len(r.vector) == 2 for r in chunks)
    asked = calls(notes)
    assert len(asked) == len(set(asked)) == len({r.chunk_text.strip() for r in chunks}) + 1
    assert "ArrowEvalPython" not in done.jobs._jdf.queryExecution().toString() and "MapInPandas" not in done.chunks._jdf.queryExecution().toString()
    assert enrich.embed_pending(*worker(spark), service, ledger=ledger).chunks.count() == len(chunks) and len(calls(notes)) == len(asked) + 1


def test_embed_without_a_ledger_and_interpreters_that_fail(spark):
    def provider(text):
        if text == "bad":
            raise RuntimeError
        return [1.0]

    rows = spark.createDataFrame([("good",), ("bad",), (None,)], "t string")
    assert sorted((r.t or "", r.vector) for r in lifecycle.embed(rows, "t", provider).collect()) == [("", None), ("bad", None), ("good", [1.0])]
    assert chat.interpreted(chat.Request("hero-section"), lambda _: 1 / 0) is None
    assert providers.parsed(lambda: '```json\n{"a": 1}\n```')() == {"a": 1} and providers.parsed(lambda: None)() is None
    with pytest.raises(json.JSONDecodeError):
        providers.parsed(lambda: "no")()


SCHEMA = "k string, j int, v int"


def state(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_a_keyed_table_is_never_lost(spark, tmp_path, monkeypatch):
    table = store.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ("k", "j"), 8)
    assert state(table) == []
    first = [(f"k{i}", None if i % 3 == 0 else i, i) for i in range(50)] + [(None, None, 7)]
    assert table.upsert(spark.createDataFrame(first, SCHEMA)) == 1 and state(table) == sorted(first, key=str)
    opened = table.read()
    change = spark.createDataFrame([(None, None, 8), ("k3", None, 99), ("new", 1, 1)], SCHEMA)

    # stopped at each step: while the rows are written, before the list is, and while it is
    steps = []
    plain = type(change.write).parquet

    def dying(self, path, *args, **kwargs):
        if len(steps) == dies_at:
            if how == "after":
                plain(self, path, *args, **kwargs) if "/lists/" not in path else None
            raise KeyboardInterrupt
        steps.append(path)
        return plain(self, path, *args, **kwargs)

    for dies_at, how in ((0, "before"), (0, "after"), (1, "before")):
        steps.clear()
        with monkeypatch.context() as m:
            m.setattr(type(change.write), "parquet", dying)
            with pytest.raises(KeyboardInterrupt):
                table.upsert(change)
        assert state(table) == sorted(first, key=str)
    assert table.upsert(change) == 2
    want = {(k, j): v for k, j, v in first} | {(None, None): 8, ("k3", None): 99, ("new", 1): 1}
    assert state(table) == sorted(((k, j, v) for (k, j), v in want.items()), key=str)
    assert opened.count() == 51  # a reader of the state before goes on
    written = glob.glob(f"{tmp_path}/t/rows/*/bucket=*")
    newest = table._listed()[1]
    assert len(set(newest.values())) == 2 and sum(f != min(newest.values(), key=list(newest.values()).count) for f in newest.values()) >= 5
    assert len(written) > 8 and table.upsert(change.limit(0)) == 2


def test_hashes_are_kept_by_key(spark, tmp_path):
    table = ingest.hash_table(spark, f"{tmp_path}/h", 16)
    items = spark.createDataFrame([("p", "t", None, "h1", None, 0), ("p", "t", "", "h2", None, 1), (None, "t", "", "x", None, 2), ("q", "t", "u", "h3", "c", 3)], "source_path string, item_type string, usage_path string, content_hash string, context_hash string, ordinal int")
    ingest.save_hashes(table, items)
    assert state(table) == [("p", "t", "", "h2", None), ("q", "t", "u", "h3", "c")]
    ingest.save_hashes(table, items.where("source_path = 'q'").withColumn("content_hash", F.lit("h4")))
    assert state(table) == [("p", "t", "", "h2", None), ("q", "t", "u", "h4", "c")] and ingest.changed_globally(items, table.read()).count() == 2
