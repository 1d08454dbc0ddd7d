"""Operators on nulls, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skeinflow.llm import chat, decontaminate, simhash, suffixdedup, tokencount, toxicity, urls
from skeinflow.llm.queries import VOCABULARY

LONG = "a very long line of words that goes on and on. " * 6000
CLASH = ["1 as id", "2 as block", "3 as rest", "4 as `a.b`", "5 as hash", "6 as h", "7 as w", "8 as kept", "9 as digest", "10 as shingles", "11 as n_bytes", "12 as url", "13 as host"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None), (None, LONG), (None, LONG), (1, ""), (2, LONG), (2, LONG), (3, LONG), (4, "short"), (5, "\0\0"), (6, "é" * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH)


def test_suffix_dedup(odd):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.rest["a.b"], r.kept_sha256) for r in suffixdedup.dedup(odd).collect()), key=str)
    n, digest = len(LONG), lambda t: hashlib.sha256(t.encode()).hexdigest()
    gone = [(i, b, r) for i, b, r, four, h in got]
    assert gone == sorted([(None, 0, 0), (None, n, n), (None, n, n), (1, 0, 0), (2, n, 0), (2, n, 0), (3, n, n), (4, 5, 0), (5, 2, 0), (6, 120, 0)], key=str)
    assert {h for i, _, _, _, h in got if i == 3} == {digest("")} and {h for i, _, _, _, h in got if i == 2} == {digest(LONG)} and {x[3] for x in got} == {4}
    assert suffixdedup.dedup(odd.limit(0)).count() == 0 and suffixdedup.keep_first(odd.limit(0)).count() == 0
    kept = suffixdedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 2, 2, 4, 5, 6], key=str)


def test_cut_characters_go(spark):
    shared = "x" * 48 + "é"  # fifty bytes, the last of which may stand alone
    docs = spark.createDataFrame([(1, shared), (2, "a" + shared + "b")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixdedup.keep_first(docs).collect()} == {1: shared, 2: "ab"}
    docs = spark.createDataFrame([(1, "é" + "x" * 49), (2, "ê"[:0] + "ã" + "x" * 49)], "doc_id long, text string")  # é and ã share their first byte only
    assert {r.doc_id: r.text for r in suffixdedup.keep_first(docs).collect()} == {1: "é" + "x" * 49, 2: "ã" + "x" * 49}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")
def test_token_counts(odd):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens > 0) for r in tokencount.token_counts(odd, VOCABULARY).collect()), key=str)
    assert got == sorted([(None, 0, False), (None, len(LONG), True), (None, len(LONG), True), (1, 0, False), (2, len(LONG), True), (2, len(LONG), True), (3, len(LONG), True), (4, 5, True), (5, 2, True), (6, 120, True)], key=str)
    assert len({r.n_tokens for r in tokencount.token_counts(odd, VOCABULARY).where("n_bytes > 1000").collect()}) == 1
    assert tokencount.token_counts(odd.limit(0), VOCABULARY).count() == 0


def test_long_pretokens_take_little_time():
    import time

    import numpy as np

    pieces = tokencount.Pieces({b"ab": -1.0, b" a": -1.0, b"abc": -1.5, b"b": -2.0}, -9.0)
    raw = b"abcab" * 40_000
    began = time.time()
    tokens, _ = tokencount.Counter(pieces).rows(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    assert time.time() - began < 5 and tokens.tolist() == [2 * 40_000 + 1]


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "a very long line of words that goes on and on"), (1, "a very long line of words that goes on and on"), (2, None), (3, ""), (4, LONG), (None, "short")], "item_id long, text string").selectExpr("*", "1 as id", "2 as hash", "3 as width")
    pairs = {(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained_items(odd, items).collect()}
    assert pairs == {(i, k, 1.0) for i in (2, 3) for k in (1, 4)} | {(4, None, 1.0)}
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None] * 3 + [1, 5, 6], key=str)
    assert decontaminate.contained_items(odd.limit(0), items).count() == 0 and decontaminate.keep_clean(odd, items.limit(0)).count() == 10


def test_simhash(odd):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(odd).collect()), key=str)
    assert [x for x in got if x[0] in (2, 3)] == [(2, 2), (2, 2), (3, 2)]
    assert [c for i, c in got if i is None] == [1, 2, 2]  # null ids are in the components of their texts
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.simhash_components(odd.limit(0)).count() == 0 == simhash.simhash_components(odd.limit(0), similarity=0.8).count()


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)] + [(None, 1), (2, None), (2, 1)], "doc_id long, toxic int").selectExpr("*", "1 as id", "2 as label", "3 as fold")
    done = toxicity.score(odd, toxicity.train(odd, labels))
    assert done.count() == 10 and done.where("score >= 0 and score <= 1").count() == 10
    assert toxicity.score(odd.limit(0), toxicity.train(odd.limit(0), labels)).count() == 0


def test_urls(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "http://" + "a." * 2000 + "net/"), (3, "x://NET/"), (4, "x://.net/"), (5, "a://b://net/"), (6, "http://net" + "/" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as id", "2 as host", "3 as rule", "4 as `a.b`")
    rules = [("net", "/", "allow"), ("net", "/", "block"), ("a.net", "/", "allow")]
    got = sorted(((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(None, None, "allow"), (1, None, "allow"), (1, None, "allow"), (2, "a.net/", "allow"), (3, "net/", "block"), (4, "net/", "block"), (5, None, "allow"), (6, "net/", "block")], key=str)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_equal_digests_are_told_apart_by_their_strings(tmp_path):
    import numpy as np

    files = urls.digest_files([("a", "/", "block"), ("b", "/", "allow"), ("c", "/", "block")])
    files["digest"] = np.full(3, 7, "<u8").tobytes()  # as if all had one digest
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    array = urls.DigestArray(lambda n: str(tmp_path / n))
    import xxhash

    original, xxhash.xxh64_intdigest = xxhash.xxh64_intdigest, lambda k: 7
    try:
        assert [array.string(k) if k >= 0 else None for k in array.find([b"a/", b"c/", b"d/"])] == [b"a/", b"c/", None]
    finally:
        xxhash.xxh64_intdigest = original


def test_chat(spark):
    rows = [(None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", LONG), (2, 5, "assistant", ""), (3, 2, "b", "second"), (3, 1, "a", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as turns", "3 as pieces", "4 as t")
    done = chat.format_conversations(df)
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in done.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {None: [("", "")], 1: [("user", "x"), ("user", "x"), ("assistant", LONG)], 2: [("assistant", "")], 3: [("a", "first"), ("b", "second")]}
    assert chat.format_conversations(df.limit(0)).count() == 0
