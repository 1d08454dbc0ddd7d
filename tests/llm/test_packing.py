"""Packing against plain versions of the same rules, the best possible cost on small cases, and odd rows."""

import os

import numpy as np
import pytest

from skeinflow.llm import packing, tokencount
from skeinflow.llm.queries import VOCABULARY

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")


def slow_filled(sizes, room):
    taken = 0
    for s in sorted(sizes, reverse=True):
        if s <= room:
            room -= s
            taken += s
    return taken


def slow_pack(sizes, capacities):
    """(capacity, items) of each bin, by lists."""
    rest = sorted(sizes, reverse=True)
    bins = []
    while rest:
        size = rest.pop(0)
        fits = [b for b in bins if b[0] - sum(b[1]) >= size]
        if fits:
            min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(size)
        else:
            capacity = min((c for c in capacities if c >= size), key=lambda c: (packing.cost(c) / (size + slow_filled(rest, c - size)), c))
            bins.append([capacity, [size]])
    return sorted((min(c for c in capacities if c >= sum(x)), sorted(x)) for _, x in bins)


def bins_of(sizes, placed):
    bins = {}
    for size, (b, offset, capacity) in zip(sizes, placed, strict=True):
        bins.setdefault(b, []).append((offset, size, capacity))
    for rows in bins.values():
        rows.sort()
        assert len({c for _, _, c in rows}) == 1
        at = 0
        for offset, size, capacity in rows:
            assert offset == at and offset + size <= capacity
            at += size
    return sorted((rows[0][2], sorted(s for _, s, _ in rows)) for rows in bins.values())


@pytest.mark.parametrize("seed", range(30))
def test_pack_against_plain_version(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(rng.choice([0.002, 0.01, 0.1]), rng.integers(1, 120)), 1024).tolist()
    assert bins_of(sizes, packing.pack(sizes, (128, 256, 512, 1024))) == slow_pack(sizes, (128, 256, 512, 1024))


def best_cost(sizes, capacities):
    """The least cost of all packings."""
    least = [float("inf")]

    def put(i, bins):
        if i == len(sizes):
            least[0] = min(least[0], sum(packing.cost(min(c for c in capacities if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(capacities):
                put(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return least[0]


def test_cost_is_near_the_least_possible():
    rng = np.random.default_rng(3)
    ratios = []
    for _ in range(40):
        sizes = rng.integers(100, 6000, 7).tolist()
        own = sum(packing.cost(c) for c, _ in bins_of(sizes, packing.pack(sizes, packing.CAPACITIES)))
        ratios.append(own / best_cost(sizes, packing.CAPACITIES))
    assert max(ratios) <= 1.35 and np.mean(ratios) <= 1.1


def test_several_lengths_are_opened():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.geometric(0.002, 3000), 8192).tolist()
    placed = packing.pack(sizes, packing.CAPACITIES)
    bins = bins_of(sizes, placed)
    assert len({c for c, _ in bins}) >= 3
    joint = sum(packing.cost(c) for c, _ in bins)
    for only in (2048, 4096, 8192):
        some = [s for s in sizes if s <= only]
        assert len(some) < len(sizes) or joint < sum(packing.cost(c) for c, _ in bins_of(some, packing.pack(some, (only,))))


@needs_vocabulary
def test_rows_that_are_odd(spark):
    blob = "x9Q/" * 900
    rows = [(2**53 + 1, "a few words"), (None, "a few words"), (5, None), (5, ""), (6, "word " * 700 + blob + " é" * 300), (6, "word " * 700 + blob + " é" * 300), (7, "漢" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as piece", "3 as `a.b`", "4 as _deal")
    packed = packing.best_fit(docs, VOCABULARY, capacities=(64, 256)).collect()
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=str) == sorted((i for i, _ in rows), key=str)
    bins = {}
    for r in packed:
        assert (r.bin_id is None) == (r.length == 0)
        if r.length:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.capacity))
    for x in bins.values():
        assert sum(n for _, n, _ in x) <= x[0][2] in (64, 256)
    for i, t in ((2**53 + 1, rows[0][1]), (7, rows[6][1])):
        own = sorted((r.start, r.bytes) for r in packed if r.doc_id == i)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(t.encode())
    assert packing.best_fit(docs.limit(0), VOCABULARY).count() == 0


@needs_vocabulary
def test_contents_give_the_texts_back(spark):
    rows = [(i, f"words of number {i} " * (i * 7 % 90)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.best_fit(docs, VOCABULARY, capacities=(64, 128))
    texts = {}
    for b in packing.contents(packed, docs).collect():
        assert sum(p.length for p in b.pieces) == b.n_tokens <= b.capacity
        assert [p.bin_offset for p in b.pieces] == [sum(q.length for q in b.pieces[:k]) for k in range(len(b.pieces))]
        for p in b.pieces:
            texts.setdefault(p.id, {})[p.piece] = bytes(p.text)
    assert {i: b"".join(x[k] for k in sorted(x)).decode() for i, x in texts.items()} == {i: t for i, t in rows if t}
    # a whole text's pieces are counted as op3 counts it
    counted = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, VOCABULARY).collect()}
    lengths = {}
    for r in packed.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == counted
