import hashlib

import pytest

from skeinflow.llm import suffixdedup


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            if least.get(s, 1 << 62) > i:
                least[s] = i
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [4000, 1 << 23])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    import random

    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 120), (5, "\0" * 200), (6, "\0" * 90)]
    for i in range(7, 90):
        text = " ".join(word() for _ in range(rnd.randint(0, 60)))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 40)
            cut = rnd.randint(0, len(text))
            text = text[:cut] + p[a : a + rnd.randint(30, 150)] + text[cut:]
        rows.append((i, text))
    rows += [(100 + k, rows[20 + k % 3][1]) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup(df).collect()}
    assert got == brute(rows)


def test_merge_needs_no_known_prefix():
    import numpy as np

    rng = np.random.default_rng(3)
    runs = []
    for _ in range(5):
        rows = np.unique(rng.integers(97, 99, (40, suffixdedup.SUFFIX)).astype(np.uint8) * (np.arange(suffixdedup.SUFFIX) < 8), axis=0).astype(np.uint8)
        lcps, rest = suffixdedup.front_code(rows)
        strings = suffixdedup.decode(lcps, rest)
        assert strings == [r.tobytes() for r in rows]
        runs.append((strings, lcps))
    merged = list(suffixdedup.merge(runs))
    assert [m[0] for m in merged] == sorted(s for strings, _ in runs for s in strings)
    for (a, _, _, _), (b, h, _, _) in zip(merged, merged[1:]):
        assert a[:h] == b[:h] and (h == len(a) or a[h] != b[h])


def test_several_levels(spark, monkeypatch):
    import random

    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(suffixdedup, "FAN", 4)
    rnd = random.Random(11)
    passages = ["".join(rnd.choice("abcdeé ") for _ in range(160)) for _ in range(5)]
    rows = [(None, passages[0]), (None, passages[0]), (0, None), (1, "")]
    for i in range(2, 120):
        text = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 200)))
        for _ in range(rnd.randint(0, 2)):
            p, a, at = rnd.choice(passages), rnd.randint(0, 60), rnd.randint(0, len(text))
            text = text[:at] + p[a : a + rnd.randint(30, 150)] + text[at:]
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = -(-sum(len((t or "").encode()) for _, t in rows) // 300)
    assert suffixdedup.Route(blocks, blocks // 4).levels == 3
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup(df).collect()}
    plain = brute([(1 << 61 if i is None else i, t) for i, t in rows])
    plain[None] = plain.pop(1 << 61)
    assert got == plain


def test_rows_of_the_exchange_grow_with_the_blocks():
    def rows(blocks):
        route = suffixdedup.Route(blocks, max(8, blocks // 4))
        assert route.shards >= blocks // 4 and route.span**route.levels >= blocks
        return sum(route.nodes(level) * route.fan for level in range(route.levels))

    for gigabytes in (0.5, 30, 1000, 100_000):
        blocks = int(gigabytes * 1e9 / suffixdedup.BLOCK_BYTES)
        assert rows(blocks) <= 3 * suffixdedup.FAN * blocks


def test_a_shard_stays_as_large_as_a_block():
    import numpy as np

    rng = np.random.default_rng(5)
    for blocks in (40, 5000, 300_000):
        route = suffixdedup.Route(blocks, blocks // 4)
        names = np.sort(suffixdedup.spread(rng.integers(0, 1 << 40, 400_000).astype(np.uint64)))  # hashes that are small, as those of anchors
        shard = route.shard(names)
        assert (np.diff(shard) >= 0).all() and shard.min() >= 0 and shard.max() < route.shards
        tenth = np.bincount(shard * 10 // route.shards, minlength=10) / len(names)
        assert abs(tenth - 0.1).max() < 0.01
