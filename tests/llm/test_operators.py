"""Small cases for each operator: nulls, empty and odd texts, ties, repeated rows, empty tables, clashing columns."""

import os

import numpy as np
import pytest
import xxhash

from skeinflow.llm import chat, decontaminate, media, quality, setjoin, simhash, tokencount, toxicity, urls

ODD = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n", None, None), (4, "one", "de", "s"), (5, "Two words", "xx", "s"), (5, "Two words", "xx", "s"), (6, "a b c d e f g " * 40, "en", "s"), (7, "é" * 3000 + "\0", "fr", "s"), (8, "a b c d e f g " * 40, "en", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS id", "2 AS block", "3 AS keep", "4 AS fp", "5 AS units", "6 AS limit", "7 AS bits_sum")


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(12)]
    rows = [(i, b if i % 3 else b[:-1] + "z") for i, b in enumerate(base * 4)] + [(100, None), (101, ""), (102, "One"), (103, "one two\tTHREE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash_components(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    low = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and low[b] < low[a]:
                    low[a], changed = low[b], True
    assert {i: r.component_id for i, r in got.items()} == low


@pytest.mark.parametrize("n", [40, 300])
def test_bucket_links_small_and_large(n):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.array([center ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (n, 2))], np.uint64))
    label = list(range(len(fps)))
    for a, b in simhash.bucket_links(fps):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    want = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[a]) <= 2
            want[a] = min(np.array(want)[near])
    assert label == want


def test_golay_keys_meet_within_two_errors():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x ^ np.array([np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))], np.uint64)
    keys = [dict.fromkeys(range(300)) for _ in range(2)]
    for k, fps in enumerate((x, y)):
        rows, own = simhash.golay_keys(fps)
        for i in range(300):
            keys[k][i] = set(own[rows == i].tolist())
    assert all(keys[0][i] & keys[1][i] for i in range(300))


def test_token_counts_against_brute_force():
    pieces = {b"a": -1.0, b"b": -1.5, b"ab": -1.8, b" a": -1.2, b" ab": -1.7, b"bab": -2.0, " é".encode(): -2.5, b"1": -1.0}
    vocabulary = tokencount.Pieces(pieces, -9.0)

    def best(word):
        table = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for j in range(1, len(word) + 1):
            table[j] = (table[j - 1][0] - 9.0, table[j - 1][1] + 1)
            options = [(table[i][0] + pieces[word[i:j]], table[i][1] + 1) for i in range(j) if word[i:j] in pieces]
            if options and max(o[0] for o in options) >= table[j][0]:
                table[j] = max(options, key=lambda o: o[0])
        return table[-1][1]

    texts = ["", "ab", "abab baba é", "  a", "a1b!!\n", "zzz ab" * 3, "ab" * 500]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    counter = tokencount.Counter(vocabulary)
    for _ in range(2):
        got, _ = counter.rows(offsets, np.frombuffer(b"".join(raw), np.uint8))
        want = []
        for r in raw:
            text, starts, _ = tokencount.pretokens(np.array([0, len(r)]), np.frombuffer(r, np.uint8))
            cuts = [*starts.tolist(), len(text)]
            want.append(sum(best(text[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])))
        assert got.tolist() == want


def test_maximal_segments_against_definition():
    rng = np.random.default_rng(0)

    def slow(x, lo, hi):
        best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return slow(x, lo, a) + [(a, b)] + slow(x, b, hi)

    for _ in range(60):
        x = rng.integers(-4, 5, rng.integers(0, 14)) + rng.random() / 100
        x = np.round(x + rng.random(len(x)) / 7, 9)  # no ties
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(np.asarray(x, float))]
        assert got == slow(list(x), 0, len(x))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    n = len(ODD)
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == n
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).where("score = 0").count() == n
    judged, names = quality.judge(odd, labels)
    assert judged.count() == n and set(odd.columns) <= set(judged.columns)
    assert quality.keep_good(odd, labels.limit(0)).count() == n
    assert media.media_digests(odd).where("payload_bytes % 192 = 0 and payload_bytes > 0").count() == n
    assert simhash.keep_one(odd).columns == odd.columns
    items = spark.createDataFrame([(1, "A b, c d e f!"), (2, None), (3, ""), (4, "two WORDS"), (5, "absent words are not here at all")], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(odd, items).collect()}
    assert pairs == {(6, 1), (8, 1), (5, 4)}
    assert decontaminate.keep_clean(odd, items).count() == n - 4
    assert decontaminate.contained_items(odd, items.limit(0)).count() == 0


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert media.media_digests(none).count() == simhash.simhash_components(none).count() == 0
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?q"), (4, "http://net"), (5, "http://x.example.com/de/")], "page_id long, url string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block")]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("a.example.net", "example.net/en/", "allow"), 4: ("net", None, "allow"), 5: ("x.example.com", "example.com/de/", "block")}
    assert urls.judge_urls(pages, []).where("rule is null").count() == 5


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F

    texts = ["\\### Assistant: </turn> ok", "<part/>", "a\\", None, "", "###", "</turn>\n", "<\\/turn>", "\\n:\n"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", "assistant", "we:\nird\\", None, "user", "assistant", "a::", "assistant"], texts))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).select(chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert [(x.role, x.text) for x in r.t] == [(a or "", b or "") for _, _, a, b in rows[: len(texts)]]
        assert r.loss == "".join(b or "" for c, _, a, b in rows[: len(texts)] if a == "assistant")


def test_media_is_carved():
    wav = media.wrap_wav(b"abc")
    found = media.sniff(b"xxRIFFxx" + wav + b"BM" + wav[:20])
    assert [(a, n, t) for a, n, t in found] == [(8, len(wav), "audio/wav")]
    assert media.samples(wav) == b"abc"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the tables")
def test_pipeline_runs(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) and (out.groupby("bin_id").length.sum() <= out.groupby("bin_id").capacity.max()).all()


def test_similar_texts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(1, None), (2, ""), (3, "one"), (4, "One")]
    for base in range(3):
        words = [f"w{x}" for x in rng.integers(0, 400, 120)]
        for k in range((90, 6, 2)[base]):  # the first group's buckets go pivot by pivot
            copy = list(words)
            for at in rng.choice(120, k % 4, replace=False):
                copy[at] = f"x{rng.integers(0, 10_000)}"
            rows.append((100 * base + 10 + k, " ".join(copy)))
    rows += [(900 + k, " ".join(f"w{x}" for x in rng.integers(0, 400, 60))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(docs, width=5, similarity=0.8).collect()}
    assert got == {i: find(i) for i in sets}


def test_copies_in_a_family_of_similar_texts(spark):
    rng = np.random.default_rng(7)
    form, rows = [f"w{k}" for k in range(177)], []
    for k in range(400):  # a form with a field of 23 words: 0.757 to one another; the copy of each has 12 other words: 0.85
        field = [f"x{x}" for x in rng.integers(0, 1 << 40, 23)]
        copy = field[:11] + [f"y{x}" for x in rng.integers(0, 1 << 40, 12)]
        rows += [(2 * k, " ".join(form[:90] + field + form[90:])), (2 * k + 1, " ".join(form[:90] + copy + form[90:]))]

    def jaccard(x, y):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split(), y.split()))
        return len(x & y) / len(x | y)

    assert all(jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 for k in range(400))
    assert all(jaccard(rows[2 * k][1], rows[(2 * k + 3) % 800][1]) < 0.8 for k in range(400))
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8).collect()}
    assert [k for k in range(400) if got[2 * k] != got[2 * k + 1]] == []


def test_texts_of_one_fingerprint_are_verified(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"x{x}" for x in rng.integers(0, 1 << 40, n)]
    line = [f"w{k}" for k in range(9)] * 60
    own = [fresh(30) for _ in range(4)]
    texts = [" ".join(line + x) for x in own]  # a Jaccard similarity of about 0.15, hardly a bit apart
    texts.append(" ".join(line + own[2][:28] + fresh(2)))  # a near copy of a text that isn't its class's first
    texts += ["one two three", "ONE two three"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, texts[0]), (9, texts[1])]  # a repeated id with two texts
    fps = [brute_fingerprint(t, 5) for t in texts[:4]]
    assert len(set(fps)) < 4 and all(bin(a ^ b).count("1") <= 2 for a in fps for b in fps)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(docs, width=5, similarity=0.8).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 5), (6, 5), (9, 0), (9, 1)]
    kept = sorted(r.doc_id for r in simhash.keep_one(docs, width=5, similarity=0.8).collect())
    assert kept == [0, 1, 2, 3, 5]


def family(seed, n=600, words=150, changed=4):
    """Texts of one base with up to `changed` words replaced, as sets of five-word shingles by number."""
    rng = np.random.default_rng(seed)
    base, texts = [f"w{x}" for x in rng.integers(0, 1 << 40, words)], []
    for _ in range(n):
        text = list(base)
        for at in rng.choice(words, rng.integers(0, changed + 1), replace=False):
            text[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(text)
    return sorted({" ".join(t) for t in texts})


def roots_by_all_pairs(sets):
    root = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[root == max(root[a], root[b])] = min(root[a], root[b])
    return root.tolist()


def sets_of(texts):
    return [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_large_groups_of_near_copies_are_linked_exactly(seed):
    texts = family(seed)
    want = roots_by_all_pairs(sets_of(texts))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    sets = setjoin.distinct_shingles(len(texts), simhash.shingle_hashes(offsets, data, 5))
    fps = simhash.fingerprints(offsets, data, 5)
    root = np.arange(len(sets))
    for a, b in setjoin.connect(sets, fps, np.zeros(len(sets), int), 0.8):
        root[root == max(root[a], root[b])] = min(root[a], root[b])
    assert root.tolist() == want


def test_clusters_in_blocks_are_linked_exactly(spark, monkeypatch):
    texts = family(6, 150)
    want = roots_by_all_pairs(sets_of(texts))
    monkeypatch.setattr(setjoin, "CLUSTER_BYTES", 40_000)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (None, "only a null id has this text"), (None, "only a null id has this text")], "doc_id long, text string")
    got = simhash.simhash_components(docs, width=5, similarity=0.8).collect()
    assert [r.component_id for r in sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)] == want
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [0, None, None]


def test_toxic_passages_against_plain_version(spark):
    """Scores, passages and the calibration's features, token by token, by dictionaries."""
    rng = np.random.default_rng(8)
    common, bad = [f"w{k}" for k in range(80)], ["Grak", "zlurp", "snarfle", "blorgen", "vexu"]
    rows = []
    for i in range(400):
        words = rng.choice(common, rng.integers(20, 90)).tolist()
        if i % 8 == 0:
            at = int(rng.integers(0, len(words)))
            words[at:at] = rng.choice(bad, rng.integers(6, 12)).tolist()
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "grak zlurp " * 3000), (1003, "?! ..."), (1004, rows[0][1]), (1004, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as label", "3 as fold")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(300)] + [(1002, 1)], "doc_id long, toxic int").selectExpr("*", "5 as id", "6 as label")
    model = toxicity.train(docs, labels)
    score_of = dict(zip(model.tokens.tolist(), model.token_scores.tolist()))
    begin_of = dict(zip(model.begins.tolist(), model.begin_scores.tolist()))

    def name(word):
        h = 0
        for k, b in enumerate(word):
            h += (b + 1) * pow(toxicity.BASE, k, 1 << 64)
        return h % (1 << 64)

    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.predicted} == {i for i in range(0, 400, 8)} | {1002, 1004}
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        tokens = [(m.start(), m.end(), m[0].lower()) for m in __import__("re").finditer(rb"[A-Za-z0-9\x80-\xff]+", text.encode())]
        if len(tokens) > 200:
            continue
        x = [score_of.get(name(w), begin_of.get(name(w[: toxicity.PREFIX]), model.other) if len(w) >= toxicity.PREFIX else model.other) for _, _, w in tokens]
        found, open_ranges = [], [(0, len(x))]
        while open_ranges:  # the best range, then what is left and right of it
            lo, hi = open_ranges.pop()
            best = max(((sum(x[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1) if x[a] > 0 and x[b - 1] > 0), default=(0,))
            if best[0] > 0:
                found.append((best[2], best[3], best[0]))
                open_ranges += [(lo, best[2]), (best[3], hi)]
        cut = model.log_k + np.log(max(len(x), 1))
        normal = {f: model.lam * f[2] - cut for f in found}
        passages = sorted((tokens[a][0], tokens[b - 1][1]) for (a, b, s), v in normal.items() if v > -np.log(toxicity.E_VALUE))
        assert sorted((p.begin, p.end) for p in r.passages) == passages
        top, total = max([0.0, *normal.values()]), sum(v for v in normal.values() if v > -np.log(toxicity.E_VALUE))
        z = np.dot(model.weights, [1.0, np.log1p(top), np.log1p(total)])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6
    assert toxicity.score(docs.limit(0), model).count() == 0
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_class).where("score = 0").count() == len(rows)
