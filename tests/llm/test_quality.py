"""The Kneser-Ney model against a plain version over dictionaries, and the judgement on odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from skeinflow.llm import quality


def brute_bits(train, text):
    """Bits of each character of `text` by interpolated modified Kneser-Ney of order four."""
    counts = [None] * 5
    counts[4] = Counter()
    for t in train:
        padded = "\0\0\0" + t
        counts[4].update(padded[i : i + 4] for i in range(len(t)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, totals, kinds = {}, {}, {}
    for k in (1, 2, 3, 4):
        n1, n2, n3, n4 = (max(1, sum(v == x for v in counts[k].values())) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount[k] = [min(max(j - (j + 1) * y * b / a, 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        totals[k], kinds[k] = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, v in counts[k].items():
            totals[k][g[:-1]] += v
            kinds[k][g[:-1]][min(v, 3) - 1] += 1

    def p(gram):
        if not gram:
            return quality.FLOOR
        k, context = len(gram), gram[:-1]
        low = p(gram[1:])
        if context not in totals[k]:
            return low
        n, t = counts[k][gram], totals[k][context]
        taken = discount[k][min(n, 3) - 1] if n else 0
        return (n - taken) / t + sum(a * b for a, b in zip(discount[k], kinds[k][context])) / t * low

    padded = "\0\0\0" + text
    return sum(-math.log2(p(padded[i : i + 4])) for i in range(len(text)))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdeéжя漢字😀"), rng.integers(1, 6))) for _ in range(30)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, make(int(rng.integers(1, 30))), "en" if i % 2 else "fr") for i in range(120)]
    rows += [(200, "zq!7 xx9 ## 0 0 0 @@ 1 2 3 " * 20, "en"), (201, None, "en"), (202, "", None), (203, "éa", "zz"), (203, "éa", "zz"), (204, "漢", "fr"), (None, make(9), "en")]
    return rows, [(i, 1) for i in range(100)] + [(200, 0), (None, 1), (201, 1), (7, None)]


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_against_brute_force(spark, monkeypatch, corpus, limit):
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", limit)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "2 as code", "3 as block", "4 as `a.b`", "5 as bits_sum", "6 as threshold", "'x' as _lang")
    marks = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "9 as id")
    judged, names = quality.judge(docs, marks)
    got = judged.collect()
    assert len(got) == len(rows)
    held = {r[0] for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) = 0 as h").where("h").collect()}
    good = {i for i, q in labels if q == 1 and i is not None}
    text_of = [(i, t or "") for i, t, _ in rows if i in good]
    outside = [brute_bits([t for i, t in text_of if i not in held], t) / 1 for i, t in text_of if i in held and t]
    mean = sum(outside) / sum(len(t) for i, t in text_of if i in held and t)
    everything = [t for _, t in text_of]
    for r in got:
        t = r.text or ""
        want = (brute_bits(everything, t) + quality.PRIOR_SYMBOLS * mean) / (len(t) + quality.PRIOR_SYMBOLS)
        assert r[names["n_symbols"]] == len(t)
        assert math.isclose(r[names["bits_per_symbol"]], want, rel_tol=1e-4)
        assert (r.id, r.code, r.block, r["a.b"], r.threshold) == (1, 2, 3, 4, 6)
    kept = {r.doc_id for r in quality.keep_good(docs, marks).collect()}
    assert 200 not in kept and {201, 202, 203, 204, None} <= kept and quality.keep_good(docs, marks).columns == docs.columns


def test_thresholds_by_language_come_from_held_out_texts(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "MIN_TEXTS", 5)
    rows, labels = corpus
    judged, names = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    limits = {r.lang: r[names["threshold"]] for r in judged.collect()}
    assert limits["en"] != limits["fr"] and limits["zz"] == limits[None] not in (limits["en"], limits["fr"])


def test_nothing_to_learn_from(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.keep_good(docs, marks.limit(0)).count() == len(rows)
    assert quality.keep_good(docs.limit(0), marks).count() == 0
    one = marks.where("doc_id = 5")
    assert quality.keep_good(docs, one).count() == len(rows)
