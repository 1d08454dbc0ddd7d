"""The toxicity model's fit against plain code: odds and entry, lambda, K and the calibration."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skeinflow.llm import toxicity as t


def tokens(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", raw)


def name(word):
    out = 0
    for k, b in enumerate(word):
        out += (b + 1) * pow(t.BASE, k, 1 << 64)
    return out % (1 << 64)


def fitted(rows):
    """(odds of entering tokens, of beginnings, lambda, score function) of rows (text, label)."""
    odds, clean = [], 0
    for kind in (0, 1):
        counts = (Counter(), Counter())
        for text, label in rows:
            counts[label].update(w[: t.PREFIX] if kind else w for w in tokens(text) if not kind or len(w) >= t.PREFIX)
        t0, t1 = (sum(c.values()) for c in counts)
        entered = {}
        for w in counts[1]:
            n0, n1 = counts[0][w], counts[1][w]
            a = 1 + t.PRIOR * (n0 + n1) / (t0 + t1)
            value = np.log((n1 + a) / (t1 + t.PRIOR - n1 - a)) - np.log((n0 + a) / (t0 + t.PRIOR - n0 - a))
            error = (1 / (n0 + a) + 1 / (n1 + a)) ** 0.5
            if value / error >= t.MIN_Z and value - error >= t.MIN_LIFT:
                entered[w] = (value, n0)
        odds.append(entered)
        clean = clean or t0
    other = np.log(1 - t.PASSAGE_SHARE)
    shares = [(n0 / clean, v) for v, n0 in odds[0].values()]
    shares.append((1 - sum(s for s, _ in shares), other))
    grid = lambda x: sum(s * np.exp(x * v) for s, v in shares) - 1
    low, high = 1e-4, 1.0
    while grid(high) < 0:
        high *= 2
        if high > 50:
            break
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if grid(mid) < 0 else (low, mid)

    def scores(text):
        return np.array([odds[0][w][0] if w in odds[0] else odds[1][w[: t.PREFIX]][0] if len(w) >= t.PREFIX and w[: t.PREFIX] in odds[1] else other for w in tokens(text)])

    return odds, low, scores


def best(values):
    """The greatest sum of neighbours, zero at least."""
    top = now = 0.0
    for v in values:
        now = max(0.0, now + v)
        top = max(top, now)
    return top


def test_training_against_plain_code(spark):
    rng = random.Random(3)
    common = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(40)]
    bad = ["Vilename", "vilenames", "scumbag", "trashy", "vilest"]
    rows = []
    for i in range(320):
        words, label = rng.choices(common, k=rng.randrange(5, 60)), int(i % 4 == 0)
        if label and i % 20:  # some toxic texts have no toxic word
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=rng.randrange(1, 9))
        elif i % 31 == 0:  # and some clean ones have one
            words.append(rng.choice(bad))
        rows.append((i, " ".join(words), label))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(t.FOLDS)).alias("f")).collect()}
    model = t.train(docs, labels)

    models = [fitted([(x, y) for i, x, y in rows if fold[i] != m]) for m in range(t.FOLDS + 1)]
    (words, begins), lam, _ = models[t.FOLDS]
    assert words and begins and set(words) != set(begins)
    for keys, values, want in ((model.tokens, model.token_scores, words), (model.begins, model.begin_scores, begins)):
        assert dict(zip(keys.tolist(), np.round(values, 9).tolist())) == {name(w): round(float(v), 9) for w, (v, _) in want.items()}
    assert abs(model.lam - lam) < 1e-6

    log_k = []
    for m, (_, lam, scores) in enumerate(models):
        own = [(lam * best(scores(x)), len(tokens(x))) for i, x, y in rows if not y and m in (fold[i], t.FOLDS)]
        log_k.append(np.mean([s - np.log(n) for s, n in own]) - 0.5772156649015329)
    assert abs(model.log_k - log_k[t.FOLDS]) < 1e-6

    x = []
    for i, text, _ in rows:
        _, lam, scores = models[fold[i]]
        normal = [lam * s - log_k[fold[i]] - np.log(len(tokens(text))) for _, _, s in t.maximal_segments(scores(text))]
        x.append((max([0.0, *normal]), sum(v for v in normal if v > -np.log(t.E_VALUE))))
    x, y = np.column_stack([np.ones(len(rows)), np.log1p(np.array(x))]), np.array([r[2] for r in rows], float)
    w = np.array(model.weights)
    p = 1 / (1 + np.exp(-x @ w))
    # at the best weights the gradient, with the ridge, is zero
    assert np.abs(x.T @ (y - p) - np.array([1e-6, 1e-2, 1e-2]) * w).max() < 1e-4
    assert 0 < (p[y == 1] > 0.3).mean() and (p[y == 0] < 0.3).mean() > 0.9
