"""Whitening against eigenvectors of the covariance matrix in plain numpy, and on odd vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest

from skeinflow.llm import whitening
from skeinflow.llm.queries import op11_whitening


def plain(vectors, most=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:most]
    return n, dev, c @ v[:, order] / np.sqrt(np.maximum(e[order], 1e-300)), e[order] / e.sum()


def table(rows, most):
    keys = sorted({r.vec_id for r in rows})
    w = np.full((len(keys), most), np.nan)
    for r in rows:
        w[keys.index(r.vec_id), r.component - 1] = np.nan if r.whitened is None else r.whitened
    return keys, w


def agree(rows, vectors, keys, most):
    n, dev, white, explained = plain([vectors[k] for k in keys], most)
    have, w = table(rows, most)
    assert have == keys and {r.n for r in rows} == {n} and len(rows) == n * most
    assert {(r.vec_id, r.deviation) for r in rows} == set(zip(keys, dev))
    for k in range(most):
        sign = np.sign(w[:, k] @ white[:, k])
        assert np.allclose(w[:, k], sign * white[:, k], atol=1e-6)
    for r in rows:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and abs(error.pop() - np.abs(np.cov(w.T, bias=True) - np.eye(most)).max()) < 1e-9


def test_query(spark):
    d = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    rows = op11_whitening(spark, d).collect()
    agree(rows, vectors, sorted(vectors), 8)
    assert max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize("fan", [1, 4])
def test_many_partitions_and_scales(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN_BITS", fan)
    rng = np.random.default_rng(fan)
    vectors = {i: (rng.normal(size=5) * [1000, 10, 1, 0.1, 30] + [1e6, 0, 0, 5, 0]).tolist() for i in range(400)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<double>").repartition(9)
    agree(whitening.whiten(df, "vec_id", "v", 5).collect(), vectors, sorted(vectors), 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [-inf, 1.0, 1.0]), (105, []), (106, [1.0, 2.0])]
    same = [(None, good[0][1]), (0, good[0][1])]
    df = spark.createDataFrame(good + bad + same, "vec_id long, v array<double>").selectExpr("*", "1 as component", "2 as n", "3 as _key", "4 as `a.b`")
    rows = whitening.whiten(df, "vec_id", "v").collect()
    assert len(rows) == 22 * 3 and {r.n for r in rows} == {22} and {r.vec_id for r in rows} == {None, *range(20)}
    assert len({(r.component, round(r.whitened, 12)) for r in rows if r.vec_id in (None, 0)}) == 3
    assert whitening.whiten(df.limit(0), "vec_id", "v").count() == 0 and whitening.whiten(df.where("vec_id > 99"), "vec_id", "v").count() == 2


def test_no_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, v array<float>")
    rows = whitening.whiten(one, "vec_id", "v").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(rows, key=lambda r: r.component)] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], "vec_id long, v array<float>")
    rows = whitening.whiten(line, "vec_id", "v").collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and max(r.identity_error for r in rows) < 1e-9


def test_entries_beyond_64_bits():
    column = pa.array([[1e300, 1.0], [-1e300, 2.0]], pa.list_(pa.float64()))
    x = whitening.quantized(column, 2)
    assert x[0, 0] == int(1e300 * 1024) + 100_000 and x[0, 1] == 101_024
    sums = tuple(int(v) for v in x.sum(axis=0))
    dev = whitening.deviations(x, 2, sums)
    assert whitening.squares(dev) == [None, None] and whitening.squares(dev[:, 1:]) == [1024**2, 1024**2]
    big = np.array([[1 << 61, 0]], np.int64)
    assert whitening.deviations(big, 8, (0, 0))[0, 0] == 8 << 61
