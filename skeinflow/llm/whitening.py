"""Whitening of embeddings by a tall-skinny QR: no covariance matrix is formed.

1. Exact whole-number sums: an entry c becomes floor(1024 * c) + 100000, tasks add them up, tasks' sums are added as decimals.
2. Each task centres its rows, (n * x - S) / n with an exact numerator, and folds them batch by batch into one R factor: R = qr([R; rows]).
3. R factors merge in a tree, FAN at a time, each level a grouped job, until one is left: d x d, whatever the number of rows.
4. Its SVD gives the right vectors and singular values; the variance along vector k is s_k^2 / n, and a row's whitened entry is its
   projection over the square root of that.

To the driver go sums and one R, whose sizes the dimension bounds. A vector with a null or a non-finite entry, or of another length than
most (ties: the longer), has no row; null ids and repeated rows are rows like any other. Directions without variance
(fewer rows than dimensions, constant entries) have null where a division by it would stand. No usable vector: no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._common import cut

#: R factors merged by one task, as a power of two.
FAN_BITS = 4
SCALE, SHIFT = 1024, 100_000
#: Products of n and an entry up to here are exact in 64 bits, and so are their differences.
EXACT = 1 << 62


@dataclass(frozen=True)
class Fit:
    """n rows, their exact sums, components as columns in falling order of their variances, and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float

    def kept(self, most: int) -> int:
        """So many components, of `most`, have variance beyond rounding."""
        return int((self.variances[:most] > self.variances[0] * 1e-13).sum()) if len(self.variances) and self.variances[0] > 0 else 0


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows whose vectors are whole and of the common length, as `_vector` in doubles; that length)."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = rows.withColumn("_vector", F.col(vector).cast("array<double>")).where(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & F.forall("_vector", lambda x: F.coalesce(entry(x), F.lit(False))))
    common = whole.groupBy(F.size("_vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return whole.where(F.size("_vector") == d), d


def quantized(column: pa.Array, d: int) -> np.ndarray:
    """Entries as whole numbers, a row a vector. Beyond 2^62 they don't fit 64 bits and are Python's integers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= EXACT - SHIFT:
        return np.array([int(v) + SHIFT for v in x.tolist()], object).reshape(-1, d)
    return x.astype(np.int64).reshape(-1, d) + SHIFT


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where that is safe, else in Python's integers."""
    most = max([1, *map(abs, sums)])
    if x.dtype == object or len(x) and int(np.abs(x).max()) * n + most >= EXACT:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows, null beyond 64 bits."""
    top = int(np.abs(dev).max()) if dev.size else 0
    if dev.dtype != object and top * top * dev.shape[1] < EXACT:
        return (dev * dev).sum(axis=1).tolist()
    return [v if (v := sum(int(e) ** 2 for e in r)) < 1 << 63 else None for r in dev]


def _summer(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            x = quantized(b.column("_vector"), d)
            wide = x.dtype == object or len(x) * int(np.abs(x).max(initial=0)) >= EXACT
            n, sums = n + len(x), [a + int(v) for a, v in zip(sums, (x.astype(object) if wide else x).sum(axis=0))] if len(x) else sums
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "total": pa.array([str(s) for s in sums], pa.string())})

    return run


def _factor(d: int, n: int, sums: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            if b.num_rows:
                rows = (deviations(quantized(b.column("_vector"), d), n, sums) / n).astype(np.float64)
                r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"id": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _merge(d: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        r = np.zeros((0, d))
        for x in table.column("r"):
            r = np.linalg.qr(np.vstack([r, np.frombuffer(x.as_py()).reshape(-1, d)]), mode="r")
        return pa.table({"id": pa.array([table.column("id")[0].as_py() >> FAN_BITS], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def fit(rows: DataFrame, d: int) -> Fit | None:
    """The fit over all rows of `usable`, None where there is none."""
    ship(rows.sparkSession)
    only = rows.select("_vector")
    # a total is written in decimals and added up as such; 38 digits hold 10^18 rows of 64-bit entries
    sums = only.mapInArrow(_summer(d), "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    if not sums:
        return None
    n, exact = sums[0]["n"], tuple(int(r["s"]) for r in sums)
    factors = cut(only.mapInArrow(_factor(d, n, exact), "id long, r binary"))
    top = factors.agg(F.max("id")).first()[0]
    while top:
        factors = cut(factors.groupBy(F.shiftright("id", FAN_BITS).alias("_group")).applyInArrow(_merge(d), "id long, r binary"))
        top >>= FAN_BITS
    r = np.frombuffer(factors.first()["r"]).reshape(-1, d)
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    variances = np.zeros(d)
    variances[: len(s)] = s**2 / n
    signs = np.sign(vt[np.arange(d), np.abs(vt).argmax(axis=1)])
    return Fit(n, exact, (vt * signs[:, None]).T.copy(), variances, float(variances.sum()))


def _whitener(f: Fit, most: int) -> Callable[[pa.Array], tuple[list, np.ndarray]]:
    """(deviations, whitened entries a row) of vectors; entries of directions without variance are NaN."""
    d, kept = len(f.sums), f.kept(most)
    scale = np.full(min(most, d), np.nan)
    scale[:kept] = 1 / np.sqrt(f.variances[:kept])

    def run(column: pa.Array) -> tuple[list, np.ndarray]:
        dev = deviations(quantized(column, d), f.n, f.sums)
        return squares(dev), (dev / f.n).astype(np.float64) @ f.components[:, : len(scale)] * scale

    return run


def identity_error(rows: DataFrame, f: Fit, most: int = 8) -> float:
    """How far the whitened rows' covariance is from the identity, at most, over the components that have variance."""
    kept, white = f.kept(most), _whitener(f, most)
    if not kept:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for b in batches:
            if b.num_rows:
                w = white(b.column("_vector"))[1][:, :kept]
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel())})

    sums = rows.select("_vector").mapInArrow(moments, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()
    m = np.array([r["v"] for r in sums]).reshape(kept + 1, kept) / f.n
    return float(np.abs(m[:kept] - np.outer(m[kept], m[kept]) - np.eye(kept)).max())


def whiten(rows: DataFrame, key: str, vector: str, most: int = 8) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error), one for each usable vector and component up to `most`."""
    good, d = usable(rows, vector)
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    f = fit(good, d) if d else None
    if f is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, white, m = identity_error(good, f, most), _whitener(f, most), min(most, d)
    explained = (f.variances[:m] / f.total).tolist() if f.total > 0 else [None] * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            dev, w = white(b.column("_vector"))
            w, at = w.ravel(), pa.array(np.repeat(np.arange(k), m))
            columns = [b.column("_key").take(at), pa.array(list(range(1, m + 1)) * k, pa.int32()), pa.array([f.n] * (k * m), pa.int64()), pa.array(dev, pa.int64()).take(at), pa.array(w, mask=np.isnan(w)), pa.array(explained * k, pa.float64()), pa.array([error] * (k * m))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.select(F.col(key).alias("_key"), "_vector").mapInArrow(run, schema)
