"""Toxicity by maximum-scoring segments.

Tokens (lower-case runs of letters, digits and non-ASCII bytes) get log-odds of toxic against other
labelled text, smoothed with an informative Dirichlet prior: one occurrence and `PRIOR` times the
token's share of all training text, in either class. Tokens whose z-score and log-odds stand out enter the model; a token outside it may be
covered by its first five bytes, scored in the same way; all others share a small negative score. The
linear-time scan of Ruzzo and Tompa finds all maximal segments; a segment's score is normalised by
Karlin-Altschul statistics, lambda * S - ln(K * n), with lambda from the clean token distribution
and K from the maxima of clean training texts. The normalised scores of the best segment and of all
significant ones (expected number below `E_VALUE`) feed a logistic calibration. It is fitted on training
texts too, each scored by a model of the other `FOLDS` - 1 folds, so it sees texts as new ones are seen.

Training uses at most `TRAIN_ROWS` labelled rows, those of least hash of their id; the model has at
most `MODEL_TOKENS` tokens and as many beginnings, so what is broadcast is bounded. Nulls and empty
texts have no segment and get the calibration's value at zero. Rows with a null label don't train.
Without labels of both classes outside each fold every score is 0. Repeated rows are scored each by itself, and
alike; a repeated id trains with all of its texts, and is toxic if one of its labels is. Texts of any length
are scored whole. Of tokens with equal scores in the model's bound those of smaller hash enter. An
empty table gives no rows; columns besides id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, slices, utf8_buffers

TRAIN_ROWS = 30_000
MODEL_TOKENS = 65_536
PREFIX = 5
MIN_Z = 4.0
#: Log-odds that a model token has at least, by one standard error; leaves out what only tells languages or topics apart.
MIN_LIFT = 2.0
PRIOR = 500.0
#: Share of model tokens that a toxic passage is taken to have; sets the score of all other tokens.
PASSAGE_SHARE = 0.1
E_VALUE = 0.05
#: Parts of the training texts, each scored by a model of the others for the calibration.
FOLDS = 4
THRESHOLD = 0.3
BASE = 0x100000001B3
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the beginning, range of bytes and row bounds (rows + 1) of the tokens of the buffers."""
    empty = np.zeros(0, np.uint64)
    inside = WORD[data]
    if not inside.any():
        return empty, empty, np.zeros((0, 2), np.int64), np.zeros(len(offsets), np.int64)
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    new[first] = inside[first]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(new[at])
    ends = np.append(starts[1:], len(at))
    within = np.arange(len(at)) - np.repeat(starts, ends - starts)
    powers = np.multiply.accumulate(np.array([1] + [BASE] * int(within.max()), np.uint64))
    value = (LOWER[data[at]] + np.uint64(1)) * powers[within]
    full = np.add.reduceat(value, starts)
    value[within >= PREFIX] = 0
    begin = np.add.reduceat(value, starts)
    begin[ends - starts < PREFIX] = 0  # shorter tokens have no beginning
    where = np.column_stack([at[starts], at[ends - 1] + 1])
    return full, begin, where, np.searchsorted(where[:, 0], offsets)


@dataclass
class Model:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    token_scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    begin_scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = float(np.log(1 - PASSAGE_SHARE))
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] | None = None

    @staticmethod
    def _find(keys: np.ndarray, scores: np.ndarray, probe: np.ndarray) -> np.ndarray:
        out = np.full(len(probe), np.nan)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = keys[at] == probe
            out[hit] = scores[at[hit]]
        return out

    def scores(self, full: np.ndarray, begin: np.ndarray) -> np.ndarray:
        names, inverse = np.unique(full, return_inverse=True)
        by_name = self._find(self.tokens, self.token_scores, names)[inverse]
        rest = np.isnan(by_name)
        by_name[rest] = self._find(self.begins, self.begin_scores, begin[rest])
        return np.where(np.isnan(by_name), self.other, by_name)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time; only positive scores take a step."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    back: list[int] = []  # for each candidate the nearest earlier one with a smaller sum before it
    for i in np.flatnonzero(scores > 0).tolist():
        b, e, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = back[j]
            if j < 0 or stack[j][3] >= high:
                stack.append((b, e, low, high))
                back.append(j)
                break
            b, low = stack[j][0], stack[j][2]
            del stack[j:], back[j:]
    return [(b, e, high - low) for b, e, low, high in stack]


def segments(model: Model, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]], np.ndarray]]:
    """(row, tokens, maximal segments, range of bytes of each token) for each row of the buffers."""
    full, begin, where, bounds = words(offsets, data)
    scores = model.scores(full, begin)
    for row in range(len(offsets) - 1):
        lo, hi = bounds[row], bounds[row + 1]
        yield row, int(hi - lo), maximal_segments(scores[lo:hi]), where[lo:hi] - offsets[row]


def features(model: Model, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
    """Normalised score of the best segment and the sum over significant ones, both zero at least."""
    cut = model.log_k + np.log(max(n, 1))
    normal = [model.lam * s - cut for _, _, s in found]
    significant = [x for x in normal if x > -np.log(E_VALUE)]
    return max([0.0, *normal]), float(sum(significant))


def _frame(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def karlin_lambda(share: np.ndarray, values: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1."""
    low, high = 1e-6, 1e-6
    while high < 50 and (share * np.exp(np.minimum(high * values, 500))).sum() < 1:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * values, 500))).sum() < 1 else (low, mid)
    return low if low > 1e-5 else 1.0


def models(counts: DataFrame) -> list[Model] | None:
    """Models without each fold, and of all, from `counts` (kind, key, fold, n0, n1); None if one lacks a class."""
    names = [(n, f) for n in ("n0", "n1") for f in range(FOLDS)]
    by_key = cut(counts.groupBy("kind", "key").agg(*[F.sum(F.when(F.col("fold") == f, F.col(n)).otherwise(0)).alias(f"{n}_{f}") for n, f in names]))
    folds = by_key.groupBy("kind").agg(*[F.sum(f"{n}_{f}").alias(f"{n}_{f}") for n, f in names]).collect()  # two rows
    totals = {(m, r["kind"]): tuple(sum(r[f"{n}_{f}"] for f in range(FOLDS) if f != m) for n in ("n0", "n1")) for r in folds for m in range(FOLDS + 1)}
    if not all(min(totals.get((m, 0), (0, 0))) > 0 for m in range(FOLDS + 1)):
        return None
    # the z-score of the log-odds under the Dirichlet prior, for each model; only tokens that enter become rows
    scored = []
    for m in range(FOLDS + 1):
        n0, n1 = (sum((F.col(f"{n}_{f}") for f in range(FOLDS) if f != m), F.lit(0)) for n in ("n0", "n1"))
        t0, t1 = (F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(t[c]))) for (x, k), t in totals.items() if x == m]) for c in (0, 1))
        share = 1 + (n0 + n1) / (t0 + t1) * PRIOR
        odds = F.log((n1 + share) / (t1 + PRIOR - n1 - share)) - F.log((n0 + share) / (t0 + PRIOR - n0 - share))
        spread = F.sqrt(1 / (n0 + share) + 1 / (n1 + share))
        scored.append(F.when((n1 > 0) & (odds >= MIN_Z * spread) & (odds - spread >= MIN_LIFT), F.struct(F.lit(m).alias("model"), n0.alias("n0"), odds.alias("score"), spread.alias("spread"))))
    sure = by_key.select("kind", "key", F.explode(F.array_compact(F.array(*scored))).alias("s")).select("kind", "key", "s.*")
    rank = F.row_number().over(Window.partitionBy("model", "kind").orderBy((F.col("score") / F.col("spread")).desc(), "key"))
    best = sure.withColumn("rank", rank).where(F.col("rank") <= MODEL_TOKENS).toPandas()  # MODEL_TOKENS for each model and kind at most
    best["name"] = best["key"].to_numpy(np.int64).view(np.uint64)
    out = []
    for m in range(FOLDS + 1):
        parts = [best[(best.model == m) & (best.kind == k)].sort_values("name") for k in (0, 1)]
        model = Model(*[x for p in parts for x in (p["name"].to_numpy(np.uint64), p["score"].to_numpy())])
        clean = float(totals[m, 0][0])
        known = np.append(parts[0]["n0"].to_numpy() / clean, max(0.0, 1 - parts[0]["n0"].sum() / clean))
        model.lam = karlin_lambda(known, np.append(model.token_scores, model.other))
        out.append(model)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a constant and the columns of `x`, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the model on `labels` (id_col, label_col of 0 and 1); other columns are never read."""
    ident, flag = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    picked = labels.where(flag.isNotNull() & ident.isNotNull()).groupBy(ident.alias("id")).agg(F.max(flag).cast("int").alias("label"))
    hashed = F.xxhash64("id")
    picked = picked.orderBy(hashed, "id").limit(TRAIN_ROWS).withColumn("fold", F.pmod(F.shiftright(hashed, 7), F.lit(FOLDS)).cast("int"))
    # TRAIN_ROWS bounds what is broadcast
    rows = _frame(docs, id_col, text_col).join(F.broadcast(cut(picked)), "id").select("text", "label", "fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(0))
            label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for lo, hi in slices(offsets):
                full, begin, _, bounds = words(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                toxic, side = (np.repeat(x, np.diff(bounds)) for x in (label[lo:hi] == 1, fold[lo:hi]))
                for kind, key, keep in ((0, full, full == full), (1, begin, begin != 0)):
                    for f in range(FOLDS):
                        some = keep & (side == f)
                        names, inverse = np.unique(key[some], return_inverse=True)
                        n = np.bincount(inverse, minlength=len(names))
                        n1 = np.bincount(inverse, weights=toxic[some], minlength=len(names)).astype(np.int64)
                        fixed = [pa.array(np.full(len(names), v, np.int32)) for v in (kind, f)]
                        yield pa.RecordBatch.from_arrays([fixed[0], pa.array(names.view(np.int64)), fixed[1], pa.array(n - n1), pa.array(n1)], names=["kind", "key", "fold", "n0", "n1"])

    found = models(rows.mapInArrow(count, "kind int, key long, fold int, n0 long, n1 long"))
    if found is None:
        return Model()

    def scan(of, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def each(model: Model, texts: pa.Array) -> list[tuple[float, float]]:
            offsets, data = utf8_buffers(texts)
            return [of(model, some, n) for lo, hi in slices(offsets) for _, n, some, _ in segments(model, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m in range(FOLDS):  # model m has not seen fold m
                    own = batch.filter(pc.equal(batch.column(2), m))
                    out = [x + y for x, y in zip(each(found[m], own.column(0)), each(found[FOLDS], own.column(0)), strict=True)]
                    columns = list(zip(*out, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), *[pa.array(list(c), pa.float64()) for c in columns]], names=names)

        return rows.mapInArrow(run, schema)

    # TRAIN_ROWS rows (more only where ids repeat) of six numbers: first the best segment and the length, by the model without its fold and by that of all
    seen = scan(lambda model, some, n: (max([0.0, *[x for _, _, x in some]]), float(n)), "label int, fold int, top double, n double, top_all double, n_all double").toPandas()
    for m, model in enumerate(found):
        own = seen[(seen.label == 0) & (seen.n > 0) & ((seen.fold == m) | (m == FOLDS))]
        top = own["top_all" if m == FOLDS else "top"].to_numpy()
        if len(own):
            model.log_k = float(np.mean(model.lam * top - np.log(own.n.to_numpy())) - 0.5772156649015329)
    # then the features under those constants
    seen = scan(features, "label int, fold int, best double, total double, best_all double, total_all double").toPandas()
    final = found[FOLDS]
    final.weights = logistic(np.log1p(seen[["best", "total"]].to_numpy()), (seen.label == 1).to_numpy(float))
    return final


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score, predicted, passages array<struct<begin, end, score>>), begin and end in bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(1))
            values, passages = np.zeros(len(batch)), []
            for lo, hi in slices(offsets):
                for row, n, found, where in segments(model, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]):
                    if model.weights is not None:
                        z = np.dot(model.weights, [1.0, *np.log1p(features(model, found, n))])
                        values[lo + row] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    limit = model.log_k + np.log(max(n, 1)) - np.log(E_VALUE)
                    passages.append([{"begin": int(where[b, 0]), "end": int(where[e - 1, 1]), "score": model.lam * s - limit} for b, e, s in found if model.lam * s > limit])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32)), pa.array(passages, kind)], names=["id", "score", "predicted", "passages"])

    picked = _frame(docs, id_col, text_col)
    done = picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, score double, predicted int, passages array<struct<begin:bigint,end:bigint,score:double>>")
    return done.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id's text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
