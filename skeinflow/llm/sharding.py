"""A uniform shuffle of stored rows into shards of exact sizes, by a hypergeometric communication matrix.

1. Blocks are runs of 2^BLOCK_BITS rows of a file, told apart by file and row number, so neither the number of executors nor
   a lost one changes them. Their sizes are counted without reading a column.
2. The matrix says how many rows of a block go to each shard. Given the sizes of blocks and shards, a uniform
   permutation has multivariate hypergeometric counts. They are drawn down a tree over the blocks' names: a node deals its shards' places to
   its children, so one task draws for about FAN children and no task sees the whole matrix.
3. Each block permutes its row of the matrix over its rows, which names each row's shard.
4. Rows are exchanged once, to (shard, part), and permuted again there by their random numbers; slots are places in a part plus the rows
   of the parts before, a running sum. Parts hold about PART_BYTES, so a shard of any size is many tasks'.

Shard sizes differ by one row at most, every assignment with such sizes is equally likely, and the seed fixes it. Equal texts are rows like
any other, no group stays together. Null ids and texts, empty and very long texts and repeated rows are dealt alike; an empty table gives no
row. Columns of the input named shard or slot give way to the new ones.

`docs` must be read from files, for their rows' numbers. A DataFrame without them, or in which a file's rows are missing or repeated (a
filter, a join), is written to the shared folder first.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._common import cut, shared_folder
from .running import running

#: Rows of a block, as a power of two; children of a tree's node, as another.
BLOCK_BITS, FAN_BITS = 17, 8
#: Bytes of a part of a shard, before compression, and of the largest matrix that is broadcast; a larger one is joined by a shuffle.
PART_BYTES, MATRIX_BYTES = 4 << 20, 64 << 20
SEED = 20_240_613
BLOCK, ROW = "__block", "__row"


def _placed(docs: DataFrame) -> DataFrame:
    """`docs` with its rows' blocks and numbers."""
    at = F.col("_metadata.row_index")
    return docs.select("*", F.xxhash64(F.col("_metadata.file_path"), F.shiftright(at, BLOCK_BITS)).alias(BLOCK), at.alias(ROW))


def _counted(placed: DataFrame, sizes: Column) -> DataFrame:
    number, some = F.col(ROW), F.count("*")
    whole = (F.max(number) - F.min(number) + 1 == some) & (F.sum(number) * 2 == (F.min(number) + F.max(number)) * some)
    return placed.groupBy(BLOCK).agg(some.alias("n"), F.min(number).alias("first"), F.sum(sizes).alias("bytes"), whole.alias("whole"))


def _stored(docs: DataFrame) -> DataFrame:
    folder = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    docs.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def deal(rng: np.random.Generator, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of counts, one for each size: how many of its members get which places, uniformly, all places being taken."""
    left, out = places.astype(np.int64).copy(), np.zeros((len(sizes), len(places)), np.int64)
    for k, n in enumerate(sizes.tolist()):
        out[k] = _hypergeometric(rng, left, n)
        left -= out[k]
    return out


def _hypergeometric(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw. numpy's sampler takes populations below a billion; beyond, shards take their turns one by one."""
    if places.sum() < 10**9:
        return rng.multivariate_hypergeometric(places, n, method="marginals")
    out, total, left = np.zeros(len(places), np.int64), int(places.sum()), n
    for k, m in enumerate(places.tolist()):
        out[k] = _binary_hypergeometric(rng, m, total - m, left)
        total, left = total - m, left - int(out[k])
    return out


def _binary_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good, for any sizes: by the beta law of the middle order statistic of the good ones."""
    if n > good + bad - n:
        return good - _binary_hypergeometric(rng, good, bad, good + bad - n)
    if good > bad:
        return n - _binary_hypergeometric(rng, bad, good, n)
    low = 0
    while good and n and good + bad >= 10**9:
        # the place of the middle good one in a uniform order: bad ones before it follow a beta-binomial law
        mid = (good + 1) // 2
        before = int(rng.binomial(bad, rng.beta(mid, good + 1 - mid)))
        if mid + before <= n:  # it is among the first n, and so are those before it
            low, n, good, bad = low + mid, n - mid - before, good - mid, bad - before
        else:
            good, bad = mid - 1, before
    return low + (int(rng.hypergeometric(good, bad, n)) if good and n else 0)


def matrix(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (block, first, counts) of the communication matrix: counts[s] of the block's rows go to shard s.

    `blocks` (block, n, first) has unique 64-bit names that are spread evenly. Shard s holds n // shards rows, and one more if s < n % shards.
    """
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    depth = 0
    while n_blocks >> (FAN_BITS * (depth + 1)):
        depth += 1
    node = lambda level: F.shiftrightunsigned(BLOCK, 64 - FAN_BITS * level) if level else F.lit(0).cast("long")
    places = [total // shards + (s < total % shards) for s in range(shards)]
    above = blocks.sparkSession.createDataFrame([(0, places)], "node long, places array<long>") if total else None
    if above is None:
        return blocks.select(BLOCK, "first", F.array().cast("array<long>").alias("counts"))
    for level in range(1, depth + 2):
        last = level == depth + 1
        child = F.col(BLOCK) if last else node(level)
        sizes = blocks.groupBy(node(level - 1).alias("node"), child.alias("child")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        dealt = sizes.join(above.hint("merge"), "node").groupBy("node").applyInArrow(_dealer(seed, level), "child long, first long, counts array<long>")
        above = cut(dealt.select(F.col("child").alias("node"), F.col("counts").alias("places"))) if not last else dealt
    return above.select(F.col("child").alias(BLOCK), "first", "counts")


def _dealer(seed: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("child")
        node, places = table.column("node")[0].as_py(), np.array(table.column("places")[0].as_py(), np.int64)
        counts = deal(np.random.default_rng([seed, 1, level, node & (2**64 - 1)]), places, table.column("n").to_numpy())
        return pa.table({"child": table.column("child"), "first": table.column("first"), "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    return run


@functools.lru_cache(maxsize=4)
def permuted(seed: int, block: int, counts: tuple[int, ...]) -> np.ndarray:
    """The shards of a block's rows: each as often as the matrix says, in an order of the block's own."""
    return np.random.default_rng([seed, 2, block & (2**64 - 1)]).permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))


def _shard_of(seed: int) -> Callable:
    @F.pandas_udf("int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for block, row, first, counts in parts:
            names, out = block.to_numpy(), np.empty(len(block), np.int32)
            at = (row - first).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts, [*cuts[1:], len(names)]):
                out[lo:hi] = permuted(seed, int(names[lo]), tuple(int(c) for c in counts.iloc[lo]))[at[lo:hi]]
            yield pd.Series(out)

    return run


def shards(docs: DataFrame, n_shards: int, text: str = "text", seed: int = SEED) -> DataFrame:
    """`docs` with `shard` (0 to n_shards - 1) and `slot` (0, 1, ... in each shard), in a uniformly random order."""
    spark = docs.sparkSession
    ship(spark)
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 8
    try:
        placed = _placed(docs)
        blocks = cut(_counted(placed, size))
        whole = blocks.agg(F.bool_and("whole")).first()[0] is not False
    except AnalysisException:
        whole = False
    if not whole:
        docs = _stored(docs)
        placed = _placed(docs)
        blocks = cut(_counted(placed, size))
    n_blocks, n_bytes = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    counts = cut(matrix(blocks, n_shards, seed)).toDF(BLOCK, "__first", "__counts")
    counts = F.broadcast(counts) if n_blocks * (8 * n_shards + 64) <= MATRIX_BYTES else counts.hint("merge")
    bits = max(0, int(n_bytes // (n_shards * PART_BYTES))).bit_length()
    order = F.xxhash64(F.col(BLOCK), F.col(ROW), F.lit(seed))
    part = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = placed.join(counts, BLOCK).withColumn("__shard", _shard_of(seed)(BLOCK, ROW, "__first", "__counts")).withColumn("__order", order).withColumn("__part", part)
    parts = cut(dealt.groupBy("__shard", "__part").agg(F.count("*").alias("n")))
    before = running(parts, ["__shard"], "__part", "n", "sum", (0, (1 << bits) - 1)).select("__shard", "__part", "running_n")
    place = F.row_number().over(Window.partitionBy("__shard", "__part").orderBy("__order", BLOCK, ROW))
    done = dealt.select(*[F.col(f"`{c}`") for c in columns], BLOCK, ROW, "__shard", "__part", "__order").withColumn("__place", place)
    done = done.join(before.hint("merge"), ["__shard", "__part"])
    return done.select(*[F.col(f"`{c}`") for c in columns], F.col("__shard").alias("shard"), (F.col("running_n") + F.col("__place") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, n_shards: int, path: str, text: str = "text", seed: int = SEED) -> None:
    """The shuffled rows as Parquet files, a folder a shard; a shard's files hold runs of slots, in order."""
    done = shards(docs, n_shards, text, seed)
    done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard's rows in the order of their slots."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot")
