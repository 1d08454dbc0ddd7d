"""Shared helpers: Arrow text buffers as numpy arrays, lineage cuts, and whole-number hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, ship

#: Bytes of text that one numpy step works on; a single longer document is taken whole.
SLICE_BYTES = 1 << 20
#: Edges of a graph up to which its nodes' minima (two short structs) are broadcast.
BROADCAST_EDGES = 500_000


def tidy(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f of one group or of two, and then what it has freed is given back. Spark tells the kinds apart by their arguments."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    return one if f.__code__.co_argcount == 1 else two


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Only where spark.checkpoint.dir is unset and all runs on one machine (tests, a laptop) its own folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinflow-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) that hold about `limit` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def per_row_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:ends[i]] by a running total; empty ranges give zero."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


def min_label_components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star on DataFrames: the smallest neighbour is found with a
    partially aggregated minimum and joined back, so a node with very many neighbours is never
    gathered in one task: few minima are broadcast, and of more adaptive execution can split the join. Each
    round is checkpointed. Nodes without an edge do not appear; self-edges and repeated edges do no harm.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def few(low: DataFrame) -> DataFrame:
        return F.broadcast(low) if seen[0] <= BROADCAST_EDGES else low  # not more minima than edges

    seen = mark(e)
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(few(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = mark(e)
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
