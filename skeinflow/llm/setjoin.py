"""Similarity join of texts as sets of word shingles: candidates by MinHash bands, clusters verified whole and exactly.

1. Every text gives its fingerprint, its set's name (64 bits), `BANDS` keys of `ROWS` MinHashes each, and 8 bits of
   each MinHash. Two sets of similarity s share a key with a probability of 1 - (1 - s^ROWS)^BANDS: 0.99995 at 0.8.
2. Sets that share a key are joined to the least set of that key; so are sets of linked fingerprints whose
   MinHashes agree nearly enough. Buckets are aggregated, never gathered, so their size doesn't matter. The
   components of these edges are clusters.
3. Each member's set goes once to its cluster's task. There a prefix filter finds the pairs: two sets of
   similarity s share a shingle among the first n - ceil(s * n) + 1 of each (n its size), whatever the one
   order of all shingles is; here it goes from rare to frequent in the cluster. All these pairs are verified
   exactly, except where links already connect them. A cluster of over `CLUSTER_BYTES` is cut in blocks, and each
   pair of blocks is a task of its own.

No bucket or cluster is capped, and within a cluster nothing is estimated: its links connect all that pairs
of the similarity connect. Sets are told apart by 64-bit hashes. Null and empty texts have the empty
set, whose rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, min_label_components, release, shuffle_partitions, slices, utf8_buffers
from .simhash import SEED, bucket_links, fingerprints, shingle_hashes, small

#: MinHash bands and the rows of each.
BANDS, ROWS = 25, 5
#: How far the share of equal MinHashes may lie below the similarity: over four standard deviations.
SLACK = 0.17
#: Bytes of shingle sets that one task compares.
CLUSTER_BYTES = 16 << 20


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of the rarest of n shingles a similar set can't all lack."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def distinct_shingles(n_rows: int, hashed: tuple) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    some, n_shingles, row_start, hashes = hashed
    sets = [np.zeros(0, np.uint64)] * n_rows
    for row, a, m in zip(some.tolist(), row_start.tolist(), n_shingles.tolist(), strict=True):
        sets[row] = np.unique(hashes[a : a + m])
    return sets


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)


def sketches(n_rows: int, hashed: tuple) -> tuple[pa.Array, list[bytes | None]]:
    """Band keys (array<long>) and 8 bits of each MinHash of the rows; null for rows without a shingle."""
    some, _, row_start, hashes = hashed
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    draw = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
    low = np.empty((len(some), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS if len(some) else 0):
        mixed = folded * (draw[0, k] | np.uint32(1)) + draw[1, k]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        low[:, k] = np.minimum.reduceat(mixed, row_start)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), 1))
    for r in range(ROWS):
        key = (key ^ low[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    ends = np.zeros(n_rows + 1, np.int32)
    ends[some + 1] = BANDS
    small: list[bytes | None] = [None] * n_rows
    for row, x in zip(some.tolist(), ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8), strict=True):
        small[row] = x.tobytes()
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(key.ravel().view(np.int64))), small


def sketch_frame(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, fp, set_id, bands array<long>, sketch) of `docs` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                own, text = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                hashed = shingle_hashes(own, text, width)
                fps, names = fingerprints(own, text, width, hashed).view(np.int64), set_ids(distinct_shingles(hi - lo, hashed))
                bands, small = sketches(hi - lo, hashed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fps), pa.array(names), bands, pa.array(small, pa.binary())], names=["id", "fp", "set_id", "bands", "sketch"])
        release()

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, fp long, set_id long, bands array<long>, sketch binary")


def band_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from each set of `rows` (set_id, bands) to the least set of each of its keys."""
    entries = rows.select("set_id", F.explode("bands").alias("key"))
    shared = cut(entries.groupBy("key").agg(F.min("set_id").alias("a"), F.max("set_id").alias("last")).where("a < last").select("key", "a"))
    return entries.join(small(shared), "key").select("a", F.col("set_id").alias("b")).where("a <> b").distinct()


def likely(edges: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those `edges` (a, b) between sets whose MinHashes in `rows` (set_id, sketch) agree in the similarity less `SLACK`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (2, 3))
            good = (x == y).mean(axis=1) >= similarity - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    edges = cut(edges.distinct())
    ends = cut(edges.select(F.col("a").alias("set_id")).unionByName(edges.select(F.col("b").alias("set_id"))).distinct())
    have = cut(rows.where("sketch is not null").join(small(ends), "set_id", "left_semi").groupBy("set_id").agg(F.min("sketch").alias("sketch")))
    left = edges.join(have.select(F.col("set_id").alias("a"), F.col("sketch").alias("x")), "a")
    both = left.join(have.select(F.col("set_id").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows (set_id, fp, shingles) of `texts` (text): the sorted distinct shingle hashes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(0))
            for lo, hi in slices(offsets):
                own, text = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                hashed = shingle_hashes(own, text, width)
                sets = distinct_shingles(hi - lo, hashed)
                fps = fingerprints(own, text, width, hashed).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets)), pa.array(fps), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set_id", "fp", "shingles"])
        release()

    return texts.select("text").mapInArrow(run, "set_id long, fp long, shingles binary")


def connect(sets: list[np.ndarray], fps: np.ndarray, block: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all of `sets` (distinct, none empty) that pairs of the similarity connect.

    Where `block` has two values, only pairs of sets of different blocks are compared.
    """
    share = similarity / (1 + similarity)
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, fps, block = [sets[i] for i in order], fps[order], block[order]
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(sets)), size)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    two, label, links = len(np.unique(block)) > 1, np.arange(len(sets)), []

    def join(k: int, near: np.ndarray) -> None:
        joined, first = np.unique(label[near], return_index=True)
        links.extend((int(order[k]), int(order[x])) for x in near[first])
        label[np.isin(label, joined)] = label[k]

    def similar(k: int, others: np.ndarray) -> np.ndarray:
        n = size[others]
        where = np.repeat(start[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own[at[start[k] : start[k] + size[k]]] = True
        common = np.add.reduceat(own[at[where]], np.cumsum(n) - n, dtype=np.int32)
        own[at[start[k] : start[k] + size[k]]] = False
        return others[common >= share * (n + size[k]) - 1e-6]

    own = np.zeros(len(values), bool)
    # linked fingerprints first: they connect most at the least cost
    names, least, same = np.unique(fps, return_index=True, return_inverse=True)
    first_of = [(int(least[g]), k) for k, g in enumerate(same.tolist()) if k != least[g]]
    for a, b in first_of + [(int(least[a]), int(least[b])) for a, b in bucket_links(names)]:
        if label[a] != label[b] and (not two or block[a] != block[b]):
            join(a, similar(a, np.array([b])))
    # the rarest shingles of each set, by the cluster's own counts
    rare = np.lexsort((at, count[at], owner))
    within = np.arange(len(rare)) - start[owner]
    keep = within < prefix_size(size, similarity)[owner]
    token, member = at[rare[keep]], owner[keep]
    by_token = np.argsort(token, kind="stable")
    index, edge = member[by_token], np.searchsorted(token[by_token], np.arange(len(values) + 1))
    first = np.searchsorted(member, np.arange(len(sets) + 1))
    for k in range(len(sets)):
        mine = token[first[k] : first[k + 1]]
        mine = mine[edge[mine + 1] - edge[mine] > 1]
        if not len(mine):
            continue
        others = np.unique(np.concatenate([index[edge[t] : edge[t + 1]] for t in mine]))
        others = others[(others > k) & (label[others] != label[k]) & (similarity * size[others] <= size[k] + 1e-6)]
        if two:
            others = others[block[others] != block[k]]
        if len(others):
            join(k, similar(k, others))
    return links


def links(docs: DataFrame, rows: DataFrame, edges: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (a, b): verified links between sets, which connect all that pairs of the similarity connect in a cluster.

    `rows` is `sketch_frame` of `docs` (id, text); `edges` (a, b) between sets are further candidates.
    """
    some = rows.where(F.size("bands") > 0)
    clusters = min_label_components(likely(edges, some, similarity).unionByName(band_edges(some)))
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root")).distinct()
    members = some.join(small(cut(clusters)), F.col("set_id") == F.col("node"))
    named = cut(members.groupBy("set_id", "root").agg(F.min("id").alias("low")))
    lows = small(cut(named.where("low is not null").select(F.col("low").alias("id")).distinct()))
    # a set that only null ids have is found among their texts
    texts = docs.join(lows, "id", "left_semi").select("text").unionByName(docs.where("id is null").select("text"))
    sets = cut(shingle_sets(texts, width).join(small(named.select("set_id", "root")), "set_id").dropDuplicates(["set_id"]))
    sizes = sets.groupBy("root").agg(F.sum(F.octet_length("shingles")).alias("bytes")).where(F.col("bytes") > CLUSTER_BYTES)
    blocks = cut(sizes.select("root", F.ceil(F.col("bytes") / (CLUSTER_BYTES // 2)).alias("blocks")))
    dealt = sets.join(small(blocks), "root", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("set_id"), "blocks"), F.lit(0).cast("long")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.shiftleft(F.least("block", j), 32) + F.greatest("block", j))
    pair = F.when(F.col("blocks") > 1, every).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.select("root", F.explode(pair).alias("pair"), "block", "set_id", "fp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            block, ids, fps, sets = zip(*held, strict=True)
            found = np.array(connect([np.frombuffer(x, "<u8") for x in sets], np.array(fps, np.int64).view(np.uint64), np.array(block), similarity), np.int64).reshape(-1, 2)
            names = np.array(ids, np.int64)[found]
            return pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1])], names=["a", "b"])

        for batch in batches:
            for root, pair, *row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (root, pair) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = (root, pair), []
                held.append(row)
        if len(held) > 1:
            yield close()
        release()

    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "root", "pair").sortWithinPartitions("root", "pair", "set_id")
    return cut(dealt.mapInArrow(run, "a long, b long"))
