"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint has 64 bits, one per bit of the XXH64 (seed 42) of a document's word shingles: 1 if
set in over half of them. Two fingerprints link at `max_bits` (2) or fewer differing bits.

Search. The fingerprint is cut in three segments of 22, 21 and 21 bits. Two errors leave one
segment clean, and of the other two one has an error at most (pigeonhole). A segment, padded to
23 bits, decodes to the nearest codeword of the perfect [23, 12] Golay code; a word and its 23
one-bit neighbours decode to one to six codewords, and words at distance two or less always share
one of them. A key is therefore (which segment is clean, which is near, the clean bits, a codeword
index), several per fingerprint. Keys join equal fingerprints once (copies were collapsed before),
and each bucket is verified exactly. A bucket of up to 65 fingerprints compares them directly; a
larger one groups them by their 65 one-bit balls, which meet exactly if two bits or fewer differ,
so the work stays linear and no bucket is capped.

Similarity. Two bits hold only the closest copies, and texts with very frequent lines that are no copies:
at a Jaccard similarity of 0.8 about ten bits of 64 differ, which no segment keys find selectively. With
`similarity`, links are those of that Jaccard similarity and no others. Fingerprints that link bring their
texts together as before, and `setjoin` adds those that share a band of MinHashes; what came together is
verified whole on the sets of shingles, those of linked fingerprints first.

Nulls and empty texts have no shingle: fingerprint zero, linked like any other. Texts shorter than
the shingle width give one shingle of all their words. Repeated rows keep their own rows; rows of one id
with different texts are linked each by its own text. Null ids are larger than all others: a component of
null ids only has a null component_id. An empty table gives no rows. Other columns of any name are
neither read nor returned by `simhash_components`; `keep_one` returns all of them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, min_label_components, release, slices, utf8_buffers

SEED = 42
#: Rows (of three numbers at most) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bit positions (from the lowest) and widths of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLY = 0b110001110101
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have shingles, how many each, where they start, and the hashes of all."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, np.zeros(0, np.uint64)
    word = ~SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = word & ~before
    dest = np.cumsum(word.astype(np.int32) + starts, dtype=np.int64) - 1
    norm = np.full(int(dest[-1]) + 1 if len(dest) else 0, 32, np.uint8)
    norm[dest[word]] = LOWER[data[word]]
    at = np.flatnonzero(starts)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    begin = dest[at]
    # a word ends before the space in front of the next one, or at the end
    end = np.append(begin[1:] - 1, len(norm))
    lo = np.searchsorted(at, offsets[:-1])
    hi = np.searchsorted(at, offsets[1:])
    n_words = hi - lo
    some = np.flatnonzero(n_words)
    n_shingles = np.maximum(n_words[some] - width + 1, 1)
    row_start = np.cumsum(n_shingles) - n_shingles
    first_word = np.repeat(lo[some] - row_start, n_shingles) + np.arange(n_shingles.sum())
    last_word = first_word + np.repeat(np.minimum(n_words[some], width), n_shingles) - 1
    text, digest = norm.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(begin[first_word].tolist(), end[last_word].tolist(), strict=True)), np.uint64, len(first_word))
    return some, n_shingles, row_start, hashes


def fingerprints(offsets: np.ndarray, data: np.ndarray, width: int = 3, hashed: tuple | None = None) -> np.ndarray:
    """One uint64 fingerprint per row of the buffers."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    some, n_shingles, row_start, hashes = hashed or shingle_hashes(offsets, data, width)
    if not len(some):
        return out
    value = np.zeros(len(some), np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        bits = np.unpackbits(by_byte[:, k : k + 1], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, row_start, axis=0, dtype=np.int32)
        value |= np.packbits(2 * ones > n_shingles[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    out[some] = value
    return out


def fingerprint_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id_col, fp long); the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(1))
            found = [fingerprints(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], width) for lo, hi in slices(offsets)]
            fps = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])
        release()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, fp long").withColumnRenamed("id", id_col)


def golay_table() -> np.ndarray:
    """Index (12 bits) of the nearest codeword for each of the 2^23 words."""
    words = np.arange(1 << 23, dtype=np.uint32)
    syndrome = words.copy()
    for bit in range(22, 10, -1):
        syndrome ^= ((syndrome >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY_POLY << (bit - 11))
    errors = [0] + [1 << a for a in range(23)]
    errors += [(1 << a) | (1 << b) for a in range(23) for b in range(a)]
    errors += [(1 << a) | (1 << b) | (1 << c) for a in range(23) for b in range(a) for c in range(b)]
    error = np.zeros(1 << 11, np.uint32)
    error[syndrome[errors]] = errors
    return ((words ^ error[syndrome]) >> np.uint32(11)).astype(np.uint16)


_GOLAY: list[np.ndarray] = []


def near_codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in `segment`, codeword index) for the one-bit ball of each word, without repeats."""
    if not _GOLAY:
        _GOLAY.append(golay_table())
    table = _GOLAY[0]
    flips = np.array([0, *(1 << b for b in range(23))], np.uint32)
    found = np.sort(table[segment[:, None] ^ flips], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, _ = np.nonzero(new)
    return rows, found[new]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, int64 key) for every key of every fingerprint: three bits of case, clean bits, codeword."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    rows, keys = [], []
    for case, (clean, close) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        row, code = near[close]
        rows.append(row)
        keys.append((np.int64(case) << 40) | (parts[clean][row].astype(np.int64) << 12) | code.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(fps: np.ndarray, max_bits: int = 2) -> list[tuple[int, int]]:
    """Links that connect what differs in `max_bits` (2) or fewer bits; fps are distinct."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(fps) <= 65:
        left, right = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits, 1))
    else:
        ball = np.concatenate([fps] + [fps ^ np.uint64(1 << b) for b in range(64)])
        who = np.tile(np.arange(len(fps)), 65)
        order = np.argsort(ball, kind="stable")
        same = np.flatnonzero(ball[order][1:] == ball[order][:-1])
        left, right = who[order][same], who[order][same + 1]
    links = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            links.append((a, b))
    return links


def link_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, distinct) that connect all links."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(values), 4096):
                some = values[lo : lo + 4096]
                rows, keys = golay_keys(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
            a, b = [], []
            for k in np.flatnonzero(np.diff(edge) > 1):
                bucket = fps[edge[k] : edge[k + 1]].view(np.uint64)
                for x, y in bucket_links(bucket):
                    a.append(bucket[x])
                    b.append(bucket[y])
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield flush(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        yield flush(keys, fps)

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(verify, "a long, b long")


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows; `df` is a checkpoint or cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def quote(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def equal_and_near(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of equal or linked fingerprints of `rows` (fp, set_id), by the least set of each."""
    least = cut(rows.groupBy("fp").agg(F.min("set_id").alias("a"), F.max("set_id").alias("last")))
    shared = cut(least.where("a < last").select("fp", "a"))
    equal = rows.join(small(shared), "fp").select("a", F.col("set_id").alias("b"))
    near = cut(link_pairs(least.select("fp")).distinct())
    ends = near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    named = small(cut(least.join(small(cut(ends)), "fp", "left_semi").select("fp", F.col("a").alias("set_id"))))
    left = near.join(named.select(F.col("fp").alias("a"), F.col("set_id").alias("x")), "a")
    both = left.join(named.select(F.col("fp").alias("b"), F.col("set_id").alias("y")), "b")
    return equal.unionByName(both.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b")


def named_components(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """`rows` (id, fp, key) with component_id; `links` (a, b) are between keys.

    A node is its key's least id and the key, so that a component's least node has its least id and no
    join by component is needed, which would be one task's work for a large one.
    """
    low = F.min("id").alias("low")
    classes = cut(rows.groupBy(key).agg(low, F.count("*").alias("n")))
    node = F.struct(F.col("low").isNull().alias("none"), "low", key)
    ends = links.select(F.col("a").alias(key)).unionByName(links.select(F.col("b").alias(key))).distinct()
    nodes = cut(classes.join(small(cut(ends)), key, "left_semi").select(key, node.alias("node")))
    known = small(nodes)
    edges = links.join(known.select(F.col(key).alias("a"), F.col("node").alias("x")), "a").join(known.select(F.col(key).alias("b"), F.col("node").alias("y")), "b")
    roots = min_label_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    rooted = roots.select(F.col(f"node.{key}").alias(key), F.col("root.low").alias("root_low"), F.lit(True).alias("linked"))
    named = classes.join(small(cut(rooted)), key, "left").where("linked or n > 1")
    named = cut(named.select(key, F.when(F.col("linked"), F.col("root_low")).otherwise(F.col("low")).alias("component_id"), F.lit(True).alias("known")))
    joined = rows.join(small(named), key, "left")
    return joined.select("id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """Rows (id_col, fp long, component_id): the smallest id reachable over links, itself included.

    With `similarity`, texts of that Jaccard similarity link, and no others.
    """
    picked = docs.select(quote(id_col).alias("id"), quote(text_col).cast("string").alias("text"))
    if similarity is None:
        rows = cut(fingerprint_frame(picked, "id", "text", width))
        done = named_components(rows, "fp", cut(link_pairs(rows.select("fp").distinct())))
    else:
        from . import setjoin

        rows = cut(setjoin.sketch_frame(picked, width))
        fps = rows.select("fp", "set_id").distinct()
        links = setjoin.links(picked, rows, equal_and_near(fps), width, similarity)
        done = named_components(rows.select("id", "fp", "set_id"), "set_id", links)
    return done.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """`docs` with one row group per component: the rows of its smallest id. Null ids are kept as they are."""
    groups = simhash_components(docs.where(quote(id_col).isNotNull()), id_col, text_col, width, similarity)
    gone = cut(groups.where(quote(id_col) != F.col("component_id")).select(quote(id_col).alias("_gone")).distinct())
    return docs.join(small(gone), quote(id_col) == F.col("_gone"), "left_anti")
