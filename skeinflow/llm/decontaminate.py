"""Benchmark decontamination with DataFrame functions only.

A test item is in a document if the document has at least `THRESHOLD` of the item's distinct shingles
(five words; lower case, all but letters and digits separates words; an item of fewer words is one
shingle of all of them).

Search. Items are partitioned by size, in powers of two of their number n of shingles. A document
with that share of an item has one at least of the item's k = n - ceil(THRESHOLD * n) + 1 shingles of
least hash: its bottom-k MinHash. So the MinHash of the short side only is probed with the hashes of
the long side's shingles, and no banding can lose a pair, however long the document. Documents too
short for a size partition don't probe it. Candidates are then verified by exact containment of the
shingle strings.

Nulls, empty texts and items without a word match nothing; an item may have a null id, a document with one isn't searched. Rows that repeat an id of an item or of a
document are each compared; equal pairs are returned once, with the largest containment. Texts of any
length are searched whole. An empty table of either kind gives no pairs. Other columns may have any name: they
are not read, and `keep_clean` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

WIDTH = 5
THRESHOLD = 0.8
#: MinHash rows, and ids of candidates, that may be broadcast (about 40 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(clean, " "), "")


def windows(w: Column, width: int, make) -> Column:
    """array of make(word, ..., word) for each run of `width` words; empty where there are fewer."""
    last = F.size(w) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make(*[F.get(w, i + k) for k in range(width)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>") if make is F.xxhash64 else F.array().cast("array<string>"))


def text_windows(w: Column, width: int) -> Column:
    return windows(w, width, lambda *x: F.concat_ws(" ", *x))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has `limit` rows at most."""
    return F.broadcast(df) if df.count() <= limit else df


def item_shingles(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows (item_id, width, hashes, shingles, need, size_class), one per item with a word."""
    w = items.select(F.col(item_col).alias("item_id"), F.explode_outer(F.array(words(F.col(text_col)))).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    hashed = F.when(F.col("width") == WIDTH, windows(F.col("w"), WIDTH, F.xxhash64))
    texts = F.when(F.col("width") == WIDTH, text_windows(F.col("w"), WIDTH))
    for k in range(1, WIDTH):
        hashed = hashed.when(F.col("width") == k, windows(F.col("w"), k, F.xxhash64))
        texts = texts.when(F.col("width") == k, text_windows(F.col("w"), k))
    rows = w.select("item_id", "width", F.array_distinct(hashed).alias("hashes"), F.array_distinct(texts).alias("shingles"))
    need = F.ceil(F.size("shingles") * F.lit(THRESHOLD) - 1e-9).cast("int")
    return rows.select("*", need.alias("need"), F.floor(F.log2(F.size("shingles"))).cast("int").alias("size_class"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id_col, item_id, n_shingles, n_found, containment) of all pairs that reach the threshold."""
    known = cut(item_shingles(items, item_col, item_text_col))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # of 1 to 5
    least = F.slice(F.array_sort("hashes"), F.lit(1), F.size("hashes") - F.col("need") + 1)
    probes = known.select("item_id", "width", "size_class", F.explode(least).alias("hash"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    # as a generator's output the words are cut once; a projection would be copied into each use and each filter
    worded = texts.select("id", F.explode_outer(F.array(words(F.col("text")))).alias("w"))
    found = None
    for width in widths:
        runs = worded.select("id", F.explode_outer(F.array(windows(F.col("w"), width, F.xxhash64))).alias("h"))
        # a partition of sizes from 2^c holds items that need 0.8 * 2^c shingles at least
        runs = runs.select("id", F.floor(F.log2(F.size("h") / THRESHOLD) + 1e-9).alias("fits"), F.explode_outer("h").alias("hash"))
        own = probes.where(F.col("width") == width).select("item_id", "size_class", "hash")
        hits = runs.join(small(own), "hash").where(F.col("size_class") <= F.col("fits")).select("id", "item_id")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = texts.limit(0).select("id", F.lit(None).cast(dict(known.dtypes)["item_id"]).alias("item_id"))
    pairs = cut(found.distinct())
    again = texts.join(small(pairs), "id").select("id", "item_id", F.explode_outer(F.array(words(F.col("text")))).alias("w"))
    sides = small(known.select(F.col("item_id").alias("item"), "width", "shingles", "need"))
    both = again.join(sides, again["item_id"].eqNullSafe(sides["item"]))
    own = F.when(F.col("width") == WIDTH, text_windows(F.col("w"), WIDTH))
    for k in widths:
        if k < WIDTH:
            own = own.when(F.col("width") == k, text_windows(F.col("w"), k))
    n = F.size(F.array_intersect(F.col("shingles"), own))
    exact = both.select("id", "item_id", "need", F.size("shingles").alias("n_shingles"), n.alias("n_found")).where(F.col("n_found") >= F.col("need"))
    best = exact.groupBy("id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("m.n_shingles").cast("long").alias("n_shingles"), F.col("m.n_found").cast("long").alias("n_found"), "m.containment")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id holds no item; rows with null id are kept."""
    ident = F.col(f"`{id_col}`")
    plain = docs.select(ident.alias("id"), F.col(f"`{text_col}`").alias("text"))
    leaks = cut(contained_items(plain, items, "id", "text", item_col, item_text_col).select(F.col("id").alias("_leak")).distinct())
    return docs.join(small(leaks), ident == F.col("_leak"), "left_anti")
