"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order four: a gram is four code points of 16 bits (rarer ones, above
65,535, share 2,048 codes), so codes are exact and the counts grow with the trusted text, in whatever script.
Every trusted text is counted, whole. Tasks add up their own texts, a shuffle by gram adds the shards,
and joins of the counts with their contexts' counts give the modified discounts and the interpolation
weights; lower orders use continuation counts. The distinct grams of all documents are joined order by
order with these shards, which gives each gram's bits, and the bits go back to the documents: by
broadcast, where there are `BROADCAST_GRAMS` grams at most (texts don't move then), else by an exchange
in which each block of documents asks for its own grams.

A document's mean bits per character, drawn towards the mean of trusted text as if `PRIOR_SYMBOLS` more
had been read, are compared with the threshold of its language. One of `FOLDS` trusted texts is held out
by a hash of its id, and a model of the others scores it: the threshold lies `FENCE` times as far above
the median of held-out texts as their quantile `QUANTILE` does. Languages with fewer than `MIN_TEXTS`
held-out texts, and null, use the threshold over all.

Null and empty texts have the trusted mean and are kept. Without trusted text on both sides of the fold all is
kept. Repeated rows are judged each by itself, and alike; a text of any length is scored whole. An empty
table gives no rows. Other columns may have any name; an added name that exists gets underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, per_row_sum, release, shuffle_partitions, slices, utf8_buffers

ORDER, BITS = 4, 16
QUANTILE, FENCE = 0.99, 3.0
FOLDS, MIN_TEXTS = 4, 30
PRIOR_SYMBOLS = 40
#: Grams (code and bits, 12 bytes) that may be broadcast; more are exchanged by blocks of `BLOCK_BYTES` of text.
BROADCAST_GRAMS = 4_000_000
BLOCK_BYTES = 8 << 20
#: Rows of (id) that may be broadcast to pick the trusted texts: 16 bytes each. More are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Languages whose thresholds may be broadcast.
BROADCAST_LANGUAGES = 10_000
#: Probability of any character where nothing is known.
FLOOR = 1 / (1 << BITS)
MIX = np.uint64(0x9E3779B97F4A7C15)


def characters(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of the characters of the buffers, and each row's bounds among them (rows + 1)."""
    raw = data.tobytes()
    first = (data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(first)])[offsets]
    try:
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.where(points < 1 << BITS, points, 0xD800 + points * np.uint32(0x9E3779B1) % 2048).astype(np.uint64), bounds


def grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the four-gram that ends at each character, and the rows' bounds; what lies before a text is 0."""
    symbol, bounds = characters(offsets, data)
    code = symbol.copy()
    starts = bounds[:-1][np.diff(bounds) > 0]
    for k in range(1, ORDER):
        before = np.zeros_like(symbol)
        before[k:] = symbol[:-k]
        for j in range(k):  # past a short row this is the next one's place below j, which has fewer than k characters before it too
            before[(starts + j)[starts + j < len(before)]] = 0
        code |= before << np.uint64(BITS * k)
    return code, bounds


class Recent:
    """A table of grams by hash, with what a full sort needn't see: those met again and how often."""

    def __init__(self, bits: int = 20) -> None:
        self.shift = np.uint64(64 - bits)
        self.code, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def split(self, code: np.ndarray) -> np.ndarray:
        """Counts the grams that are in the table; returns the others. The gram of zeros is always in."""
        slot = (code * MIX) >> self.shift
        known = self.code[slot] == code
        np.add.at(self.n, slot[known], 1)
        return code[~known]

    def put(self, code: np.ndarray) -> None:
        """Distinct new grams take free places; others stay outside."""
        slot = (code * MIX) >> self.shift
        free = self.code[slot] == 0
        self.code[slot[free]] = code[free]


def count_grams(texts: DataFrame) -> DataFrame:
    """Rows (model, code, n) of the four-grams in `texts` (text, held boolean): model 0 without held-out texts, model 1 with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (Recent(), Recent())

        def rows(held: int, names: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for model in (1,) if held else (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), model, np.int32)), pa.array(names.view(np.int64)), pa.array(n)], names=["model", "code", "n"])

        for batch in batches:
            offsets, data = utf8_buffers(batch.column(0))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(offsets):
                code, bounds = grams(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                side = np.repeat(held[lo:hi], np.diff(bounds))
                for k, table in enumerate(tables):
                    names, n = np.unique(table.split(code[side == bool(k)]), return_counts=True)
                    table.put(names)
                    yield from rows(k, names, n)
        for k, table in enumerate(tables):
            some = np.flatnonzero(table.n)
            yield from rows(k, table.code[some], table.n[some])
        release()

    return texts.select("text", "held").mapInArrow(run, "model int, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))


def seen_grams(texts: DataFrame) -> DataFrame:
    """The distinct `code`s of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Recent()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["code"])  # always in the table
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(0))
            for lo, hi in slices(offsets):
                code, _ = grams(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                names = np.unique(code[table.code[(code * MIX) >> table.shift] != code])
                table.put(names)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64))], names=["code"])
        release()

    return texts.select("text").mapInArrow(run, "code long").distinct()


def lower(code: Column, order: int) -> Column:
    """The last `order` characters of a gram."""
    return code.bitwiseAND((1 << (BITS * order)) - 1) if order < ORDER else code


def discounted(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Of `counts` (model, code, n): rows (model, code, share) with the discounted share of each gram in its context,
    and (model, context, weight) with what each context leaves to lower orders."""
    n = F.col("n")
    found = counts.groupBy("model").agg(*[F.sum((n == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # two rows
    d = [F.lit(0.0)] * 3
    for row in found:
        n1, n2, n3, n4 = (max(1, row[f"n{k}"] or 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        own = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d = [F.when(F.col("model") == row["model"], own[i]).otherwise(d[i]) for i in range(3)]
    shards = counts.withColumn("context", F.shiftrightunsigned("code", BITS))
    contexts = shards.groupBy("model", "context").agg(F.sum("n").alias("total"), *[F.sum(c.cast("long")).alias(f"k{k}") for k, c in ((1, n == 1), (2, n == 2), (3, n >= 3))])
    contexts = cut(contexts.select("model", "context", "total", ((d[0] * F.col("k1") + d[1] * F.col("k2") + d[2] * F.col("k3")) / F.col("total")).alias("weight")))
    taken = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    totals = contexts.select("model", "context", "total")
    shares = shards.join(F.broadcast(totals) if order == 1 else totals, ["model", "context"])  # two rows at order one
    return shares.select("model", "code", ((n - taken) / F.col("total")).alias("share")), contexts.select("model", "context", "weight")


def gram_bits(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (model, code, bits) of the `wanted` grams (model, code): -log2 of the interpolated probability under `counts`."""
    tables = {}
    for order in range(ORDER, 0, -1):
        tables[order] = discounted(counts, order)
        if order > 1:  # in how many contexts one longer each shorter gram was seen
            counts = cut(counts.groupBy("model", lower(F.col("code"), order - 1).alias("code")).agg(F.count("*").alias("n")))
    below = None
    for order in range(1, ORDER + 1):
        shares, weights = tables[order]
        rows = wanted.select("model", lower(F.col("code"), order).alias("code"))
        rows = (rows.distinct() if order < ORDER else rows).withColumn("context", F.shiftrightunsigned("code", BITS))
        joined = rows.join(shares, ["model", "code"], "left").join(F.broadcast(weights) if order == 1 else weights, ["model", "context"], "left")
        rest = F.lit(FLOOR)
        if below is not None:
            joined = joined.withColumn("suffix", lower(F.col("code"), order - 1)).join(below.select("model", F.col("code").alias("suffix"), F.col("p").alias("low")), ["model", "suffix"])
            rest = F.col("low")
        # P(w | context) = share + weight(context) * P(w | shorter context)
        below = joined.select("model", "code", (F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * rest).alias("p"))
    return below.select("model", "code", (-F.log2(F.greatest("p", F.lit(1e-12)))).cast("float").alias("bits"))


class Lookup:
    """Bits of grams, every one of which is known: a table by hash for most, binary search for the others."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.bits = codes[order], bits[order]
        size = max(1, min(22, int(math.log2(len(codes) + 1)) + 2))
        self.shift = np.uint64(64 - size)
        slot = (self.codes * MIX) >> self.shift
        self.key, self.value = np.zeros(1 << size, np.uint64), np.zeros(1 << size, np.float32)
        self.key[slot], self.value[slot] = self.codes, self.bits

    def __call__(self, code: np.ndarray) -> np.ndarray:
        slot = (code * MIX) >> self.shift
        out, rest = self.value[slot], np.flatnonzero(self.key[slot] != code)
        out[rest] = self.bits[np.searchsorted(self.codes, code[rest])]
        return out


def row_bits(lookup: Lookup, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sum of bits and number of characters of each text."""
    offsets, data = utf8_buffers(column)
    bits, n = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for lo, hi in slices(offsets):
        code, bounds = grams(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
        bits[lo:hi] = per_row_sum(lookup(code).astype(np.float64), bounds[:-1], bounds[1:])
        n[lo:hi] = np.diff(bounds)
    return bits, n


_LOOKUPS: dict[int, Lookup] = {}


def score(docs: DataFrame, bits: DataFrame, text_col: str, bits_col: str, n_col: str) -> DataFrame:
    """`docs` with the sum of bits and the number of characters of each text; `bits` (code, bits) has all of their grams."""
    schema = T.StructType([*docs.schema.fields, T.StructField(bits_col, T.DoubleType()), T.StructField(n_col, T.LongType())])
    spark, names, width = docs.sparkSession, [*docs.columns, bits_col, n_col], len(docs.columns)
    plain = docs.select(*[quote(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], quote(text_col).cast("string").alias("text"))
    if bits.count() <= BROADCAST_GRAMS:
        table = bits.select("code", "bits").toArrow()
        shared = spark.sparkContext.broadcast((table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = getattr(shared, "_id", None) or id(shared)
            if key not in _LOOKUPS:
                _LOOKUPS.clear()
                _LOOKUPS[key] = Lookup(*shared.value)
            for batch in batches:
                own = row_bits(_LOOKUPS[key], batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, own)], names=names)
            release()

        return plain.mapInArrow(run, schema)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-int(size) // BLOCK_BYTES)), shuffle_partitions(spark)
    dealt = plain.withColumn("block", F.pmod(F.xxhash64(*plain.columns), F.lit(blocks))).repartition(parts, "block")

    def ask(table: pa.Table) -> pa.Table:
        offsets, data = utf8_buffers(table.column("text"))
        codes = np.unique(np.concatenate([np.unique(grams(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])[0]) for lo, hi in slices(offsets)]))
        return pa.table({"block": pa.array(np.full(len(codes), table.column("block")[0].as_py())), "code": pa.array(codes.view(np.int64))})

    def answer(texts: pa.Table, replies: pa.Table) -> pa.Table:
        lookup = Lookup(replies.column("code").to_numpy().view(np.uint64), replies.column("bits").to_numpy())
        own = row_bits(lookup, texts.column("text").combine_chunks())
        return pa.Table.from_arrays([*[texts.column(f"c{i}") for i in range(width)], *map(pa.array, own)], names=names)

    replies = dealt.groupBy("block").applyInArrow(ask, "block long, code long").join(bits.select("code", "bits"), "code")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(answer, schema)


def quote(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Rows (id, text, lang, held) of `docs` (id, text, lang) whose label is 1. Few ids are broadcast, more are joined by shuffle."""
    ids = labels.where((quote(label_col) == 1) & quote(id_col).isNotNull()).select(quote(id_col).alias("id")).distinct()
    rows = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    return rows.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with perplexity, threshold (both in bits per character) and keep; and the names of these columns."""
    rows = docs.select(quote(id_col).alias("id"), quote(text_col).cast("string").alias("text"), quote(lang_col).cast("string").alias("lang"))
    good = trusted(rows, labels, id_col, label_col)
    counts = cut(count_grams(good))
    names = {n: fresh(docs, n) for n in ("bits_per_symbol", "threshold", "keep", "n_symbols")}
    held = good.where("held and text <> ''")
    if counts.where("model = 0").isEmpty() or held.isEmpty():
        none = F.lit(None).cast("double")
        return docs.withColumns({names["bits_per_symbol"]: none, names["threshold"]: none, names["keep"]: F.lit(True), names["n_symbols"]: F.lit(0).cast("long")}), names
    wanted = cut(seen_grams(held).select(F.lit(0).alias("model"), "code").unionByName(seen_grams(rows).select(F.lit(1).alias("model"), "code")))
    bits = cut(gram_bits(counts, wanted))
    seen = cut(score(held.select("lang", "text"), bits.where("model = 0"), "text", "bits", "n").select("lang", "bits", "n"))
    mean = seen.agg(F.sum("bits") / F.sum("n")).first()[0]

    def drawn(bits: Column, n: Column) -> Column:
        return (bits + PRIOR_SYMBOLS * mean) / (n + PRIOR_SYMBOLS)

    at = [F.percentile_approx(drawn(F.col("bits"), F.col("n")), F.lit(q), F.lit(10_000)) for q in (0.5, QUANTILE)]
    level = at[0] + FENCE * (at[1] - at[0])
    overall = seen.agg(level).first()[0]
    by_lang = cut(seen.where("lang is not null").groupBy(F.col("lang").alias("_tongue")).agg(level.alias("_limit"), F.count("*").alias("_n")).where(F.col("_n") >= MIN_TEXTS))
    total = fresh(docs, "bits_sum")
    scored = score(docs, bits.where("model = 1"), text_col, total, names["n_symbols"])
    plain = scored.select(*[quote(c).alias(f"c{i}") for i, c in enumerate(scored.columns)], quote(lang_col).cast("string").alias("_lang"))
    few = by_lang.count() <= BROADCAST_LANGUAGES
    joined = plain.join(F.broadcast(by_lang) if few else by_lang, F.col("_lang") == F.col("_tongue"), "left")
    k = len(docs.columns)
    value, threshold = drawn(F.col(f"c{k}"), F.col(f"c{k + 1}")), F.coalesce(F.col("_limit"), F.lit(overall))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return joined.select(*back, value.alias(names["bits_per_symbol"]), threshold.alias(names["threshold"]), (value <= threshold).alias(names["keep"]), F.col(f"c{k + 1}").alias(names["n_symbols"])), names


def keep_good(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with their columns."""
    judged, names = judge(docs, labels, **columns)
    return judged.where(quote(names["keep"])).select(*map(quote, docs.columns))
