"""Best-fit packing into bins of several permitted lengths.

Items are documents, or pieces of them, with their tokens as `tokencount` counts them. A document of more tokens
than the largest bin is cut between pre-tokens in pieces that fit (a pre-token of more tokens than that is
cut at about equal bytes, between characters). Pieces are byte ranges, so texts are not moved for packing;
`contents` joins the texts to the bins.

Pieces are dealt to packing groups of about `GROUP_ROWS` by a number that a checkpoint keeps, so no
task holds more than that however the input grows and whatever ids repeat, and a lost executor changes
no deal. Each group is packed by itself, largest piece first: into the open bin that it fills best, or
else into a new bin. A bin costs `OVERHEAD`, its length, and the square of its length for attention; for each
permitted length that holds the piece it is found out how far the pieces still to come would fill it,
and the length of least cost for each token so filled is opened. At last each bin is downsized to the
least permitted length that holds its contents.

Every token of every document lies in one bin, no bin is overfull. Documents of no tokens (null or
empty text) get one row with null bin. Rows of equal or null ids are packed as rows of their own; pieces of
equal length go by id, then piece, nulls last. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokencount
from ._common import cut, release, slices, utf8_buffers

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP_ROWS = 20_000
#: What a bin costs besides its length, in tokens; and the length at which attention costs as much as all else.
OVERHEAD, ATTENTION = 32, 32_768


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


def filled(sizes: Sequence[int], total: Sequence[int], n: int, room: int) -> int:
    """How much of `room` the first `n` of ascending `sizes` fill, the largest that fits first; `total` has their running sums."""
    taken = 0
    while room > 0:
        n = bisect.bisect_right(sizes, room, 0, n)
        if not n:
            break
        low = bisect.bisect_left(total, total[n] - room, 0, n)  # all from here up to n fit together
        taken += total[n] - total[low]
        room -= total[n] - total[low]
        n = low
    return taken


def pack(sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float] = cost) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each item; sizes are from one to the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], -i))
    ascending = [sizes[i] for i in order]
    total = [0, *np.cumsum(ascending, dtype=np.int64).tolist()]
    rooms: list[tuple[int, int]] = []  # free tokens and bin, sorted
    used: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for left in range(len(order) - 1, -1, -1):
        size = ascending[left]
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / (size + filled(ascending, total, left, c - size)), c))
            b = len(used)
            used.append(0)
        placed[order[left]] = (b, used[b])
        used[b] += size
        if room > size:
            bisect.insort(rooms, (room - size, b))
    final = [capacities[bisect.bisect_left(capacities, u)] for u in used]
    return [(b, offset, final[b]) for b, offset in placed]


def ranges(tokens: np.ndarray, size: np.ndarray, text: bytes, counter: tokencount.Counter, largest: int) -> list[tuple[int, int, int]]:
    """(first byte, bytes, tokens) of the pieces of one text, from its pre-tokens' tokens and bytes (without the space put before it)."""
    if not len(size):
        return [(0, 0, 0)]
    ends = np.cumsum(size)
    total = np.cumsum(tokens)
    if total[-1] <= largest:
        return [(0, int(ends[-1]), int(total[-1]))]
    out, at, low = [], 0, 0
    while at < len(size):
        stop = int(np.searchsorted(total, low + largest, side="right"))
        begin = int(ends[at - 1]) if at else 0
        if stop > at:
            out.append((begin, int(ends[stop - 1]) - begin, int(total[stop - 1]) - low))
        else:  # one pre-token is too long
            stop = at + 1
            out += [(begin + a, n, t) for a, n, t in halves(text[begin : int(ends[at])], counter, largest)]
        at, low = stop, int(total[stop - 1])
    return out


def halves(text: bytes, counter: tokencount.Counter, largest: int) -> list[tuple[int, int, int]]:
    """A too long pre-token cut in equal parts, between characters, until each part fits."""
    n = int(counter.pieces.count_long(text))
    if n <= largest:
        return [(0, len(text), n)]
    parts, cuts = -(-n // largest), [0]
    for k in range(1, parts):
        at = len(text) * k // parts
        while at > cuts[-1] and text[at] & 0xC0 == 0x80:
            at -= 1
        if at > cuts[-1]:
            cuts.append(at)
    if len(cuts) == 1:  # no character ends in between: cut bytes
        cuts.append(len(text) // 2)
    cuts.append(len(text))
    return [(a + x, m, t) for a, b in zip(cuts, cuts[1:]) for x, m, t in halves(text[a:b], counter, largest)]


def pieces(docs: DataFrame, vocabulary: str, largest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, bytes, length): byte ranges of at most `largest` tokens, in order, one row at least for each of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(tokencount.read_pieces(vocabulary))  # a vocabulary file's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokencount.Counter(shared.value)
        for batch in batches:
            offsets, data = utf8_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                own, text = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                tokens, size, first = counter.each(own, text)
                row, found = [], []
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    bare = size[a:b].copy()
                    bare[:1] -= 1  # the space before the text is counted, but isn't in it
                    some = ranges(tokens[a:b], bare, text[own[i] : own[i + 1]].tobytes(), counter, largest)
                    row += [i] * len(some)
                    found += [(k, *x) for k, x in enumerate(some)]
                columns = zip(*found, strict=True) if found else ([], [], [], [])
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), pa.int64()) for c in columns]], names=["id", "piece", "start", "bytes", "length"])
        release()

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, piece long, start long, bytes long, length long")


def pack_rows(items: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """`items` (id, piece, start, bytes, length) with bin_id, bin_offset and capacity."""
    capacities = tuple(sorted(set(capacities)))
    kept = cut(items.withColumn("_number", F.monotonically_increasing_id()))
    groups = max(1, -(-kept.count() // GROUP_ROWS))
    dealt = kept.withColumn("_deal", F.pmod(F.xxhash64("_number"), F.lit(groups))).drop("_number")

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("length", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        length = table.column("length").to_numpy()
        none = int(np.searchsorted(length, 1))
        done = pack(length[none:].tolist(), capacities)
        base = table.column("_deal")[0].as_py() << 32
        columns = [[None] * none + [x[0] + base for x in done], *([None] * none + [x[k] for x in done] for k in (1, 2))]
        out = table.drop_columns(["_deal"])
        for name, values in zip(("bin_id", "bin_offset", "capacity"), columns, strict=True):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    kind = dict(items.dtypes)["id"]
    return dealt.groupBy("_deal").applyInArrow(run, f"id {kind}, piece long, start long, bytes long, length long, bin_id long, bin_offset long, capacity long")


def best_fit(docs: DataFrame, vocabulary: str, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, piece, start, bytes, length, bin_id, bin_offset, capacity), one per piece of a document; start and bytes
    are a byte range of the text, length and the rest are tokens."""
    return pack_rows(pieces(docs, vocabulary, max(capacities), id_col, text_col), capacities).withColumnRenamed("id", id_col)


def contents(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bin_id, capacity, n_tokens, pieces array<struct<bin_offset, id, piece, length, text binary>>), one per bin.

    Ids must be unique and not null here, as they name the texts. A bin's pieces are bounded by its capacity.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").cast("binary").alias("_raw"))
    rows = packed.where("bin_id is not null").join(texts, id_col)
    # only ranges are read; a piece that cuts no character is a valid text by itself
    part = F.substring("_raw", (F.col("start") + 1).cast("int"), F.col("bytes").cast("int"))
    one = F.struct("bin_offset", F.col(id_col).alias("id"), "piece", "length", part.alias("text"))
    return rows.groupBy("bin_id", "capacity").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(one)).alias("pieces"))
