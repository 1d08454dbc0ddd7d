"""Exact removal of repeated 50-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Strings
are judged on the input and never cross documents.

Sorting every suffix would exchange many times the input, so suffixes are sparse: in each window of
50 bytes the 20-byte gram of least hash is its anchor (equal windows have equal anchors at equal
places). Texts are dealt once to blocks of about `BLOCK_BYTES`, and three passes read that exchange:

1. each block sends the distinct hashes of its anchors to shards, which reply with one bit for each:
   is it in another block too;
2. for shared anchors a block forms the suffix from the anchor (50 bytes) followed by what stands
   before it, read backwards (30 bytes), sorts the distinct ones with the least id of each, and sends
   them as front-coded runs. A shard merges the runs with a loser tree whose players carry their
   common prefix with the last winner, so known prefixes are never compared again, and the merged
   prefixes give the groups of equal anchors. For every window through the anchor the least id is
   found, and each run gets one mask for each suffix: which windows start in a smaller document;
3. each block applies the masks and removes the covered bytes.

Blocks reach shards and are answered over `Route`, a butterfly of as many levels as the input needs:
at each level groups of blocks meet, their runs are merged into one, and that one is dealt on. A block
sends at most `FAN` rows a level, so rows grow with the input and a shard stays as large as a block.

Whole copies of a text lose all bytes and are told by their SHA-256 beforehand. Others cost a suffix once a block, however many there are, and shards are dealt by hash, not by
range, as groups are needed and no global order. Nothing is sampled or capped; hashes only choose
candidates, and all windows are compared as bytes.

Nulls are empty texts; texts under 50 bytes lose nothing, and texts of any length are taken whole. Rows of
one id don't remove each other's bytes. A null id counts as the largest long, above all others, and
its rows don't remove each other's bytes either. An empty table gives no rows. Other columns may have any
name and come back as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, shuffle_partitions, slices, tidy, utf8_buffers

WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1
BLOCK_BYTES = 8 << 20
#: A suffix: its shard in 4 bytes, 50 bytes from the anchor, 30 before it, and the true lengths of both.
HEAD = 4
SUFFIX = HEAD + WIDTH + SPAN - 1 + 2
#: Parts to which a block, or a group of blocks, deals its keys at one level.
FAN = 256
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
NO_ID = int(np.iinfo(np.int64).max)
#: Ids and digests of whole copies (48 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_COPIES = 1_000_000


def _sliding(a: np.ndarray, op) -> np.ndarray:
    """op over a[i : i + 31] for each i that has so many."""
    for step in (1, 2, 4, 8):
        a = op(a[:-step], a[step:])
    return op(a[:-15], a[15:])  # 16 and 16 that overlap in one


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors of the rows and the hashes of their grams, in order of position."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.zeros(n + 16, np.uint8)
    raw[:n] = data
    m = n - GRAM + 1
    eight = np.ndarray((m + 16,), "<u8", raw.data, strides=(1,))
    four = np.ndarray((m + 16,), "<u4", raw.data, strides=(1,))
    h = eight[:m] * _C[0] + eight[8 : m + 8] * _C[1] + four[16 : m + 16].astype(np.uint64) * _C[2]
    h ^= h >> np.uint64(29)
    h *= _C[3]
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    low = _sliding(h, np.minimum)  # for each window's start
    # windows that run over the end of a row don't count
    for_row = np.zeros(n + 1, np.int8)
    ends, starts = offsets[1:], offsets[:-1]
    last = np.maximum(ends - WIDTH + 1, starts)
    np.add.at(for_row, last, 1)
    np.add.at(for_row, ends, -1)
    over = np.cumsum(for_row[: len(low)], dtype=np.int32) > 0
    low[over] = 0
    padded = np.zeros(len(low) + 2 * (SPAN - 1), np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(low)] = low
    at = np.flatnonzero(_sliding(padded, np.maximum) == h)
    return at, h[at]


def least_root(n: int, k: int) -> int:
    """The least whole number whose k-th power is n or more."""
    r = max(1, round(n ** (1 / k)))
    while r**k < n:
        r += 1
    while r > 1 and (r - 1) ** k >= n:
        r -= 1
    return r


class Route:
    """The way from blocks to shards: level by level `span` groups meet in one, which deals to `fan` parts.

    A node is (group, part). Nodes of level 0 are the blocks; at the last level one group is left for
    each shard. Shards are in the order of the names, so a part of any level is a range of them.
    """

    def __init__(self, blocks: int, shards: int) -> None:
        self.levels = 1
        while FAN**self.levels < shards:
            self.levels += 1
        self.fan, self.span = least_root(shards, self.levels), least_root(blocks, self.levels)
        self.blocks, self.shards = blocks, self.fan**self.levels

    def nodes(self, level: int) -> int:
        return -(-self.blocks // self.span**level) * self.fan**level

    def shard(self, names: np.ndarray) -> np.ndarray:
        return (((names >> np.uint64(16)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)

    def part(self, shard: np.ndarray, level: int) -> np.ndarray:
        return shard // self.fan ** (self.levels - level)

    def bounds(self, part: np.ndarray, first: int = 0) -> np.ndarray:
        """Where each of `fan` parts from `first` on begins, and the end of the last."""
        return np.searchsorted(part, first + np.arange(self.fan + 1))


def spread(h: np.ndarray) -> np.ndarray:
    """48-bit names of hashes, evenly spread though anchors have the least hashes of their windows."""
    return (h * _C[0]) >> np.uint64(16)


def ranges(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of an ordered array and where it stands."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


def pack_names(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_names(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def unpack_bits(route: Route, part: np.ndarray, first: int, replies: dict[int, bytes]) -> np.ndarray:
    """The bits that the parts replied, one for each element of the ordered array `part`."""
    known, bounds = np.zeros(len(part), bool), route.bounds(part, first)
    for p, bits in replies.items():
        a, b = bounds[p - first], bounds[p - first + 1]
        known[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return known


def unpack_masks(route: Route, part: np.ndarray, first: int, replies: dict[int, bytes]) -> np.ndarray:
    got, bounds = np.zeros(len(part), np.uint32), route.bounds(part, first)
    for p, m in replies.items():
        got[bounds[p - first] : bounds[p - first + 1]] = np.frombuffer(zlib.decompress(m), "<u4")
    return got


def all_windows(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Masks of all windows through an anchor with so many bytes from it and before it."""
    return ((np.int64(1) << (left + 1)) - 1) & ~((np.int64(1) << np.maximum(WIDTH - right, 0)) - 1)


class Block:
    """The rows of one block with their anchors."""

    def __init__(self, table: pa.Table) -> None:
        self.offsets, self.data = utf8_buffers(table.column("text"))
        ids = table.column("id").combine_chunks()
        self.ids = (ids.fill_null(NO_ID) if ids.null_count else ids).to_numpy(zero_copy_only=False).astype(np.int64)
        where, names = [], []
        for lo, hi in slices(self.offsets):
            at, h = anchors(self.offsets[lo : hi + 1] - self.offsets[lo], self.data[self.offsets[lo] : self.offsets[hi]])
            where.append(at + self.offsets[lo])
            names.append(h)
        self.at = np.concatenate(where) if where else np.zeros(0, np.int64)
        self.hash = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.row = np.searchsorted(self.offsets, self.at, side="right") - 1

    def keys(self, route: Route) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of anchors in order, each anchor's index among them, and their parts of the first level."""
        names, inverse = np.unique(spread(self.hash), return_inverse=True)
        return names, inverse, route.part(route.shard(names), 1)

    def shared(self, route: Route, replies: dict[int, bytes]) -> np.ndarray:
        """Which anchors are in another document too, by the replies and by this block itself."""
        names, inverse, part = self.keys(route)
        known = unpack_bits(route, part, 0, replies)
        ids = self.ids[self.row]
        low, high = np.full(len(names), NO_ID), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        return (known | (low != high))[inverse]

    def suffixes(self, route: Route, replies: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """Distinct suffixes in order, their parts of the first level and least ids; the shared anchors and their suffixes."""
        some = np.flatnonzero(self.shared(route, replies))
        at, row = self.at[some], self.row[some]
        right = np.minimum(self.offsets[row + 1] - at, WIDTH)
        left = np.minimum(at - self.offsets[row], SPAN - 1)
        raw = np.zeros(len(self.data) + WIDTH + SPAN, np.uint8)
        raw[SPAN : SPAN + len(self.data)] = self.data
        kept = np.zeros((len(at), SUFFIX), np.uint8)
        for lo in range(0, len(at), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            a = at[part, None] + SPAN
            kept[part, HEAD : HEAD + WIDTH] = np.where(np.arange(WIDTH) < right[part, None], raw[a + np.arange(WIDTH)], 0)
            kept[part, HEAD + WIDTH : SUFFIX - 2] = np.where(np.arange(SPAN - 1) < left[part, None], raw[a - 1 - np.arange(SPAN - 1)], 0)
        kept[:, SUFFIX - 2], kept[:, SUFFIX - 1] = right, left
        kept[:, :HEAD] = route.shard(spread(self.hash[some])).astype(">u4").view(np.uint8).reshape(-1, HEAD)
        names, inverse = np.unique(kept.view(f"V{SUFFIX}").ravel() if len(kept) else np.zeros(0, f"V{SUFFIX}"), return_inverse=True)
        rows = names.view(np.uint8).reshape(-1, SUFFIX)
        least = np.full(len(names), NO_ID)
        np.minimum.at(least, inverse, self.ids[row])
        shard = np.ascontiguousarray(rows[:, :HEAD]).view(">u4").ravel().astype(np.int64)
        return rows, route.part(shard, 1), least, some, inverse


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Common prefix with the row before (one byte each), and what follows it."""
    lcp = np.zeros(len(rows), np.uint8)
    differ = rows[1:] != rows[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), SUFFIX)
    return lcp.tobytes(), zlib.compress(rows[np.arange(SUFFIX) >= lcp[:, None]].tobytes(), 1)


def decode(lcps: bytes, rest: bytes) -> list[bytes]:
    rest, at, last, out = zlib.decompress(rest), 0, b"", []
    for h in lcps:
        stop = at + SUFFIX - h
        last = last[:h] + rest[at:stop]
        at = stop
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(suffix, common prefix with the one before, run, index) of all runs in order, by a loser tree.

    `have[r]` is the prefix that run r's head shares with the last winner. Of two heads the one with
    the longer prefix is smaller; only equal prefixes are compared, from where they end, and the
    loser then knows its prefix with the winner.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    head: list[bytes | None] = [runs[r][0][0] if r < k and runs[r][0] else None for r in range(size)]
    have, place = [0] * size, [0] * size
    loser = [0] * size

    def beats(a: int, b: int) -> bool:
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None
        h = have[a]
        if h != have[b]:
            return h > have[b]
        while h < SUFFIX and x[h] == y[h]:
            h += 1
        if h == SUFFIX or x[h] < y[h]:
            have[b] = h
            return True
        have[a] = h
        return False

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    r = winners[1]
    while head[r] is not None:
        yield head[r], have[r], r, place[r]
        place[r] += 1
        strings, lcps = runs[r]
        if place[r] < len(strings):
            head[r], have[r] = strings[place[r]], lcps[place[r]]
        else:
            head[r] = None
        node = (size + r) // 2
        while node:
            if not beats(r, loser[node]):
                r, loser[node] = loser[node], r
            node //= 2


#: Two suffixes of one anchor that share a window share this many bytes from it or that many before it.
HALF = SPAN // 2


def window_masks(every: list[tuple[bytes, list[tuple[int, int, int]], int]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, mask) of the suffixes of one anchor; bit o: the window from o bytes before it is in a smaller id.

    `every` has the suffixes in order, with the places of each and its prefix with the one before.
    """
    before: dict[bytes, int] = {}
    for suffix, _, _ in every:
        key = suffix[WIDTH : WIDTH + HALF + 1]
        before[key] = before.get(key, 0) + 1
    prefixes = [h for _, _, h in every[1:]] + [0]
    last, group = 0, []
    for (suffix, where, _), h in zip(every, prefixes, strict=True):
        if last >= WIDTH - HALF or h >= WIDTH - HALF or before[suffix[WIDTH : WIDTH + HALF + 1]] > 1:
            group.append((suffix, where))
        elif len(where) > 1:
            low = min(d for _, _, d in where)
            full = ((1 << (suffix[-1] + 1)) - 1) & ~((1 << max(0, WIDTH - suffix[-2])) - 1)
            for run, index, d in where:
                if d > low:
                    yield run, index, full
        last = h
    least: dict[tuple[int, bytes, bytes], int] = {}
    windows = []
    for suffix, where in group:
        right, left = suffix[-2], suffix[-1]
        low = min(d for _, _, d in where)
        own = [(o, suffix[: WIDTH - o], suffix[WIDTH : WIDTH + o]) for o in range(max(0, WIDTH - right), left + 1)]
        windows.append(own)
        for w in own:
            if least.get(w, NO_ID) > low:
                least[w] = low
    for (_, where), own in zip(group, windows, strict=True):
        lows = [(w[0], least[w]) for w in own]
        for run, index, d in where:
            yield run, index, sum(1 << o for o, low in lows if low < d)


def runs_of(table: pa.Table) -> tuple[list[int], list[tuple[list[bytes], bytes]], list[list[int]]]:
    """Senders, decoded runs and least ids of the runs that reached a node."""
    lcps, rests = table.column("lcps").to_pylist(), table.column("rest").to_pylist()
    least = [np.frombuffer(x, "<i8").tolist() for x in table.column("least").to_pylist()]
    return table.column("sender").to_pylist(), [(decode(a, b), a) for a, b in zip(lcps, rests, strict=True)], least


class Merged:
    """The runs that reached a node of a level between as one run: distinct suffixes, their least ids, and where each went."""

    def __init__(self, table: pa.Table) -> None:
        self.senders, runs, self.own = runs_of(table)
        self.strings: list[bytes] = []
        self.lcps, self.least = bytearray(), []
        self.number = [np.zeros(len(x), np.int64) for x in self.own]
        for suffix, h, run, index in merge(runs):
            d = self.own[run][index]
            if h < SUFFIX:
                self.strings.append(suffix)
                self.lcps.append(h)
                self.least.append(d)
            elif d < self.least[-1]:
                self.least[-1] = d
            self.number[run][index] = len(self.strings) - 1
        self.shard = np.array([int.from_bytes(x[:HEAD], "big") for x in self.strings], np.int64)

    def run(self, part: slice) -> tuple[bytes, bytes, bytes]:
        lcps = b"\0" + bytes(self.lcps[part.start + 1 : part.stop])
        rest = b"".join(x[h:] for x, h in zip(self.strings[part], lcps, strict=True))
        return lcps, zlib.compress(rest, 1), np.array(self.least[part], "<i8").tobytes()

    def masks(self, above: np.ndarray) -> list[tuple[int, bytes]]:
        """(sender, masks) of each run, given the masks of the merged one: an id above the least has all windows."""
        ends = np.array([(x[-2], x[-1]) for x in self.strings], np.int64).reshape(-1, 2)
        full, low = all_windows(ends[:, 0], ends[:, 1]), np.array(self.least, np.int64)
        out = []
        for sender, own, number in zip(self.senders, self.own, self.number, strict=True):
            mask = np.where(np.array(own, np.int64) > low[number], full[number], above[number].astype(np.int64))
            out.append((sender, zlib.compress(mask.astype("<u4").tobytes(), 1)))
        return out


def merge_shard(table: pa.Table) -> list[tuple[int, bytes]]:
    """(sender, masks) for each run of a shard."""
    senders, runs, least = runs_of(table)
    masks = [np.zeros(len(x), "<u4") for x in least]
    group: list[tuple[bytes, list[tuple[int, int, int]], int]] = []

    def close() -> None:
        if len(group) > 1 or (group and len(group[0][1]) > 1):
            for run, index, mask in window_masks(group):
                masks[run][index] = mask
        group.clear()

    for suffix, h, run, index in merge(runs):
        if h < HEAD + GRAM:
            close()
        if h == SUFFIX and group:
            group[-1][1].append((run, index, least[run][index]))
        else:
            group.append((suffix[HEAD:], [(run, index, least[run][index])], h - HEAD))
    close()
    return [(s, zlib.compress(m.tobytes(), 1)) for s, m in zip(senders, masks, strict=True)]


def remove(block: Block, route: Route, bits: dict[int, bytes], masks: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """Per row: bytes, removed bytes, spans; and the mask of removed bytes of all rows."""
    rows, part, least, some, inverse = block.suffixes(route, bits)
    got = unpack_masks(route, part, 0, masks)
    # an id above the least of its suffix in this block has all windows of the suffix in that smaller id
    full = all_windows(rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64))
    mask = np.where(block.ids[block.row[some]] > least[inverse], full[inverse], got[inverse].astype(np.int64))
    step = np.zeros(len(block.data) + WIDTH + 1, np.int8)  # starts are distinct, so at most 50 windows cover a byte
    start = np.zeros(len(block.data) + 1, bool)
    for o in range(SPAN):
        hit = block.at[some[(mask >> o) & 1 == 1]] - o
        start[hit] = True
    begin = np.flatnonzero(start)
    step[begin] += 1
    step[begin + WIDTH] -= 1
    gone = np.cumsum(step, dtype=np.int8)[: len(block.data)] > 0
    del step, start, mask, got, full
    new = gone.copy()
    new[1:] &= ~gone[:-1]
    first = block.offsets[:-1][block.offsets[:-1] < len(gone)]
    new[first] = gone[first]

    def count(x: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(x), block.offsets))

    return np.diff(block.offsets), count(gone), count(new), gone


def whole_copies(plain: DataFrame) -> DataFrame:
    """Rows whose text of 50 bytes or more is also that of a smaller id: all of their bytes go, nothing need be sorted."""
    rows = plain.select("id", "order", "digest", "rest", F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= WIDTH)
    lowest = rows.groupBy("digest").agg(F.min("order").alias("lowest"), F.max("order").alias("highest")).where("lowest < highest")
    lowest = cut(lowest.select("digest", "lowest"))  # only digests that occur twice; a broadcast leaves no hot one to a task
    return rows.join(F.broadcast(lowest) if lowest.count() <= BROADCAST_COPIES else lowest, "digest").where(F.col("order") > F.col("lowest")).select("id", "order", "digest", "rest", "n_bytes")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """Rows (id_col, rest struct of the other columns, n_bytes, n_removed, n_spans, kept_sha256, kept binary).

    With `whole_characters`, `kept` lacks the rest of characters that a removal cuts; kept_sha256 is of all kept bytes.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    parts = shuffle_partitions(spark)
    route = Route(blocks, max(min(parts, FAN), blocks // 4))
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    plain = plain.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("order", F.coalesce("id", F.lit(NO_ID)))
    copies = cut(whole_copies(plain))
    few = copies.count() <= BROADCAST_COPIES
    gone_ids = copies.select("order", "digest").distinct()
    plain = plain.join(F.broadcast(gone_ids) if few else gone_ids, ["order", "digest"], "left_anti")
    dealt = plain.select(F.pmod(F.xxhash64("order", "digest"), F.lit(blocks)).alias("block"), "id", "text", "rest").repartition(parts, "block")

    def pieces(rows: list[tuple], contents: tuple[str, ...]) -> pa.Table:
        kinds = [(n, pa.int64()) for n in ("node", "part", "sender")] + [(n, pa.binary()) for n in contents]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})

    def answers(table: pa.Table, rows: list[tuple[int, bytes]], masks: bool) -> pa.Table:
        part = table.column("part")[0].as_py()
        return pa.table({"receiver": pa.array([r for r, _ in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "masks": pa.array([masks] * len(rows), pa.bool_()), "reply": pa.array([r for _, r in rows], pa.binary())})

    def replies_of(table: pa.Table, masks: bool, part: str = "part") -> dict[int, bytes]:
        return {p: r for p, m, r in zip(table.column(part).to_pylist(), table.column("masks").to_pylist(), table.column("reply").to_pylist(), strict=True) if m == masks}

    def place(table: pa.Table) -> tuple[int, int]:
        """A node's group, and the first of the parts to which it deals."""
        return table.column("node")[0].as_py(), table.column("part")[0].as_py() * route.fan

    def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Distinct names at a node, which of them several senders have, and those of each sender as indices."""
        each = [unpack_names(raw) for raw in table.column("names").to_pylist()]
        names, inverse = np.unique(np.concatenate(each), return_inverse=True)
        return names, np.bincount(inverse, minlength=len(names)) > 1, np.split(inverse, np.cumsum([len(x) for x in each])[:-1]), route.shard(names)

    @tidy
    def send_keys(table: pa.Table) -> pa.Table:
        names, _, part = Block(table).keys(route)
        number = table.column("block")[0].as_py()
        return pieces([(number // route.span, p, number, pack_names(names[at])) for p, at in ranges(part)], ("names",))

    @tidy
    def share(table: pa.Table) -> pa.Table:
        _, twice, each, _ = gathered(table)
        return answers(table, [(s, np.packbits(twice[at]).tobytes()) for s, at in zip(table.column("sender").to_pylist(), each, strict=True)], False)

    @tidy
    def send_runs(texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows, part, least, _, _ = Block(texts).suffixes(route, replies_of(replies, False))
        number = texts.column("block")[0].as_py()
        return pieces([(number // route.span, p, number, *front_code(rows[at]), least[at].astype("<i8").tobytes()) for p, at in ranges(part)], ("lcps", "rest", "least"))

    @tidy
    def mask_runs(table: pa.Table) -> pa.Table:
        return answers(table, merge_shard(table), True)

    def passing_keys(level: int) -> tuple:
        @tidy
        def onward(table: pa.Table) -> pa.Table:
            (group, _), (names, _, _, shard) = place(table), gathered(table)
            return pieces([(group // route.span, p, group, pack_names(names[at])) for p, at in ranges(route.part(shard, level + 1))], ("names",))

        @tidy
        def back(table: pa.Table, replies: pa.Table) -> pa.Table:
            (_, first), (_, twice, each, shard) = place(table), gathered(table)
            twice |= unpack_bits(route, route.part(shard, level + 1), first, replies_of(replies, False, "above"))
            return answers(table, [(s, np.packbits(twice[at]).tobytes()) for s, at in zip(table.column("sender").to_pylist(), each, strict=True)], False)

        return onward, back

    def passing_runs(level: int) -> tuple:
        @tidy
        def onward(table: pa.Table) -> pa.Table:
            (group, _), merged = place(table), Merged(table)
            return pieces([(group // route.span, p, group, *merged.run(at)) for p, at in ranges(route.part(merged.shard, level + 1))], ("lcps", "rest", "least"))

        @tidy
        def back(table: pa.Table, replies: pa.Table) -> pa.Table:
            (_, first), merged = place(table), Merged(table)
            return answers(table, merged.masks(unpack_masks(route, route.part(merged.shard, level + 1), first, replies_of(replies, True, "above"))), True)

        return onward, back

    def asked(sent: DataFrame, passing, answer) -> DataFrame:
        """The replies (block, part, masks, reply) to what the blocks sent, over all levels and back."""
        contents = ", ".join(f"{c} binary" for c in sent.columns[3:])
        steps = []
        for level in range(1, route.levels):
            sent = cut(sent)  # read once on the way there and once on the way back
            steps.append((sent.repartition(min(route.nodes(level), max(parts, FAN)), "node", "part").groupBy("node", "part"), *passing(level)))
            sent = steps[-1][0].applyInArrow(steps[-1][1], f"node long, part long, sender long, {contents}")
        replies = sent.repartition(min(route.nodes(route.levels), max(parts, FAN)), "node", "part").groupBy("node", "part").applyInArrow(answer, reply)
        for own, _, back in reversed(steps):
            above = replies.select(F.col("receiver").alias("node"), F.floor(F.col("part") / route.fan).alias("part"), F.col("part").alias("above"), "masks", "reply")
            replies = own.cogroup(above.groupBy("node", "part")).applyInArrow(back, reply)
        return replies.withColumnRenamed("receiver", "block").repartition(parts, "block")

    @tidy
    def finish(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"id": pa.array([], pa.int64()), "rest": texts.column("rest"), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.binary())})
        block = Block(texts)
        n, removed, spans, gone = remove(block, route, replies_of(replies, False), replies_of(replies, True))
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        if whole_characters:
            kept = [k.decode("utf-8", "ignore").encode() if r else k for k, r in zip(kept, removed.tolist(), strict=True)]
        return pa.table({"id": texts.column("id"), "rest": texts.column("rest"), "n_bytes": pa.array(n), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())})

    reply = "receiver long, part long, masks boolean, reply binary"
    bits = asked(dealt.groupBy("block").applyInArrow(send_keys, "node long, part long, sender long, names binary"), passing_keys, share)
    runs = dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(send_runs, "node long, part long, sender long, lcps binary, rest binary, least binary")
    both = bits.unionByName(asked(runs, passing_runs, mask_runs)).repartition(parts, "block")
    fields = [T.StructField("id", T.LongType()), T.StructField("rest", dealt.schema["rest"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    done = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, T.StructType(fields))
    nothing = hashlib.sha256(b"").hexdigest()
    one = copies.select("id", "rest", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), F.lit(b"").alias("kept"))
    return done.unionByName(one).withColumnRenamed("id", id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """`docs` with repeated passages removed from the texts; documents that become empty go.

    A character that a removal cuts goes as well. `chars_col`, if there is one, follows the text.
    """
    done = dedup(docs, id_col, text_col, whole_characters=True)
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))).withColumn("_text", F.col("kept").cast("string"))
    out = []
    for c in docs.columns:
        if c == id_col:
            out.append(F.col(f"`{id_col}`"))
        elif c == text_col:
            out.append(F.col("_text").alias(c))
        elif c == chars_col:
            out.append(F.char_length("_text").cast("long").alias(c))
        else:
            out.append(F.col("rest").getField(c).alias(c))
    return left.select(*out)
