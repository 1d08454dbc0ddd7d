"""Reassembly of a transaction log: what each transaction leaves, what is undone and by whom, and the store after each epoch.

1. The log is cut by source and blocks of 2^BITS positions into segments. A segment is replayed over a persistent cons list,
   of which a node holds its change and the list before it. A savepoint keeps the list's head; a rollback walks from the
   head and emits until it meets the kept one; an abort walks to the end; a commit publishes the whole list.
2. What a segment can't decide goes out as the list that it leaves: changes above the last kept head (open), and those
   below (sealed, which only the transaction's end reaches). The next segment's first mark decides over the open ones, and its first end
   over the sealed; both are found as running minima over the segments that follow, so no source is one task's.
3. Commits are numbered over all sources by running sums. Published changes are sharded by key: of each key and epoch the last one
   holds, its difference to the key's state before (a running maximum) is added up by epoch, and a running sum gives the states.

Nothing but the two ends of the positions goes to the driver, no join is a broadcast, and a hot source, key or transaction is many tasks'.

Records (source, position, action, key, value); `action` is one of ACTIONS, `value` is a whole number, null deletes the key. Null sources
are one source. Rows with a null position or action, and changes with a null key, are no records. Records of one position
and source keep the order of their values, null first, but those of one position and of several sources are different records. An empty log gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._common import cut
from .running import BITS, ends, running

CHANGE, SAVEPOINT, ROLLBACK, COMMIT, ABORT = ACTIONS = range(5)
#: What a segment says of a change: undone or published by a record of its own, or to be decided by later ones; and its own first marks.
ROLLED, ABORTED, PUBLISHED, OPEN, SEALED, MARKS = range(6)
SEGMENT = pa.schema([("src", pa.string()), ("blk", pa.int64()), ("fate", pa.int8()), ("pos", pa.int64()), ("by", pa.int64()), ("key", pa.int64()), ("value", pa.int64()), ("mark", pa.int8()), ("end", pa.int64()), ("end_mark", pa.int8())])
SEGMENT_DDL = "src string, blk long, fate tinyint, pos long, by long, key long, value long, mark tinyint, end long, end_mark tinyint"


@dataclass(frozen=True)
class Replay:
    """undone (kind, position, by, key), published (key, position, value, epoch), states (epoch, n, total)."""

    undone: DataFrame
    published: DataFrame
    states: DataFrame


class Segment:
    """One segment's replay. The list is nested pairs (list before, change), None at the segment's start or a transaction's."""

    def __init__(self, src: str, blk: int, out: list[tuple]) -> None:
        self.name, self.out = (src, blk), out
        self.head = self.saved = self.mark = self.end = None

    def emit(self, head: tuple | None, until: tuple | None, fate: int, by: int | None) -> None:
        """Walk from `head` and emit changes until the list `until`."""
        while head is not until:
            head, change = head
            self.out.append((*self.name, fate, change[0], by, *change[1:], None, None, None))

    def record(self, pos: int, action: int, key: int | None, value: int | None) -> None:
        if action == CHANGE:
            self.head = (self.head, (pos, key, value))
            return
        self.mark = self.mark or (pos, action)
        if action == SAVEPOINT:
            self.saved = self.head
        elif action == ROLLBACK:
            self.emit(self.head, self.saved, ROLLED, pos)
            self.head = self.saved
        else:
            self.end = self.end or (pos, action)
            self.emit(self.head, None, PUBLISHED if action == COMMIT else ABORTED, pos)
            self.head = self.saved = None

    def close(self) -> None:
        self.emit(self.head, self.saved, OPEN, None)
        self.emit(self.saved, None, SEALED, None)
        pos, mark = self.mark or (None, None)
        self.out.append((*self.name, MARKS, pos, None, None, None, mark, *(self.end or (None, None))))


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay of records that come segment by segment, in order; only the open segment's list outlives a batch."""
    out: list[tuple] = []
    now: Segment | None = None
    for batch in batches:
        for src, blk, pos, action, key, value in zip(*(batch.column(n).to_pylist() for n in ("src", "blk", "pos", "action", "key", "value"))):
            if now is None or now.name != (src, blk):
                if now is not None:
                    now.close()
                now = Segment(src, blk, out)
            now.record(pos, action, key, value)
        if out:
            yield _batch(out)
            out.clear()
    if now is not None:
        now.close()
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SEGMENT)], schema=SEGMENT)


def replay(log: DataFrame, epoch: int = 16) -> Replay:
    """Replay the whole log; every `epoch` commits, empty ones included, end an epoch, and so does the log's end."""
    ship(log.sparkSession)
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    records = log.select(source.alias("src"), F.col("position").cast("long").alias("pos"), F.col("action").cast("tinyint").alias("action"), F.col("key").cast("long").alias("key"), F.col("value").cast("long").alias("value"))
    records = records.where(F.col("pos").isNotNull() & F.col("action").between(CHANGE, ABORT) & ((F.col("action") != CHANGE) | F.col("key").isNotNull()))
    sorted_ones = records.withColumn("blk", F.shiftright("pos", BITS)).repartition("src", "blk").sortWithinPartitions("src", "blk", "pos", F.col("value").asc_nulls_first())
    # Records of other actions are few columns too; commits are read again for their numbers, from the same cut table.
    commit = F.col("action") == COMMIT
    made = cut(sorted_ones.mapInArrow(segments, SEGMENT_DDL))
    between = ends(made.select(F.col("blk")), "blk")
    fates = _decided(made, between)
    commits = cut(_numbered(records.where(commit).select("src", "pos"), epoch))
    published = fates.where(F.col("fate") == PUBLISHED)
    first = commits.groupBy("src", F.col("pos").alias("by")).agg(F.min("number").alias("number"))
    applied = published.join(first.hint("merge"), ["src", "by"]).withColumn("epoch", _epoch(epoch))
    kind = F.when(F.col("fate") == ROLLED, "rollback").otherwise("abort")
    undone = fates.where(F.col("fate") != PUBLISHED).select(kind.alias("kind"), F.col("pos").alias("position"), "by", "key")
    return Replay(undone, applied.select("key", F.col("pos").alias("position"), "value", "epoch"), _states(applied, commits))


def _epoch(size: int) -> Column:
    return F.floor((F.col("number") - 1) / F.lit(size)).cast("long") + 1


def _decided(made: DataFrame, between: tuple[int, int]) -> DataFrame:
    """Rows (src, fate, pos, by, key, value) of all changes: what segments left open is decided by the marks of those that follow."""
    marks = made.where(F.col("fate") == MARKS).select("src", "blk", F.when(F.col("pos").isNotNull(), F.struct("pos", "mark")).alias("mark"), F.when(F.col("end").isNotNull(), F.struct(F.col("end").alias("pos"), F.col("end_mark").alias("mark"))).alias("end"))
    after = running(running(marks, ["src"], "blk", "mark", "min", between, following=True), ["src"], "blk", "end", "min", between, following=True)
    after = after.select("src", "blk", F.col("running_mark").alias("_mark"), F.col("running_end").alias("_end"))
    left = made.where(F.col("fate").isin(OPEN, SEALED)).join(after.hint("merge"), ["src", "blk"], "left")
    rolled = (F.col("fate") == OPEN) & (F.col("_mark.mark") == ROLLBACK)
    fate = F.when(rolled, ROLLED).when(F.col("_end.mark") == COMMIT, PUBLISHED).otherwise(ABORTED)
    late = left.select("src", fate.cast("tinyint").alias("fate"), "pos", F.when(rolled, F.col("_mark.pos")).otherwise(F.col("_end.pos")).alias("by"), "key", "value")
    return made.where(F.col("fate") < OPEN).select(*late.columns).unionByName(late)


def _numbered(commits: DataFrame, epoch: int) -> DataFrame:
    """Commits (src, pos, number, epoch), numbered from 1 by position, ties by source."""
    blocked = commits.withColumn("blk", F.shiftright("pos", BITS))
    counts = blocked.groupBy("blk").agg(F.count("*").alias("n"))
    before = running(counts, [], "blk", "n", "sum", ends(counts, "blk")).select("blk", "running_n")
    rank = F.row_number().over(Window.partitionBy("blk").orderBy("pos", "src"))
    numbered = blocked.withColumn("rank", rank).join(before.hint("merge"), "blk").withColumn("number", F.col("rank") + F.col("running_n"))
    return numbered.select("src", "pos", "number", _epoch(epoch).alias("epoch"))


def _states(applied: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows (epoch, n, total): count and sum of the stored values after each epoch."""
    between = ends(commits, "epoch")
    order = F.struct("number", "pos", "value")
    last = applied.groupBy("key", "epoch").agg(F.max(order)["value"].alias("value")).withColumn("state", F.struct("epoch", "value"))
    before = running(last, ["key"], "epoch", "state", "max", between)
    old = F.col("running_state.value")
    stored = lambda v: v.isNotNull().cast("long")
    amount = lambda v: F.coalesce(v, F.lit(0))
    moves = before.select("epoch", (stored(F.col("value")) - stored(old)).alias("n"), (amount(F.col("value")) - amount(old)).alias("total"))
    each = moves.unionByName(commits.select("epoch", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))).groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    both = running(running(each, [], "epoch", "n", "sum", between, inclusive=True), [], "epoch", "total", "sum", between, inclusive=True)
    return both.select("epoch", F.col("running_n").cast("long").alias("n"), F.col("running_total").cast("long").alias("total"))


def document_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as log records by the checksum of their ids; a change's value is the checksum of `key:text`, none for null or toxic texts.

    Texts don't leave the scan: only ids, sources and checksums are shuffled. Labels may repeat or lack ids.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rest = h % 41
    action = F.when(rest < 2, COMMIT).when(rest < 3, ABORT).when(rest < 5, SAVEPOINT).when(rest < 7, ROLLBACK).otherwise(CHANGE)
    key = F.floor(h / F.lit(100)) % 3000
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("source").cast("string").alias("source"), action.alias("action"), F.when(action == CHANGE, key).alias("key"), F.when(action == CHANGE, F.crc32(F.concat(key.cast("string"), F.lit(":"), "text"))).alias("value"))
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("_toxic")).distinct()
    joined = rows.join(toxic.hint("merge"), rows["doc_id"] == toxic["_toxic"], "left")
    return joined.select("source", F.col("doc_id").alias("position"), "action", "key", F.when(F.col("_toxic").isNull(), F.col("value")).alias("value"))
