"""Deltas, deduplication and versions: one window or one join each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading characters of a hexadecimal hash by which one key's new rows are ranked in parts, and so many parts.
PREFIX, PARTS = 3, 16**3


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; WindowGroupLimit keeps one row a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return first_per(df, keys, F.col(ordinal).desc_nulls_last())


def latest(df: DataFrame, key: str, version: str, *tie: str) -> DataFrame:
    """The row of each key's highest version."""
    return first_per(df, [key], F.col(version).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie])


def previous_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.withColumn("previous_version", F.lag(version).over(Window.partitionBy(key).orderBy(F.col(version).asc_nulls_first())))


def mark_latest(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.withColumn("latest", F.col(version) == F.max(version).over(Window.partitionBy(key)))


def delta(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str, ordinal: str | None = None) -> DataFrame:
    """Rows of `current` that are new or whose value differs. Keys match null-safely; of equal previous keys the last wins.

    With `ordinal` the previous side is reduced to its last row per key first. What is only in
    `previous` never appears.
    """
    old = last_wins(previous, keys, ordinal) if ordinal else previous
    old = old.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(value).alias("_old"), F.lit(True).alias("_seen"))
    same = [current[k].eqNullSafe(old[f"_p_{k}"]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = current.join(old, on, "left")
    return joined.where(F.col("_seen").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).select(*[current[c] for c in current.columns])


def deleted(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Optional: keys that vanished."""
    return previous.join(current, list(keys), "left_anti")


def matching(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the keys; on the right they have a prefix."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys])


def lookup_with_fallback(df: DataFrame, known: DataFrame, exact: Sequence[str], loose: Sequence[str], values: Sequence[str], *order: Column) -> DataFrame:
    """`df` with `found` (a struct of `values`, or null): of the row under the exact key, else under the loose key.

    Keys match null-safely. Of several rows under one key the last in the given order holds, as in an index that is filled in it.
    """
    rows = known.withColumn("_value", F.struct(*values))
    sides = []
    for keys, prefix in ((exact, "_e_"), (loose, "_l_")):
        last = first_per(rows, keys, *[o.desc_nulls_last() for o in order])
        sides.append(last.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], F.col("_value").alias(f"{prefix}value")))
    joined = df.join(sides[0], matching(df, sides[0], exact, "_e_"), "left").join(sides[1], matching(df, sides[1], loose, "_l_"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("_e_value", "_l_value").alias("found"))


def assign_version(incoming: DataFrame, stored: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Incoming rows whose (key, hash) no version has, with the next versions of their key, in the order of the hash.

    Keys and hashes match null-safely, a null hash comes first; repeated rows of one hash get one version. A source with very many new hashes is
    ranked by parts: hashes are counted for each prefix, the counts before a prefix are summed over at most `PARTS` rows a
    key, and only rows of one prefix are ranked together.
    """
    keys = [key, hash_col]
    top = stored.groupBy(F.col(key).alias(f"_t_{key}")).agg(F.max("version").alias("_top"))
    have = stored.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct()
    new = incoming.join(have, matching(incoming, have, keys, "_h_"), "left_anti")
    part = F.coalesce(F.substring(hash_col, 1, PREFIX), F.lit(""))
    counts = new.select(*keys, part.alias("_part")).distinct().groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.withColumn("_before", before)
    offsets = numbered.join(top, matching(numbered, top, [key], "_t_"), "left").select(F.col(key).alias(f"_o_{key}"), F.col("_part").alias("_o__part"), "_before", "_top")
    rank = F.dense_rank().over(Window.partitionBy(key, "_part").orderBy(F.col(hash_col).asc_nulls_first()))
    ranked = new.withColumn("_part", part).withColumn("_rank", rank)
    done = ranked.join(offsets, matching(ranked, offsets, [key, "_part"], "_o_"))
    return done.select(*[ranked[c] for c in incoming.columns], (F.coalesce("_top", F.lit(0)) + F.col("_before") + F.col("_rank")).cast("int").alias("version"))


def merge_ranked(arms: Sequence[DataFrame], keys: Sequence[str], position: str, limit: int) -> DataFrame:
    """Result lists one after another; the first row of each key stays, with ids cf1, cf2, ... by rank."""
    both = None
    for k, arm in enumerate(arms):
        arm = arm.withColumn("_arm", F.lit(k))
        both = arm if both is None else both.unionByName(arm)
    top = first_per(both, keys, F.col("_arm"), F.col(position)).orderBy("_arm", position, *keys).limit(limit)
    rank = F.row_number().over(Window.orderBy("_arm", position, *keys))  # of `limit` rows
    return top.withColumn("cf_id", F.concat(F.lit("cf"), rank)).drop("_arm")


def append_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """`stored` and the incoming rows whose null-safe key it lacks, each key once: the first in the order, if one is given."""
    tagged = stored.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    once = first_per(incoming, keys, *order) if order else incoming.dropDuplicates(list(keys))
    return stored.unionByName(once.join(tagged, matching(once, tagged, keys, "_k_"), "left_anti"))


def replace_keys(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: incoming rows take the place of stored rows with their keys, which match null-safely."""
    new = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    return stored.join(new, matching(stored, new, keys, "_k_"), "left_anti").unionByName(incoming)
