"""Running sums, minima and maxima over very long orders, by a tree of short windows.

A window over one key is one task's work however long the key is. Here positions (whole numbers) are cut in blocks of
2^BITS: a window runs inside each block, each block's total is a row of the next level, and what lies before a block is
joined back. No window holds more than 2^BITS positions of a key, and nothing goes to the driver but the two ends of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block, as a power of two.
BITS = 10


def ends(rows: DataFrame, position: str) -> tuple[int, int]:
    """Least and greatest position, 0 and 0 where there is none."""
    low, high = rows.agg(F.min(position), F.max(position)).first()
    return (0, 0) if low is None else (low, high)


def running(rows: DataFrame, keys: Sequence[str], position: str, value: str, how: str, between: tuple[int, int], following: bool = False, inclusive: bool = False) -> DataFrame:
    """`rows` with `running_<value>`: the sum, min or max of `value` at the positions before (or after) each row's own of its keys.

    Keys and positions are unique together and not null; `between` bounds the positions. Null values don't count; without a
    value the sum is 0, a minimum or maximum null. Values of minima and maxima may be structs.
    """
    out = f"running_{value}"
    total = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    low, high = (x >> BITS for x in between)
    block = F.shiftright(position, BITS) - F.lit(low)  # from 0 on, so that the levels end
    order = F.col(position).desc() if following else F.col(position).asc()
    window = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = rows.withColumn("_block", block).withColumn(out, total(value).over(window))
    if low != high:
        totals = rows.groupBy(*keys, block.alias("_at")).agg(total(value).alias("_total"))
        before = running(totals, keys, "_at", "_total", how, (0, high - low), following)
        before = before.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_at").alias("_of_block"), F.col("running__total").alias("_before"))
        on = own["_block"] == before["_of_block"]
        for k in keys:
            on = on & (own[k] == before[f"_of_{k}"])
        own = own.join(before.hint("merge"), on, "left").withColumn(out, _both(F.col(out), F.col("_before"), how))
    return own.select(*rows.columns, F.coalesce(out, F.lit(0)).alias(out) if how == "sum" else F.col(out))


def _both(a: Column, b: Column, how: str) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if how == "min" else F.greatest(a, b)
