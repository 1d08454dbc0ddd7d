"""Filters, vector top-k, refinement chips and pages."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine_distance, distance_score


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def optional_equal(col: Column, value: str | None) -> list[Column]:
    """Case-insensitive equality, or nothing where the value isn't set."""
    return [] if value is None else [F.lower(col) == value.lower()]


def site_matches(site: Column, paths: Sequence[Column], value: str | None) -> list[Column]:
    """The site itself, or a path with the site as a segment."""
    if value is None:
        return []
    inside = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(p, F.lit(""))), F.lit(f"/{value.lower()}/")) for p in paths])
    return [(F.lower(site) == value.lower()) | inside]


def has_all(xs: Column, needles: Sequence[str], ignore_case: bool = False) -> Column:
    """The array holds all needles; a null array fails."""
    if ignore_case:
        xs, needles = F.transform(xs, F.lower), [n.lower() for n in needles]
    return F.size(F.array_except(F.array(*map(F.lit, needles)), xs)) == 0 if needles else F.lit(True)


def member(json: Column, key: str) -> Column:
    """The text of an object's member. A JSON path can't hold a quote, so such keys are looked up in a map."""
    if "'" in key:
        return F.element_at(F.from_json(json, "map<string,string>"), F.lit(key))
    return F.get_json_object(json, f"$['{key}']")


def json_filters(json: Column, tree: Mapping) -> list[Column]:
    """Scalars compare without case, lists with; nested maps go down. Keys may hold any character."""
    out: list[Column] = []
    for key, value in tree.items():
        at = member(json, str(key))
        if isinstance(value, Mapping):
            out += json_filters(at, value)
        elif isinstance(value, (list, tuple, set)):
            out.append(at.isin(*map(str, value)))
        else:
            out.append(F.lower(F.coalesce(at, F.lit(""))) == str(value).lower())
    return out


def section_matches(key: str | None, contained_in: Sequence[Column], equal_to: Sequence[Column]) -> list[Column]:
    if not key:
        return []
    k = F.lit(key.lower())
    return [reduce(lambda a, b: a | b, [*[F.contains(F.lower(F.coalesce(c, F.lit(""))), k) for c in contained_in], *[F.lower(c) == k for c in equal_to]])]


def unless_absent(col: Column, value: str | None) -> list[Column]:
    """Equal if both sides are there."""
    return [] if value is None else [col.isNull() | (F.lower(col) == value.lower())]


def distances(df: DataFrame, vector: str, query: Sequence[float]) -> DataFrame:
    """`df` with the cosine distance of its vectors. A null vector, or one of another length, has no row. The query's norm is a constant of the plan."""
    q = [float(x) for x in query]
    norm = math.sqrt(sum(x * x for x in q))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == len(q))).withColumn("distance", cosine_distance(F.col(vector), F.array(*map(F.lit, q)), norm))


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, tie: str, filters: Sequence[Column] = (), below: float | None = None) -> DataFrame:
    """The k rows of least cosine distance. Filters come before the ranking; ties go by `tie`; zero vectors come last.

    A null vector, or one of another length, is no neighbour and has no row.
    """
    scored = distances(df.where(every(filters)), vector, query)
    if below is not None:
        scored = scored.where(F.col("distance") < below)
    return scored.orderBy(F.col("distance").asc(), tie).limit(k)


def chips(rows: DataFrame, values: Column, section: str, distance: str) -> DataFrame:
    """Refinement chips (type, value, score, count). `values` is an array of structs (type, value).

    The score adds up over all rows, the count is of distinct sections. One shuffle serves both, and
    partial sums come before it.
    """
    exploded = rows.select(F.col(section).alias("_s"), distance_score(F.col(distance)).alias("_w"), F.explode(values).alias("chip"))
    per_section = exploded.groupBy("chip.type", "chip.value", "_s").agg(F.sum("_w").alias("_w"))
    return per_section.groupBy("type", "value").agg(F.sum("_w").alias("score"), F.count("*").alias("count"))


def ranked_chips(found: DataFrame, limit: int = 15) -> DataFrame:
    return found.orderBy(F.col("score").desc(), "type", "value").limit(min(max(limit, 1), 50))


@dataclass
class Page:
    page: int = 0
    size: int = 20
    count: int = 0
    rows: DataFrame | None = None
    total_pages: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.total_pages = -(-self.count // self.size)


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> Page:
    """A page of the ordered rows; page is 0 at least, size from 1 to 200. The order must be total."""
    page, size = max(page, 0), min(max(size, 1), 200)
    return Page(page, size, df.count(), df.orderBy(*order).offset(page * size).limit(size))


def claim(pending: DataFrame, done: DataFrame, key: str, text: str, saved_at: str, limit: int) -> DataFrame:
    """The longest waiting rows with text and no counterpart in `done`; rows without a time come last."""
    open_rows = pending.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").join(done.select(key).distinct(), key, "left_anti")
    return open_rows.orderBy(F.col(saved_at).asc_nulls_last(), key).limit(limit)
