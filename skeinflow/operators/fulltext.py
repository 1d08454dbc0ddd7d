"""English full text: web-style queries over texts, or over a positional inverted index of them.

Words are joined by and, `or` separates alternatives, `-word` excludes, quotes (and hyphens) make a phrase. Words are compared by their stems;
stop words are left out but keep their places, so that a phrase's words stand as far apart as in the query. A query of stop words or marks
alone finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.english import lexeme, lexemes, query_lexemes, words
from ..session import ship

#: Texts whose words are gone through together.
ROWS = 500
#: A phrase: whether it is excluded, and its stems with their places from the first on.
Part = tuple[bool, tuple[tuple[int, str], ...]]


def parse(query: str) -> list[list[Part]]:
    """A query's alternatives, each a list of parts that must all hold."""
    options: list[list[Part]] = []
    for option in re.split(r"""\s+or\s+(?=(?:[^"]*"[^"]*")*[^"]*$)""", query.strip(), flags=re.IGNORECASE):
        parts: list[Part] = []
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', option):
            kept = [(i, t) for i, t in enumerate(query_lexemes(phrase or word)) if t is not None]
            if kept:
                parts.append((bool(minus), tuple((i - kept[0][0], t) for i, t in kept)))
        if parts:
            options.append(parts)
    return options


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def full_text(df: DataFrame, fields: Sequence[str], query: str) -> DataFrame:
    """Rows whose fields, one after another, match; each text's words are cut once however many conditions read them."""
    options = parse(query)
    if not options:
        return df.limit(0)
    ship(df.sparkSession)
    terms = F.col("_terms")

    def holds(part: Part) -> Column:
        minus, phrase = part
        if len(phrase) == 1:
            hit = F.exists(terms, lambda x: x.eqNullSafe(F.lit(phrase[0][1])))
        else:
            starts = F.filter(F.transform(terms, lambda x, i: F.when(x == phrase[0][1], i)), lambda i: i.isNotNull())
            hit = F.exists(starts, lambda i: _all([F.get(terms, i + k).eqNullSafe(F.lit(t)) for k, t in phrase[1:]]))
        return ~hit if minus else hit

    initials = {t[0] for parts in options for _, phrase in parts for _, t in phrase}
    found = df.withColumn("_terms", lexemes(F.concat_ws(" ", *[F.col(f) for f in fields]), initials))
    return found.where(_any([_all([holds(p) for p in parts]) for parts in options])).drop("_terms")


def index(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Postings (term, key, positions): each text's stems with their places. A row's postings are made in its own task, without a shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                lists = part.column(1)
                found = lists.flatten().dictionary_encode()
                stems = [lexeme(w) for w in found.dictionary.to_pylist()]  # each word of the texts once
                terms = sorted({t for t in stems if t is not None})
                number = {t: k for k, t in enumerate(terms)}
                of_word = np.array([number.get(t, -1) for t in stems], np.int64)
                term = of_word[found.indices.to_numpy()] if len(stems) else np.zeros(0, np.int64)
                size = lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(len(lists)), size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                kept = np.flatnonzero(term >= 0)
                kept = kept[np.lexsort((place[kept], term[kept], row[kept]))]
                row, term, place = row[kept], term[kept], place[kept]
                first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(term, prepend=-1).astype(bool))
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(term[first])), part.column(0).take(pa.array(row[first])), positions], names=["term", key, "positions"])

    texts = df.select(F.col(key), words(F.concat_ws(" ", *[F.col(f) for f in fields])).alias("_words"))
    return texts.mapInArrow(run, f"term string, `{key}` {dict(df.dtypes)[key]}, positions array<int>")


def write_index(df: DataFrame, key: str, fields: Sequence[str], path: str) -> None:
    """The index as Parquet in the order of its terms, so that a query's terms prune files and row groups. A term of very many texts spans files."""
    index(df, key, fields).repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(path)


def search(postings: DataFrame, keys: DataFrame, key: str, query: str) -> DataFrame:
    """Keys of the texts that match. Only the query's terms are read; `keys` (all texts' keys) is read where an alternative excludes only."""
    options = parse(query)
    if not options:
        return keys.select(key).limit(0)
    terms = sorted({t for parts in options for _, phrase in parts for _, t in phrase})
    # of a text at most as many rows as the query has terms
    places = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    rows = postings.where(F.col("term").isin(terms)).groupBy(key).agg(places.alias("_at"))
    if any(all(minus for minus, _ in parts) for parts in options):
        rows = keys.select(key).distinct().join(rows, key, "left")
    at = lambda t: F.coalesce(F.try_element_at("_at", F.lit(t)), F.array().cast("array<int>"))

    def holds(part: Part) -> Column:
        minus, phrase = part
        first = at(phrase[0][1])
        hit = F.exists(first, lambda i: _all([F.array_contains(at(t), i + k) for k, t in phrase[1:]])) if len(phrase) > 1 else F.size(first) > 0
        return ~hit if minus else hit

    return rows.where(_any([_all([holds(p) for p in parts]) for parts in options])).select(key)
