"""Annotation, consolidation, revisions, assets and status: DataFrames in, DataFrames out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import path_label
from ..functions.text import STATUS_ORDER, blank_to_null, chunks, geo_group_of_locale, geo_rank, status_alias
from ..session import ship
from .versions import append_absent, first_per, matching

ANNOTATION = "struct<summary:string,keywords:array<string>,sentiment:string,classification:string,tags:array<string>,error:string>"


def status_counts(df: DataFrame, status: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.upper(status).alias("status")).agg(F.count("*").alias("n"))


def final_status(df: DataFrame, status: str, ready: Column, *keys: str) -> DataFrame:
    """The decision table over successes, skips and errors of each key."""
    s = F.upper(F.coalesce(F.col(status), F.lit("")))
    flag = lambda c: F.sum(c.cast("long"))
    counted = df.groupBy(*keys).agg(flag(s == "ENRICHED").alias("n_success"), flag(F.contains(s, F.lit("SKIPPED"))).alias("n_skipped"), flag(F.startswith(s, F.lit("ERROR"))).alias("n_error"), F.max(ready.cast("int")).alias("_ready"))
    some = F.col("n_success") + F.col("n_skipped") > 0
    done = F.when(~some, "ENRICHMENT_FAILED").when((F.col("n_error") > 0) | (F.col("_ready") == 0), "PARTIALLY_ENRICHED").otherwise("ENRICHED_COMPLETE")
    return counted.withColumn("final_status", done).drop("_ready")


def without_chunks(sections: DataFrame, chunk_rows: DataFrame, key: str) -> DataFrame:
    return sections.join(chunk_rows.select(key).distinct(), key, "left_anti")


def chunk_rows(sections: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, position, chunk_text); a text that a section repeats is kept once."""
    rows = sections.select(key, F.posexplode(F.array_distinct(chunks(F.col(text)))).alias("position", "chunk_text"))
    return rows


def usage_fanout(elements: DataFrame, usages: DataFrame, keys: list[str], usage: str, default: str) -> DataFrame:
    """Each element once for each distinct usage path of its key, or with its own default. Keys match null-safely."""
    known = usages.where(blank_to_null(F.col(usage)).isNotNull()).select(*[F.col(k).alias(f"_u_{k}") for k in keys], F.col(usage).alias("_usage")).distinct()
    return elements.join(known, matching(elements, known, keys, "_u_"), "left").withColumn(usage, F.coalesce("_usage", F.col(default))).drop("_usage", *[f"_u_{k}" for k in keys])


def consolidate(elements: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    return append_absent(sections, elements, keys)


def save_annotated(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], always: Sequence[str] = ()) -> DataFrame:
    """Upsert of annotations; keys match null-safely, and all columns of `stored` stay.

    Columns `values` of `incoming` are taken over but where a user has overridden them, which is marked as having a
    newer annotation instead; columns `always` are taken over in any case. New keys have null in the other columns.
    """
    new = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_n_{v}") for v in (*values, *always)], F.lit(True).alias("_new"))
    old = stored.withColumn("_old", F.lit(True))
    both = old.join(new, matching(old, new, keys, "_k_"), "full")
    held, newer = F.coalesce("user_override_active", F.lit(False)), F.coalesce("_new", F.lit(False))
    out = {k: F.when(F.col("_old"), F.col(k)).otherwise(F.col(f"_k_{k}")) for k in keys}
    out |= {v: F.when(newer & ~held, F.col(f"_n_{v}")).otherwise(F.col(v)) for v in values}
    out |= {v: F.when(newer, F.col(f"_n_{v}")).otherwise(F.col(v)) for v in always}
    out["user_override_active"] = held
    out["new_ai_available"] = F.when(newer, held).otherwise(F.coalesce("new_ai_available", F.lit(False)))
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in stored.columns])


def append_revisions(revisions: DataFrame, edits: DataFrame, key: str, order: Column) -> DataFrame:
    """Edits with the next revision numbers of their element."""
    top = revisions.groupBy(key).agg(F.max("revision").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return edits.join(top, key, "left").withColumn("revision", (F.coalesce("_top", F.lit(0)) + rank).cast("int")).drop("_top")


def grouped_locales(df: DataFrame, locale: str) -> DataFrame:
    """Locales of each business region, in business order."""
    rows = df.where(F.trim(F.coalesce(F.col(locale), F.lit(""))) != "").select(geo_group_of_locale(F.col(locale)).alias("geo"), F.col(locale).alias("locale"))
    groups = rows.groupBy("geo").agg(F.sort_array(F.collect_set("locale")).alias("locales"))
    return groups.orderBy(geo_rank(F.col("geo")), F.lower("geo"))


def catalog(assets: DataFrame, known: DataFrame, hash_col: str) -> DataFrame:
    """New catalogue rows: each hash once, not those already known."""
    return first_per(assets, [hash_col], F.col("source_uri"), F.col("ordinal")).join(known.select(hash_col), hash_col, "left_anti")


def observe(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Observed keys get seen_count + 1 or enter with 1, and are active; the latest time is kept. Other columns stay.

    Of stored rows with one key the one last seen goes on; the others stay as they are, but no longer active.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("last_seen_at").desc_nulls_last(), F.col("seen_count").desc_nulls_last()))
    ranked = stored.withColumn("_rank", rank)
    now = seen.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("seen_at").alias("_at"))
    both = ranked.join(now, matching(ranked, now, keys, "_k_") & (F.col("_rank") == 1), "full")
    hit = F.col("_at").isNotNull()
    out = {k: F.when(F.col("_rank").isNull(), F.col(f"_k_{k}")).otherwise(F.col(k)) for k in keys}
    out |= {"last_seen_at": F.greatest("last_seen_at", "_at"), "seen_count": F.coalesce("seen_count", F.lit(0)) + hit.cast("long")}
    out["active"] = F.when(hit, True).when(F.col("_rank") > 1, False).otherwise(F.coalesce("active", F.lit(True)) if "active" in stored.columns else F.lit(True))
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in stored.columns])


def element_groups(elements: DataFrame, position: str) -> DataFrame:
    """Rows (group_key, label, n, first_position): elements by path, else by title, else alone, in order of first sight.

    `elements` has path and title. Only counts leave the tasks, so a path that most elements share is no hot group.
    """
    path, title = blank_to_null(F.col("path")), blank_to_null(F.col("title"))
    key = F.coalesce(path, F.concat(F.lit("title:"), F.lower(title)), F.concat(F.lit("group-"), F.col(position)))
    label = F.coalesce(F.when(path.isNotNull(), path_label(path)), F.lower(title), F.concat(F.lit("Element group "), F.col(position) + 1))
    rows = elements.select(key.alias("group_key"), label.alias("label"), F.col(position).alias("_at"))
    grouped = rows.groupBy("group_key").agg(F.min("label").alias("label"), F.count("*").alias("n"), F.min("_at").alias("first_position"))
    return grouped.orderBy("first_position", "group_key")


def status_history(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Rows (key, status, at, place): each state once per key at its first time, in the pipeline's order, then errors, then others by time."""
    known = [*STATUS_ORDER, "ERROR"]
    state = status_alias(F.col(status))
    once = events.where(blank_to_null(F.col(status)).isNotNull()).groupBy(key, state.alias("status")).agg(F.min(at).alias("at"))
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(known)], F.lit(len(known)))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, F.col("at").asc_nulls_last(), "status")))


def partition_queue(items: DataFrame, skip: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skipped, queued, expected): the changed items' two parts, and the number of distinct queued (path, field) per document."""
    queued = items.where(~F.coalesce(skip, F.lit(False)))
    expected = queued.groupBy("source_uri").agg(F.count_distinct("source_path", "item_type").alias("n_expected"))
    return items.where(F.coalesce(skip, F.lit(False))), queued, expected


def embed_offline(text: str, dimension: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding service: signed word hashes."""
    out = [0.0] * dimension
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        out[h % dimension] += 1.0 if h >> 63 else -1.0
    return out


def embed_letters(text: str) -> list[float]:
    """A plainer stand-in: how often each letter from a to z is in the text."""
    low = text.lower()
    return [float(low.count(chr(97 + k))) for k in range(26)]


def annotate_offline(text: str) -> dict:
    """A deterministic stand-in for an annotation service."""
    words = text.split()
    keywords = sorted({w.strip(".,!?").lower() for w in words if len(w) > 6})[:5]
    return {"summary": " ".join(words[:12]), "keywords": keywords, "sentiment": "neutral", "classification": "text", "tags": keywords[:2], "error": None}


def embed(df: DataFrame, text: str, provider: Callable[[str], list[float]] = embed_offline) -> DataFrame:
    """Column `vector` by a provider without cost, in Arrow batches; null where it fails. `services.ask` is for those that are paid, slow or throttled."""
    ship(df.sparkSession)

    def one(x: str | None) -> list[float] | None:
        try:
            return provider(x) if x else None
        except Exception:  # the row has no vector
            return None

    @F.pandas_udf("array<float>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(one)

    return df.withColumn("vector", run(F.col(text)))


def annotate(df: DataFrame, text: str, provider: Callable[[str], dict] = annotate_offline) -> DataFrame:
    """Column `annotation`; a provider's failure is an error in its row, not of the job."""
    ship(df.sparkSession)
    names = ["summary", "keywords", "sentiment", "classification", "tags", "error"]

    @F.pandas_udf(ANNOTATION)
    def run(xs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in xs:
            try:
                rows.append({**dict.fromkeys(names), **(provider(x) if x else {"error": "empty"})})
            except Exception as e:  # the row carries it
                rows.append({**dict.fromkeys(names), "error": str(e)})
        return pd.DataFrame(rows, columns=names)

    return df.withColumn("annotation", run(F.col(text)))


def is_valid(annotation: Column) -> Column:
    """All parts are there and nothing failed."""
    parts = [annotation[n].isNotNull() for n in ("summary", "keywords", "sentiment", "classification", "tags")]
    ok = annotation["error"].isNull()
    for p in parts:
        ok = ok & p
    return ok
