"""The ingest run: versions of raw documents, their items, what changed, the hashes to keep, and the status of each document.

Tables: raw (source_uri, version, content_hash, json), items (`json_items.ITEM_SCHEMA` with version), hashes (source_path,
item_type, usage_path, content_hash, context_hash) and version_hashes (the same with source_uri and version in front).
A run takes any number of documents at once; each is judged by its own source and version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..sources import json_items
from . import store
from .versions import assign_version, delta, first_per, lookup_with_fallback, matching, replace_keys

KEYS = ["source_path", "item_type", "usage_path"]
HASHES = ["content_hash", "context_hash"]
BACKFILL = ("raw_text", "raw_binary", "content_type", "source_metadata", "request_metadata")


@dataclass(frozen=True)
class Run:
    """What a run gives: all items, those to process, the tables of hashes after it, and one status row a document."""

    items: DataFrame
    changed: DataFrame
    hashes: DataFrame
    version_hashes: DataFrame
    cleansed: DataFrame


def stored_text(text: Column, binary: Column) -> Column:
    """The document that a raw row keeps: its text, or else its bytes as UTF-8."""
    return F.coalesce(F.when(blank_to_null(text).isNotNull(), text), F.decode(binary, "UTF-8"))


def receive(documents: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents (source_uri, json) that are new for their source, with content_hash and the next version."""
    hashed = first_per(documents.withColumn("content_hash", F.sha2("json", 256)), ["source_uri", "content_hash"], F.col("json"))
    return assign_version(hashed, raw, "source_uri", "content_hash")


def backfill(raw: DataFrame, again: DataFrame) -> DataFrame:
    """Stored rows get what they lack (null; of the request also blank) from a repeated upload of the same (source_uri, content_hash)."""
    keys = ["source_uri", "content_hash"]
    columns = [c for c in BACKFILL if c in raw.columns and c in again.columns]
    given = first_per(again, keys, *[F.col(c).asc_nulls_last() for c in columns]).select(*keys, *[F.col(c).alias(f"_g_{c}") for c in columns])
    joined = raw.join(given, keys, "left")
    have = {c: blank_to_null(F.col(c)) if c == "request_metadata" else F.col(c) for c in columns}
    return joined.select(*[F.coalesce(have[c], F.col(f"_g_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in raw.columns])


def extract(raw: DataFrame) -> DataFrame:
    """Items of raw documents (source_uri, version, json), with the version."""
    return json_items.extract_items(raw.withColumn("version", F.col("version").cast("int")), "version int")


def _keyed(items: DataFrame) -> DataFrame:
    """Items that have a key; a usage path that is missing counts as empty."""
    return items.where("source_path is not null and item_type is not null").withColumn("usage_path", F.coalesce("usage_path", F.lit("")))


def _differs(use_context: bool) -> Column:
    """Whether an item's hashes differ from `found`, or there is nothing to compare with."""
    differ = ~F.col("content_hash").eqNullSafe(F.col("found.content_hash"))
    if use_context:
        differ = differ | ~F.col("context_hash").eqNullSafe(F.col("found.context_hash"))
    return F.col("found").isNull() | differ


def changed_since(items: DataFrame, previous: DataFrame, use_context: bool = False) -> DataFrame:
    """Items that are new, or differ from the previous version's items or hashes of the same source; of repeated previous keys the last holds."""
    keys = ["source_uri", *KEYS]
    last = _keyed(previous)
    last = first_per(last, keys, F.col("ordinal").desc_nulls_last()) if "ordinal" in previous.columns else last
    last = last.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.struct(*HASHES).alias("found"))
    now = _keyed(items)
    return now.join(last, matching(now, last, keys, "_p_"), "left").where(_differs(use_context)).select(*items.columns)


def changed_globally(items: DataFrame, hashes: DataFrame, strict: bool = False, use_context: bool = False) -> DataFrame:
    """Items that differ from the hash under their key or, unless `strict`, else under path and type alone."""
    known, now = _keyed(hashes), _keyed(items)
    found = lookup_with_fallback(now, known, KEYS, KEYS if strict else KEYS[:2], HASHES, F.col("usage_path"))
    return found.where(_differs(use_context)).select(*items.columns)


def kept_hashes(hashes: DataFrame, items: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The table with the items' hashes in place of those under their keys; of repeated keys the last item holds."""
    rows = _keyed(items)
    last = first_per(rows, keys, F.col("ordinal").desc_nulls_last()) if "ordinal" in items.columns else rows
    return replace_keys(hashes.withColumn("usage_path", F.coalesce("usage_path", F.lit(""))), last.select(*hashes.columns), keys)


def hash_table(spark: SparkSession, path: str, buckets: int = 64) -> store.KeyedTable:
    """The table of global hashes, kept by key: a run rewrites only the buckets of the keys that it touches."""
    return store.KeyedTable(spark, path, ", ".join(f"{c} string" for c in (*KEYS, *HASHES)), tuple(KEYS), buckets)


def save_hashes(table: store.KeyedTable, items: DataFrame) -> int:
    """The items' hashes take the place of those under their keys; of repeated keys the last item holds."""
    rows = _keyed(items)
    last = first_per(rows, KEYS, F.col("ordinal").desc_nulls_last()) if "ordinal" in items.columns else rows
    return table.upsert(last.select(*KEYS, *HASHES))


#: What the items of a document are compared with: nothing, the hashes kept of the version before, its stored document, or the global hashes.
ALL, KEPT, STORED, GLOBAL = range(4)


def _tagged(current: DataFrame, raw: DataFrame, version_hashes: DataFrame, full: bool) -> DataFrame:
    """Documents to walk (source_uri, json, version, mode, prev), in one exchange by source: the current ones, and for those that are compared with
    it (STORED) the document of the version before, which has a null mode."""
    none = F.lit(None).cast("string")
    rows = current.select("source_uri", "version", "json", F.lit("now").alias("tag"))
    rows = rows.unionByName(raw.select("source_uri", "version", "json", F.lit("raw").alias("tag")))
    rows = rows.unionByName(version_hashes.select("source_uri", "version").distinct().select("*", none.alias("json"), F.lit("hash").alias("tag")))
    source = Window.partitionBy("source_uri")
    tagged = lambda tag, value: F.when(F.col("tag") == tag, value)
    rows = rows.withColumn("now", F.max(tagged("now", F.col("version"))).over(source))
    rows = rows.withColumn("prev", F.max(F.when(F.col("version") < F.col("now"), tagged("raw", F.col("version")))).over(source))
    is_prev = F.col("version") == F.col("prev")
    usable = is_prev & blank_to_null(F.col("json")).isNotNull()
    rows = rows.withColumn("hashed", F.max(tagged("hash", is_prev)).over(source)).withColumn("stored", F.max(tagged("raw", usable)).over(source))
    mode = F.when(F.lit(full) | (F.col("version") == 1), ALL).when(F.col("hashed"), KEPT).when(F.col("stored"), STORED).otherwise(GLOBAL)
    walked = (F.col("tag") == "now") | (F.col("tag") == "raw") & usable & ~F.coalesce("hashed", F.lit(False)) & ~(F.lit(full) | (F.col("now") == 1))
    return rows.where(walked).select("source_uri", "json", F.col("version").cast("int").alias("version"), F.when(F.col("tag") == "now", mode).cast("int").alias("mode"), F.col("prev").cast("int").alias("prev"))


def run(current: DataFrame, raw: DataFrame, hashes: DataFrame, version_hashes: DataFrame, full: bool = False, strict: bool = False, use_context: bool = False, at: Column | None = None) -> Run:
    """One ingest run over `current` (source_uri, version, json), one document a source.

    Version 1, or any with `full`, gives all items. Others are compared with the hashes kept of the version before,
    where there are some; else with the items of the stored document of that version; else (nothing stored, or
    blank) with the global hashes. Documents without a change, and those that aren't JSON, are named in `cleansed`.

    All documents are walked once, in one pass, and their items written to the shared folder. All baselines are one union, of which
    partial sums find the row of each key (of repeated ones the last) before the shuffle; items meet it once, and once more under the global hashes' path and type.
    """
    documents = _tagged(current, raw, version_hashes, full)
    walked = store.kept(json_items.extract_items(documents, "version int, mode int, prev int"))
    now = walked.where("mode is not null")
    columns = [c for c in walked.columns if c not in ("mode", "prev")]
    items = now.select(*columns)
    touched = documents.where(F.col("mode") == KEPT).select("source_uri", F.col("prev").alias("version"))
    found = F.struct(F.col("at"), *HASHES)
    scoped = lambda df, scope, at: _keyed(df).select(scope.alias("scope"), *KEYS, *HASHES, at.cast("long").alias("at"))
    base = scoped(version_hashes.join(touched, ["source_uri", "version"], "left_semi"), F.col("source_uri"), F.lit(0))
    base = base.unionByName(scoped(walked.where("mode is null"), F.col("source_uri"), F.col("ordinal"))).unionByName(scoped(hashes, F.lit(None).cast("string"), F.lit(0)))
    exact = base.groupBy(*[F.col(k).alias(f"_e_{k}") for k in ("scope", *KEYS)]).agg(F.max(found).alias("_exact"))
    probed = now.withColumn("usage_path_", F.coalesce("usage_path", F.lit(""))).withColumn("scope", F.when(F.col("mode").isin(KEPT, STORED), F.col("source_uri")))
    on = (F.col("source_path") == F.col("_e_source_path")) & (F.col("item_type") == F.col("_e_item_type")) & (F.col("usage_path_") == F.col("_e_usage_path")) & F.col("scope").eqNullSafe(F.col("_e_scope"))
    joined = probed.join(exact, on, "left")
    if strict:
        joined = joined.withColumn("found", F.col("_exact"))
    else:
        order = F.struct(F.col("usage_path").alias("at"), *HASHES)
        loose = _keyed(hashes).groupBy(*[F.col(k).alias(f"_l_{k}") for k in KEYS[:2]]).agg(F.max(order).alias("_loose"))
        near = (F.col("mode") == GLOBAL) & F.col("_exact").isNull() & (F.col("source_path") == F.col("_l_source_path")) & (F.col("item_type") == F.col("_l_item_type"))
        pick = lambda s: F.struct(*[F.col(s)[h].alias(h) for h in HASHES])
        joined = joined.join(loose, near, "left").withColumn("found", F.when(F.col("_exact").isNotNull(), pick("_exact")).when(F.col("_loose").isNotNull(), pick("_loose")))
    keyed = F.col("source_path").isNotNull() & F.col("item_type").isNotNull()
    differ = joined.where((F.col("mode") == ALL) | keyed & _differs(use_context))
    usage = F.when(F.col("mode") == ALL, F.col("usage_path")).otherwise(F.col("usage_path_"))
    changed = differ.select(*[usage.alias(c) if c == "usage_path" else F.col(c) for c in columns])
    return Run(items, changed, kept_hashes(hashes, items), kept_hashes(version_hashes, items, ["source_uri", "version", *KEYS]), statuses(current, changed, at))


def statuses(current: DataFrame, changed: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows (source_uri, version, status, error, n_items, cleansed_at): pending annotation, unchanged, or not readable."""
    counted = changed.groupBy("source_uri").agg(F.count("*").alias("n_items"))
    rows = current.join(counted, "source_uri", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    readable = F.try_parse_json("json").isNotNull()
    status = F.when(~F.coalesce(readable, F.lit(False)), "EXTRACTION_FAILED").when(F.col("n_items") == 0, "PROCESSED_NO_CHANGES").otherwise("CLEANSED_PENDING_ENRICHMENT")
    error = F.when(status == "EXTRACTION_FAILED", "ExtractionError: not JSON")
    return rows.select("source_uri", "version", status.alias("status"), error.alias("error"), "n_items", (at if at is not None else F.current_timestamp()).alias("cleansed_at"))


def refresh(cleansed: DataFrame, done: DataFrame) -> DataFrame:
    """A resumed run takes the place of the stored rows of its sources (status, version, time, items), whose other columns stay.

    A run without a change leaves its rows as they are.
    """
    columns = [c for c in done.columns if c != "source_uri" and c in cleansed.columns]
    new = done.where("status <> 'PROCESSED_NO_CHANGES'").select("source_uri", *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = cleansed.join(new, "source_uri", "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in cleansed.columns])


def replay(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored documents (source_uri, version, json) of the latest versions of `sources` (source_uri), to be run again."""
    wanted = first_per(raw.join(sources.select("source_uri").distinct(), "source_uri", "left_semi"), ["source_uri"], F.col("version").desc())
    json = stored_text(F.col("raw_text"), F.col("raw_binary"))
    return wanted.select("source_uri", "version", json.alias("json")).where(blank_to_null(F.col("json")).isNotNull())


def delta_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The plain delta of two item tables by their key and content hash."""
    return delta(_keyed(current), _keyed(previous), KEYS, "content_hash", "ordinal" if "ordinal" in previous.columns else None)
