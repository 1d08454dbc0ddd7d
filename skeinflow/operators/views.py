"""What readers ask of the tables: rows of items, a job's context, the plain search endpoint, sections of a page, locales."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import lifecycle as L
from . import search as S
from .fulltext import full_text
from .refine import SECTION_KEY
from .versions import first_per

#: The search endpoint's fixed number of results.
SEARCH_LIMIT = 200


def item_rows(items: DataFrame) -> DataFrame:
    """Rows (field, original, cleansed) for display; a field without a name is called unknown."""
    have = lambda *names: [F.col(n) for n in names if n in items.columns]
    field = F.coalesce(*have("original_field_name", "item_type"), F.lit("Unknown field"))
    return items.select(*[c for c in ("source_uri", "ordinal") if c in items.columns], field.alias("field"), F.col("original_value").alias("original"), F.coalesce(*have("cleansed_value", "cleansed")).alias("cleansed"))


def visible_items(items: DataFrame, prefixes: Sequence[str] = X.EXCLUDED) -> DataFrame:
    """Items that are neither marked to be skipped nor of an excluded type."""
    return items.where(~F.coalesce("skip_enrichment", F.lit(False)) & ~X.is_excluded(F.coalesce("item_type", F.lit("")), prefixes))


def search(chunks: DataFrame, sections: DataFrame, query: Sequence[float], field: str | None = None, tags: Sequence[str] = (), keywords: Sequence[str] = (), context: Mapping | None = None) -> DataFrame:
    """The search endpoint: the nearest chunks' sections (cleansed_text, source_field_name, section_path), nearest first."""
    s = sections.select(F.col("id").alias("section_id"), "cleansed_text", F.col("original_field_name").alias("source_field_name"), F.col("section_uri").alias("section_path"), "tags", "keywords", "context")
    rows = chunks.join(s, "section_id")
    wanted = [*S.optional_equal(F.col("source_field_name"), field), S.has_all(F.col("tags"), tags), S.has_all(F.col("keywords"), keywords), *S.json_filters(F.col("context"), context or {})]
    near = S.nearest(rows, "vector", query, SEARCH_LIMIT, "chunk_id", wanted)
    return near.select("chunk_id", "distance", "cleansed_text", "source_field_name", "section_path").orderBy("distance", "chunk_id")


def page_sections(sections: DataFrame, page: str, limit: int) -> DataFrame:
    """Sections of a page, by its name in the context or as a segment of their path, latest first."""
    named = [F.lower(F.coalesce(F.get_json_object("context", p), F.lit(""))) == page.lower() for p in ("$.facets.pageId", "$.pageId", "$.envelope.pageId")]
    inside = F.contains(F.lower(F.coalesce("section_path", F.lit(""))), F.lit(f"/{page.lower()}/"))
    return sections.where(named[0] | named[1] | named[2] | inside).orderBy(F.col("saved_at").desc_nulls_last(), "id").limit(max(1, limit))


def discovered_sections(sections: DataFrame, page: str, limit: int) -> DataFrame:
    """Rows (section_key, rank): distinct section keys among a page's sections, in the order of their latest section."""
    found = page_sections(sections, page, limit * 4)
    key = F.coalesce(F.get_json_object("context", "$.facets.sectionKey"), X.section_key(F.col("section_path")), X.section_key(F.col("section_uri")))
    keyed = found.select(F.lower(key).alias("section_key"), "saved_at", "id").where(X.blank_to_null(F.col("section_key")).isNotNull())
    first = first_per(keyed, ["section_key"], F.col("saved_at").desc_nulls_last(), F.col("id"))
    return first.orderBy(F.col("saved_at").desc_nulls_last(), "id").select("section_key").limit(limit)


def prompt_search(message: str, chunks: DataFrame, sections: DataFrame, embed: Callable[[str], Sequence[float]], interpretation: Mapping | None = None, role: str | None = None, limit: int = 15) -> DataFrame:
    """The prompt's search, rows (id, original_field_name, section_path, cleansed_text, rank).

    A section that the interpretation or the message names gives its own sections, latest first: all up to the limit, or the
    first whose field holds the role, if the caller or the message (`role for ... section`) asks for one that is there.
    Without a section the nearest chunks' sections come, of the hinted role if there is a hint; if none does, those that the
    message matches as text.
    """
    made = interpretation or {}
    key = ((made.get("context") or {}).get("facets") or {}).get("sectionKey") or next((m[0] for m in [SECTION_KEY.search(message)] if m), None)
    shown = ["id", "original_field_name", "section_path", "cleansed_text"]
    rank = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  (of `limit` rows)
    if key:
        key = key.strip().lower()
        told = re.search(rf"(?i)\b(?:give\s+me\s+)?([a-z0-9_-]+)\s+(?:for|of)\s+.*{re.escape(key)}\b", message)
        wanted = role or (told and told[1])
        latest = [F.col("saved_at").desc_nulls_last(), F.col("id")]
        rows = sections.where(F.lower(F.get_json_object("context", "$.facets.sectionKey")) == key).orderBy(*latest).limit(50 if wanted else limit)
        if wanted:
            hit = F.contains(F.lower(F.coalesce("original_field_name", F.lit(""))), F.lit(wanted.lower()))
            one = Window.partitionBy(hit).orderBy(*latest)  # of 50 rows
            rows = rows.withColumn("_hit", hit).withColumn("_some", F.max("_hit").over(Window.partitionBy())).withColumn("_nth", F.row_number().over(one))
            rows = rows.where(~F.col("_some") | (F.col("_hit") & (F.col("_nth") == 1))).orderBy(*latest).limit(limit)
        return rows.select(*shown, rank(*latest).alias("rank"))
    hint = role or made.get("original_field_name")
    holds = F.contains(F.lower(F.coalesce("original_field_name", F.lit(""))), F.lit(hint.lower())) if hint else F.lit(True)
    near = S.nearest(chunks, "vector", embed(made.get("query") or message), limit, "chunk_id").select("chunk_id", F.col("section_id").alias("id"), "distance")
    found = near.join(sections, "id").where(holds)
    if not found.isEmpty():
        return found.select(*shown, rank("distance", "chunk_id").alias("rank"))
    texts = full_text(sections, ["cleansed_text", "original_field_name"], made.get("query") or message)
    return texts.orderBy("id").limit(max(2 * limit, 50)).select(*shown, rank("id").alias("rank"))


def locale_snapshot(cleansed: DataFrame, raw: DataFrame, of_items: DataFrame, of_metadata: DataFrame) -> DataFrame:
    """Rows (id, locale, page_id) of jobs: from their items' contexts (id, locale, page_id), else from their raw row's metadata (raw_id, locale, page_id)."""
    joined = cleansed.select("id", "raw_id").join(of_items.select("id", F.col("locale").alias("_l"), F.col("page_id").alias("_p")), "id", "left")
    joined = joined.join(raw.select(F.col("id").alias("raw_id")).join(of_metadata, "raw_id"), "raw_id", "left")
    return joined.select("id", X.first_filled(F.col("_l"), F.col("locale")).alias("locale"), X.first_filled(F.col("_p"), F.col("page_id")).alias("page_id"))


def cleansed_context(cleansed: DataFrame, items: DataFrame, places: DataFrame, now: Column) -> DataFrame:
    """One row a job: metadata, two entries of history (triggered when cleansed, the present state now) and the number of items.

    Items are counted, not gathered: a job's items may be many, and `items` has them by its id.
    """
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    entry = lambda status, at: F.struct(status.alias("status"), millis(at).alias("at"))
    history = F.when(F.col("status").isNull(), F.array(entry(F.lit("ENRICHMENT_TRIGGERED"), F.col("cleansed_at")))).otherwise(F.array(entry(F.lit("ENRICHMENT_TRIGGERED"), F.col("cleansed_at")), entry(F.col("status"), now)))
    counted = items.groupBy(F.col("cleansed_id").alias("id")).agg(F.count("*").alias("n_items"))
    joined = cleansed.join(places, "id", "left").join(counted, "id", "left")
    return joined.select("id", "source_uri", "version", "locale", "page_id", millis(F.col("cleansed_at")).alias("started_at"), "status", history.alias("history"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, n): occurrences of a raw row, elements of a job, and the like."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def active_locales(refs: DataFrame) -> DataFrame:
    """Active region rows in the order of geo, locale, name and path."""
    return refs.where("active").orderBy("geo_code", "locale_code", "display_name", "storefront_path")


def geo_locales(refs: DataFrame, fallback: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows (geo, locales) of the active region rows, each geo's locales sorted; the fallback's where there are none at all."""
    spark = refs.sparkSession
    own = refs.where("active").groupBy(F.upper("geo_code").alias("geo")).agg(F.sort_array(F.collect_set(X.normalize_locale(F.col("locale_code")))).alias("locales"))
    given = spark.createDataFrame([(g, list(ls)) for g, ls in fallback.items()], "geo string, locales array<string>")
    return own.unionByName(given.join(own.limit(1).select(F.lit(1).alias("_one")), how="left_anti", on=F.lit(True))).orderBy("geo")


def locale_rows(rows: DataFrame, locale: str | None) -> DataFrame:
    """Rows of one locale, however it is written; all without one."""
    if locale is None or not locale.strip():
        return rows
    t = locale.strip().replace("-", "_")
    return rows.where(X.normalize_locale(F.col("locale")) == (t[:2].lower() + "_" + t[3:].upper() if len(t) == 5 and t[2] == "_" else t))


def by_job(sections: DataFrame) -> DataFrame:
    """Rows (cleansed_id, n, first_saved): a worker's batch by job."""
    return sections.groupBy("cleansed_id").agg(F.count("*").alias("n"), F.min("saved_at").alias("first_saved"))


def history_of(jobs: DataFrame) -> DataFrame:
    return L.status_counts(jobs, "status")
