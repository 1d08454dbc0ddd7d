"""The asset catalogue: occurrences, their filters and options, and observed regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import search as S
from .versions import first_per

TILE = ("preview_uri", "alt_text", "asset_key", "asset_model")


@dataclass(frozen=True)
class Wanted:
    tenant: str | None = None
    environment: str | None = None
    project: str | None = None
    site: str | None = None
    geo: str | None = None
    locale: str | None = None
    page: int = 0
    size: int = 200


def place(geo: str | None, locale: str | None, group_locales: Mapping[str, str]) -> tuple[str | None, str | None]:
    """(geo, locale) to filter by: a locale is enough; a group stands for its first locale; else the geo in capitals."""
    text = (locale or "").strip() or group_locales.get((geo or "").strip(), "")
    text = text.replace("-", "_")
    if text:
        return None, text[:2].lower() + "_" + text[3:].upper() if len(text) == 5 and text[2] == "_" else text
    group = geo and geo.strip() in X.GEO_GROUPS | {"WW": ""}
    return (None if group or not geo or not geo.strip() else geo.strip().upper()), None


def tiles(occurrences: DataFrame, catalog: DataFrame, prefix: str = "") -> DataFrame:
    """Occurrences with their catalogue columns and absolute urls; the catalogue may lack a row."""
    wanted = [c for c in TILE if c in catalog.columns]
    joined = occurrences.join(catalog.select(F.col("id").alias("catalog_id"), *wanted), "catalog_id", "left")
    return joined.withColumn("preview_uri", X.absolute_url(F.col("preview_uri"), prefix)) if prefix else joined


def search(occurrences: DataFrame, catalog: DataFrame, wanted: Wanted, group_locales: Mapping[str, str], prefix: str = "") -> S.Page:
    """A page of tiles, latest first. The catalogue joins the page's rows only."""
    geo, locale = place(wanted.geo, wanted.locale, group_locales)
    conditions = [x for name, v in (("tenant", wanted.tenant), ("environment", wanted.environment), ("project", wanted.project), ("geo", geo), ("locale", locale)) for x in S.optional_equal(F.col(name), v)]
    conditions += S.site_matches(F.col("site"), [F.col("section_path"), F.col("source_uri")], wanted.site)
    order = [F.col("created_at").desc_nulls_last(), F.col("id")]
    page = S.page_of(occurrences.where(S.every(conditions)), order, wanted.page, wanted.size)
    page.rows = tiles(page.rows, catalog, prefix).orderBy(*order)
    return page


def detail(occurrences: DataFrame, catalog: DataFrame, occurrence_id: object) -> DataFrame:
    """One occurrence with its catalogue row; none if either is missing."""
    return tiles(occurrences.where(F.col("id") == occurrence_id).join(catalog.select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi"), catalog)


def options(defaults: Sequence[str], observed: DataFrame, col: str) -> DataFrame:
    """Rows (value, rank): the defaults in order, then what was observed, in lower case, each once."""
    spark = observed.sparkSession
    first = spark.createDataFrame([(i, d.lower()) for i, d in enumerate(defaults)], "rank int, value string")
    seen = observed.where(X.blank_to_null(F.col(col)).isNotNull()).select(F.lit(len(defaults)).alias("rank"), F.lower(X.strip(F.col(col))).alias("value")).distinct()
    return first.unionByName(seen).groupBy("value").agg(F.min("rank").alias("rank")).orderBy("rank", "value")


def snapshot_replace(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Occurrences with all rows of the incoming (source, version) pairs replaced."""
    keys = ["source_uri", "source_version"]
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def observations(candidates: DataFrame, ordinal: Column, request_geo: str | None = None, request_locale: str | None = None) -> DataFrame:
    """Rows (geo, locale, display_name, storefront_path), one for each locale that was seen first.

    A missing geo comes of the locale, a missing locale of the geo; the request's own pair comes last.
    """
    spark = candidates.sparkSession
    seen = candidates.select("geo", "locale", ordinal.cast("long").alias("_at"), F.lit(0).alias("_last"))
    own = spark.createDataFrame([(request_geo, request_locale)], "geo string, locale string").select("geo", "locale", F.lit(0).cast("long").alias("_at"), F.lit(1).alias("_last"))
    locale, geo = X.normalize_locale(F.col("locale")), F.upper(X.blank_to_null(F.col("geo")))
    both = seen.unionByName(own).select("_at", "_last", F.coalesce(geo, F.when(F.char_length(locale) >= 5, F.upper(F.substring(locale, 4, 100)))).alias("geo"), F.coalesce(locale, X.locale_of_geo(geo)).alias("locale"))
    once = first_per(both.where("geo is not null and locale is not null"), ["locale"], F.col("_last"), F.col("_at"), F.col("geo"))
    return once.select("geo", "locale", F.concat(F.lit("Uploaded locale "), "locale").alias("display_name"), X.storefront_path(F.col("locale")).alias("storefront_path"))
