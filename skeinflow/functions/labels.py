"""Labels for people: sources, sizes, paths, file names, and which elements are hidden or skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, strip

# Titles that are hidden, and words in a status that mean skipped.
HIDDEN_TITLES = ("analytics", "disclaimers", "pageanalyticsattributes", "alt", "analyticsattributes", "url")
SKIPPED_WORDS = ("SKIP", "SKIPPED", "IGNORED", "IGNORE", "NO_ENRICHMENT", "NOT_ENRICHED", "UNSUPPORTED", "EXCLUDED", "FILTERED")
# Label of the first word that a source type holds.
SOURCE_LABELS = (("api", "API payload"), ("s3", "S3 / Cloud"), ("cloud", "S3 / Cloud"), ("class", "Classpath resource"), ("local", "Local upload"), ("file", "File upload"))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def source_type(explicit: Column, identifier: Column) -> Column:
    """The stated type in lower case, else what the identifier tells: file, api, s3 or classpath; else null."""
    t = F.lower(identifier)
    begins = lambda *xs: any_of([F.startswith(t, F.lit(x)) for x in xs])
    told = F.when(begins("file-upload", "local:"), "file").when(F.contains(t, F.lit("api")), "api").when(F.contains(t, F.lit("s3")), "s3").when(begins("classpath:"), "classpath")
    return F.coalesce(F.nullif(F.lower(explicit), F.lit("")), told)


def source_label(kind: Column) -> Column:
    out = kind
    for word, label in reversed(SOURCE_LABELS):
        out = F.when(F.contains(F.lower(kind), F.lit(word)), label).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Unknown source"))


def bytes_label(n: Column) -> Column:
    """In B, KB, MB or GB, with one decimal up to nine units."""
    power = F.when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1 << 10, 1).otherwise(0)
    value = n / F.pow(F.lit(1024.0), power)
    digits = F.when((power == 0) | (value > 9), F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.concat(digits, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power + 1))


def path_label(path: Column) -> Column:
    """The last segment behind any reference mark, with spaces for dashes."""
    own = strip(F.element_at(F.split(path, "::"), -1))
    last = F.try_element_at(F.filter(F.split(own, "/"), lambda s: s != ""), F.lit(-1))
    return F.coalesce(blank_to_null(F.translate(F.coalesce(last, own), "-_", "  ")), F.lit("Enriched section"))


def filename_locale(name: Column) -> Column:
    """ll-CC in front of the file's ending, else ll."""
    pair = F.regexp_extract(name, r"[_-]([a-z]{2}[_-][A-Za-z]{2})(?=\.)", 1)
    one = F.regexp_extract(name, r"[_-]([a-z]{2})(?=\.)", 1)
    return F.coalesce(F.nullif(F.translate(pair, "_", "-"), F.lit("")), F.nullif(one, F.lit("")))


def is_hidden(title: Column) -> Column:
    t = F.coalesce(F.lower(strip(title)), F.lit(""))
    return any_of([c for x in HIDDEN_TITLES for c in (t == x, F.startswith(t, F.lit(f"{x}[")), F.startswith(t, F.lit(f"{x}.")), F.contains(t, F.lit(f"{x}:")))])


def is_skipped(status: Column) -> Column:
    s = F.regexp_replace(F.upper(F.coalesce(status, F.lit(""))), r"[\s-]+", "_")
    return any_of([F.contains(s, F.lit(w)) for w in SKIPPED_WORDS])
