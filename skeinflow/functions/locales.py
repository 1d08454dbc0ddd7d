"""Language and country codes from names, made by rule from the JVM's locale data."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip


def letters(x: str) -> str:
    return re.sub("[^a-z]", "", x.lower())


@dataclass(frozen=True)
class Aliases:
    """Letters-only keys and their codes: `languages` lower-case, `countries` upper-case, two letters each."""

    languages: dict[str, str]
    countries: dict[str, str]

    def language(self, x: str | None) -> str | None:
        """Of a code, a name, or what precedes the last dash or underscore."""
        if not x or not x.strip():
            return None
        head = re.match(r"\s*(.+)[-_].", x)
        return (self.languages.get(letters(head[1])) if head else None) or self.languages.get(letters(x))

    def country(self, x: str | None) -> str | None:
        """Of a code of two or three letters, a name, or what follows the last dash or underscore."""
        if not x or not x.strip():
            return None
        tail = re.search(r".[-_]([^-_]+)$", x.strip())
        return (self.countries.get(letters(tail[1])) if tail else None) or self.countries.get(letters(x))


_MADE: list[Aliases] = []


def aliases(spark: SparkSession) -> Aliases:
    """All ISO languages and countries with their English names, languages with their own names too; made once.

    Codes win over names. About 1,300 entries, whatever the data.
    """
    if not _MADE:
        locale = spark._jvm.java.util.Locale
        english = locale.ENGLISH
        languages: dict[str, str] = {}
        countries: dict[str, str] = {}
        codes = list(locale.getISOLanguages())
        languages.update((c, c) for c in codes)
        for c in codes:
            own = locale.forLanguageTag(c)
            for name in (own.getDisplayLanguage(english), own.getDisplayLanguage(own)):
                if letters(name):
                    languages.setdefault(letters(name), c)
        codes = list(locale.getISOCountries())
        countries.update((c.lower(), c) for c in codes)
        for c in codes:
            own = locale("", c)
            for name in (own.getISO3Country(), own.getDisplayCountry(english)):
                if letters(name):
                    countries.setdefault(letters(name), c)
        _MADE.append(Aliases(languages, countries))
    return _MADE[0]


def _key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z]", "")


def _parts(x: Column, kind: str) -> tuple[Column, Column]:
    """The part that is tried first and the whole."""
    t = strip(x)
    part = F.regexp_extract(t, r"^(.+)[-_].", 1) if kind == "language" else F.regexp_extract(t, r".[-_]([^-_]+)$", 1)
    return _key(part), _key(t)


def code_of(x: Column, known: dict[str, str], kind: str) -> Column:
    """The code as an expression; for result pages, since a map literal is searched key by key."""
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")  # folded to a literal
    first, whole = _parts(x, kind)
    return F.coalesce(F.try_element_at(table, first), F.try_element_at(table, whole))


def with_code(df: DataFrame, col: str, out: str, kind: str) -> DataFrame:
    """`df` with the code of `kind` (language, country) of column `col`; for whole tables.

    The alias table has a fixed size and is broadcast. Unknown, null and blank values give null.
    """
    made = aliases(df.sparkSession)
    known = made.languages if kind == "language" else made.countries
    table = F.broadcast(df.sparkSession.createDataFrame(list(known.items()), "_k string, _c string"))
    first, whole = _parts(F.col(col), kind)
    rows = df.withColumn("_first", first).withColumn("_whole", whole)
    a, b = table.select(F.col("_k").alias("_first"), F.col("_c").alias("_c1")), table.select(F.col("_k").alias("_whole"), F.col("_c").alias("_c2"))
    return rows.join(a, "_first", "left").join(b, "_whole", "left").withColumn(out, F.coalesce("_c1", "_c2")).drop("_first", "_whole", "_c1", "_c2")
