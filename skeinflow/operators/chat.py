"""Search by message: criteria from free text, two result lists, and a cascade that relaxes what found nothing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.locales import Aliases, aliases, code_of
from . import search as S
from .fulltext import full_text
from .versions import first_per

# What a message may say, and words that are neither roles nor pages.
SECTION = re.compile(r"(?i)\b([a-z0-9][a-z0-9\s-]*section)\b")
ROLE_ASKED = re.compile(r"(?i)\bgive\s+me\s+([a-z0-9\s-]+?)\s+(?:for|of)\b")
ROLE_FOR = re.compile(r"(?i)\b([a-z0-9_-]{3,})\s+(?:for|of|in|on)\s+([a-z0-9][a-z0-9\s-]*section)\b")
ROLE_BEFORE = re.compile(r"(?i)\b([a-z0-9_-]{3,})\s+([a-z0-9][a-z0-9\s-]*section)\b")
LOCALE = re.compile(r"(?i)\b([a-z]{2})[_-]([a-z]{2})\b")
WORD = re.compile(r"[A-Za-z0-9_-]+")
ROLES = ("headline", "title", "copy", "body", "content", "description")
NOT_ROLES = frozenset({"for", "section", "the", "and", "with", "of", "in", "on", "give", "me"})
NOT_PAGES = frozenset({"for", "section", "sections", "copy", "content", "with", "and", "the"})
PREPOSITIONS = frozenset({"for", "of", "in", "on", "to", "at", "with"})
DEFAULT_LIMIT, MAX_LIMIT = 15, 200

RESULT = ("id", "section_path", "section_uri", "cleansed_text", "content_role", "source", "last_modified", "tenant", "page_id", "locale", "language", "country")


def slug(x: str | None) -> str | None:
    return re.sub("[^a-z0-9]+", "-", x.strip().lower()).strip("-") or None if x else None


def plain(x: object) -> str | None:
    """The first string in a value, trimmed and in lower case."""
    if isinstance(x, (list, tuple)):
        return next(filter(None, map(plain, x)), None)
    return x.strip().lower() or None if isinstance(x, str) else None


def strict_locale(x: object) -> str | None:
    m = LOCALE.fullmatch(plain(x) or "")
    return f"{m[1]}_{m[2].upper()}" if m else None


def section_of(message: str) -> str | None:
    m = SECTION.search(message)
    return slug(m[1]) if m else None


def role_of(message: str) -> str | None:
    """What is asked for by name, else a usual role that occurs, else the word in front of the section."""

    def fit(found: str) -> str | None:
        word = re.sub(r"^[^\w-]+|[^\w-]+$", "", found.strip().lower())
        return word if len(word) > 2 and word not in NOT_ROLES else None

    def candidates() -> Iterator[str | None]:
        if m := ROLE_ASKED.search(message):
            yield fit(m[1])
        yield next((r for r in ROLES if r in message.lower()), None)
        if m := ROLE_FOR.search(message):
            yield fit(m[1])
        yield from (fit(m[1]) for m in ROLE_BEFORE.finditer(message))

    return next(filter(None, candidates()), None)


def page_of(message: str, known: Aliases) -> str | None:
    """The first fitting word after a preposition, else the last fitting word."""
    words = [w.lower() for w in WORD.findall(message)]

    def fits(w: str) -> bool:
        other = w in PREPOSITIONS or w in NOT_PAGES or "section" in w or "locale" in w
        return len(w) > 2 and not other and not LOCALE.fullmatch(w) and known.country(w) is None

    start = next((i for i, w in enumerate(words) if w in PREPOSITIONS), None)
    after = next(filter(fits, words[start + 1 :]), None) if start is not None else None
    return after or next(filter(fits, reversed(words)), None)


def locale_hints(message: str, known: Aliases) -> tuple[str | None, str | None, str | None]:
    """(locale, language, country) that the message names first; a locale also comes of a language and a country.

    Prepositions and the like aren't taken for codes, though `in`, `to` and `me` are some.
    """
    said = [(m[1].lower(), m[2].upper()) for m in LOCALE.finditer(message)]
    if said:
        return f"{said[0][0]}_{said[0][1]}", *said[0]
    words = [w for w in WORD.findall(message.lower()) if w not in PREPOSITIONS and w not in NOT_ROLES]
    language = next(filter(None, map(known.language, words)), None)
    phrases = [p for i, w in enumerate(words) for p in (w, " ".join(words[i : i + 2]))]
    country = next(filter(None, map(known.country, phrases)), None)
    return f"{language}_{country}" if language and country else None, language, country


@dataclass(frozen=True)
class Request:
    message: str | None = None
    section: str | None = None
    role: str | None = None
    tags: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    context: Mapping | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Interpretation:
    """What a provider makes of a message; all parts may be missing."""

    message: str | None = None
    section: str | None = None
    role: str | None = None
    page: str | None = None
    locale: str | None = None
    language: str | None = None
    country: str | None = None
    tags: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    context: Mapping | None = None


@dataclass(frozen=True)
class Criteria:
    section: str | None = None
    role: str | None = None
    page: str | None = None
    locale: str | None = None
    language: str | None = None
    country: str | None = None
    message: str | None = None


def criteria(request: Request, known: Aliases, made: Interpretation | None = None) -> Criteria:
    """Of each part the first that is there: interpretation, request, message, then context, its envelope and facets."""
    made = made or Interpretation()
    said = request.message or ""
    message = made.message or request.message
    locale, language, country = locale_hints(said, known)
    found = {
        "section": plain(made.section) or section_of(message or "") or slug(request.section) or section_of(said),
        "role": plain(made.role) or plain(request.role) or role_of(said),
        "page": plain(made.page) or page_of(said, known),
        "locale": strict_locale(made.locale) or locale,
        "language": known.language(made.language) or language,
        "country": known.country(made.country) or country,
    }
    clean = {"section": ("sectionKey", lambda x: slug(plain(x))), "page": ("pageId", plain), "locale": ("locale", strict_locale), "language": ("language", lambda x: known.language(plain(x))), "country": ("country", lambda x: known.country(plain(x)))}
    context = request.context or {}
    for level in (context, context.get("envelope"), context.get("facets")):
        if isinstance(level, Mapping):
            for part, (key, fit) in clean.items():
                if not (part == "language" and level is context.get("facets")):
                    found[part] = found[part] or fit(level.get(key))
    if found["locale"]:
        found["language"] = found["language"] or found["locale"][:2]
        found["country"] = found["country"] or found["locale"][3:]
    return Criteria(**found, message=message)


def sanitized(x: object) -> object:
    """Without blanks and nulls at any depth; None if nothing is left."""
    if isinstance(x, str):
        return x.strip() or None
    if isinstance(x, Mapping):
        return {str(k): v for k, v in ((k, sanitized(v)) for k, v in x.items()) if v is not None} or None
    if isinstance(x, (list, tuple, set)):
        return [v for v in map(sanitized, x) if v is not None] or None
    return x


def merged(base: Mapping | None, addition: Mapping | None) -> dict:
    """Maps one level deep, lists as unions in order, else the addition wins."""

    def both(a: object, b: object) -> object:
        if isinstance(a, Mapping) and isinstance(b, Mapping):
            return {**a, **b}
        if isinstance(a, (list, tuple)) or isinstance(b, (list, tuple)):
            sides = [x if isinstance(x, (list, tuple)) else [x] for x in (a, b)]
            return list(dict.fromkeys(v for side in sides for v in side if v is not None))
        return b

    out = dict(base or {})
    for k, v in (addition or {}).items():
        out[k] = both(out[k], v) if k in out else v
    return out


def derived_context(c: Criteria) -> dict:
    return sanitized({"envelope": {"locale": c.locale, "country": c.country, "language": c.language}, "pageId": c.page}) or {}


def limit_of(limit: int | None) -> int:
    return min(limit, MAX_LIMIT) if limit and limit > 0 else DEFAULT_LIMIT


def at(context: Column, *path: str) -> Column:
    return X.blank_to_null(F.get_json_object(context, "$" + "".join(f"['{p}']" for p in path)))


def display_fields(sections: DataFrame, source: Column, known: Aliases, tenant: str | None = None) -> DataFrame:
    """Rows of `RESULT`, each field by its order of precedence.

    `sections` has id, section_path, section_uri, original_field_name, cleansed_text, saved_at and context (JSON).
    The context is parsed once; candidates, codes and choices are one projection each, so that none is spelled out twice.
    """
    names = ("tenant", "pageId", "locale", "language", "country", "sectionName", "elementName")
    level = ", ".join(f"{n}: string" for n in names)
    parsed = sections.withColumn("_c", F.from_json("context", f"struct<{level}, envelope: struct<{level}>, facets: struct<{level}>>"))
    where = {"": F.col("_c"), "envelope": F.col("_c.envelope"), "facets": F.col("_c.facets")}
    patterns = {"tenant": "/content/dam/([^/]+)/", "page": "/[a-z]{2}_[A-Z]{2}/([^/]+)/", "locale": "/([a-z]{2}_[A-Z]{2})/"}
    raw = parsed.select(
        *sections.columns,
        F.struct(*[X.strip(at_level[n]).alias(f"{part}{n}") for part, at_level in where.items() for n in names]).alias("_r"),
        F.struct(*[F.regexp_extract(p, pattern, 1).alias(f"{p}_{n}") for n, pattern in patterns.items() for p in ("section_uri", "section_path")]).alias("_p"),
        X.strip(F.col("original_field_name")).alias("_field"),
    )

    def on_paths(name: str) -> list[Column]:
        return [F.col(f"_p.{p}_{name}") for p in ("section_uri", "section_path")]

    r = lambda name: F.col(f"_r.{name}")
    locales = [r(f"{part}locale") for part in ("envelope", "", "facets")]
    fit = F.filter(F.array(*locales, *on_paths("locale")), lambda x: x.rlike("(?i)^[a-z]{2}[-_][a-z]{2}$"))
    chosen = raw.select(
        *sections.columns,
        F.try_element_at(fit, F.lit(1)).alias("_locale"),
        *[code_of(r(f"{part}country"), known.countries, "country").alias(f"_country_{part}") for part in where],
        *[code_of(r(f"{part}language"), known.languages, "language").alias(f"_language_{part}") for part in ("", "envelope")],
        _first(F.col("_field"), r("sectionName"), r("elementName"), r("envelopesectionName"), r("facetssectionName")).alias("content_role"),
        _first(r("envelopetenant"), r("tenant"), *on_paths("tenant"), F.lit(tenant).cast("string")).alias("tenant"),
        F.lower(_first(r("pageId"), r("envelopepageId"), r("facetspageId"), *on_paths("page"))).alias("page_id"),
    )
    language, country = F.lower(F.substring("_locale", 1, 2)), F.upper(F.substring("_locale", 4, 2))
    return chosen.select(
        *sections.columns,
        "content_role",
        source.alias("source"),
        F.col("saved_at").alias("last_modified"),
        "tenant",
        "page_id",
        F.concat(language, F.lit("_"), country).alias("locale"),
        F.coalesce("_language_", "_language_envelope", language).alias("language"),
        F.coalesce("_country_envelope", "_country_", "_country_facets", country).alias("country"),
    )


def _first(*cs: Column) -> Column:
    """The first that isn't null or empty."""
    return F.try_element_at(F.filter(F.array(*cs), lambda x: x != ""), F.lit(1))


def matches(c: Criteria) -> Column:
    """The role must occur; page, country and locale must be equal where the row has them."""
    role = [F.contains(F.lower(F.coalesce("content_role", F.lit(""))), F.lit(c.role.lower()))] if c.role else []
    return S.every(role + [x for name, v in (("page_id", c.page), ("country", c.country), ("locale", c.locale)) for x in S.unless_absent(F.lower(F.col(name)), v and v.lower())])


def section_key_filter(key: str | None) -> list[Column]:
    context = F.col("context")
    return S.section_matches(key, [F.col("original_field_name"), F.col("section_path"), F.col("section_uri"), at(context, "envelope", "usagePath"), at(context, "usagePath")], [at(context, "facets", "sectionKey"), at(context, "envelope", "sectionKey"), at(context, "sectionKey")])


def vector_arm(chunks: DataFrame, sections: DataFrame, query: Sequence[float], levels: Sequence[tuple[Criteria, Mapping]], tags: Sequence[str], keywords: Sequence[str], k: int) -> DataFrame:
    """The nearest chunks' sections of each level, its number in `_level` and their place in `_at`.

    Sections are filtered once before the join; a row stands for each level whose filter it passes. Of a level a task keeps k rows at most before the ranking.
    """
    fixed = section_key_filter(levels[0][0].section) + [S.has_all(F.col("tags"), tags)] * bool(tags) + [S.has_all(F.col("keywords"), keywords)] * bool(keywords)
    passed = F.filter(F.array(*[F.when(S.every(S.json_filters(F.col("context"), effective(c, about))), n) for n, (c, about) in enumerate(levels)]), lambda n: n.isNotNull())
    wanted = sections.where(S.every(fixed)).withColumn("_levels", passed).where(F.size("_levels") > 0)
    rows = chunks.select(F.col("section_id").alias("id"), "vector", "source_field").join(wanted, "id")
    scored = S.distances(rows, "vector", query).withColumn("_level", F.explode("_levels"))
    top = scored.withColumn("_at", F.row_number().over(Window.partitionBy("_level").orderBy("distance", "id"))).where(F.col("_at") <= k)
    return top.withColumn("original_field_name", F.coalesce(X.blank_to_null(F.col("original_field_name")), "source_field"))


def effective(c: Criteria, context: Mapping) -> Mapping:
    return sanitized(merged(context, derived_context(c))) or {}


def metadata_arm(sections: DataFrame, c: Criteria, k: int) -> DataFrame:
    """Sections of the key, latest first; without a key those whose texts match the message."""
    if not c.section:
        return full_text(sections, ["summary", "classification", "original_field_name", "section_path"], c.message or "").withColumn("_pos", F.lit(0)).orderBy("id").limit(k)
    newest = [F.col("saved_at").desc_nulls_last(), F.col("id")]
    by_text = sections.where(S.every(section_key_filter(c.section))).orderBy(*newest).limit(k)
    by_key = sections.where(F.lower(at(F.col("context"), "facets", "sectionKey")) == c.section).orderBy(*newest).limit(k)
    both = by_text.withColumn("_pos", F.lit(0)).unionByName(by_key.withColumn("_pos", F.lit(1)))
    return first_per(both, ["id"], F.col("_pos"))


def merge(both: DataFrame, limit: int, *more: str) -> DataFrame:
    """Of equal path, role and text the first row stays; ids cf1, cf2, ... by rank."""
    squeezed = F.trim(F.regexp_replace(F.coalesce("cleansed_text", F.lit("")), r"\s+", " "))
    keyed = both.select("*", *[F.trim(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("section_path", "content_role")], F.sha2(squeezed, 256).alias("_text"))
    once = first_per(keyed, ["_section_path", "_content_role", "_text"], F.col("_arm"), F.col("_at")).orderBy("_arm", "_at").limit(limit)
    rank = F.row_number().over(Window.orderBy("_arm", "_at"))
    return once.withColumn("cf_id", F.concat(F.lit("cf"), rank)).select("cf_id", *RESULT, *more)


def relaxed(chunks: DataFrame, sections: DataFrame, query: Sequence[float], levels: Sequence[tuple[Criteria, Mapping]], tags: Sequence[str], keywords: Sequence[str], limit: int) -> DataFrame:
    """The results of the first level that finds something, with its number in `_level`: all levels in one plan.

    Each level has its vector list and then the metadata list, which is the same for all; the least level that has rows left is found among them, a
    few hundred rows each.
    """
    near = vector_arm(chunks, sections, query, levels, tags, keywords, limit).select(*sections.columns, "_level", F.lit(0).alias("_arm"), "_at")
    order = [F.col("_pos"), F.col("saved_at").desc_nulls_last(), F.col("id")]
    listed = metadata_arm(sections, levels[0][0], 2 * limit).withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    listed = listed.select(*sections.columns, F.explode(F.array(*map(F.lit, range(len(levels))))).alias("_level"), F.lit(1).alias("_arm"), "_at")
    source = F.when(F.col("_arm") == 0, "content_chunks").otherwise("consolidated_enriched_sections")
    shown = display_fields(near.unionByName(listed), source, aliases(sections.sparkSession))
    fit = shown.where(reduce(lambda a, b: a | b, [(F.col("_level") == n) & matches(c) for n, (c, _) in enumerate(levels)]))
    least = fit.withColumn("_least", F.min("_level").over(Window.partitionBy())).where(F.col("_level") == F.col("_least"))
    return merge(least, limit, "_level")


def attempts(c: Criteria, context: Mapping) -> Iterator[tuple[Criteria, Mapping]]:
    """The search as asked, then without its role, then without context, then by the bare message."""
    tried: list[tuple[Criteria, Mapping]] = []
    loose = replace(c, role=None)
    for option in ((c, context), (loose, context), (replace(loose, locale=None, language=None, country=None), {}), (Criteria(section=c.section, page=c.page, message=c.message), {})):
        if option not in tried:
            tried.append(option)
            yield option


def interpreted(request: Request, interpret: Callable[[Request], Interpretation | None]) -> Interpretation | None:
    """What a provider makes of the message; one that fails makes nothing of it, and the search goes on without."""
    try:
        return interpret(request)
    except Exception:
        return None


def answer(request: Request, chunks: DataFrame, sections: DataFrame, embed: Callable[[str], Sequence[float]], interpret: Callable[[Request], Interpretation | None] = lambda _: None) -> DataFrame:
    """The first search of the cascade that finds something, with column match_terms; empty without a section. One plan, up to 200 rows."""
    made = interpreted(request, interpret)
    c = criteria(request, aliases(sections.sparkSession), made)
    lists = [list(dict.fromkeys(filter(None, map(plain, [*getattr(made, n, ()), *getattr(request, n)])))) for n in ("tags", "keywords")]
    context = merged(sanitized(request.context), sanitized(made.context if made else None))
    levels = list(attempts(c, context) if c.section else attempts(replace(c, section="-"), context))  # without a section the result is empty
    found = relaxed(chunks, sections, embed(c.message or ""), levels, *lists, limit_of(request.limit))

    def terms(c: Criteria) -> Column:
        said = [F.lit(x).cast("string") for x in (c.section, c.role, c.page, c.country, c.language, *lists[0], *lists[1])]
        return X.match_terms(said[0], F.col("content_role"), said[1], F.col("page_id"), *said[2:])

    by_level = F.coalesce(*[F.when(F.col("_level") == n, terms(c)) for n, (c, _) in enumerate(levels)])
    return found.where(F.lit(c.section is not None)).withColumn("match_terms", by_level).drop("_level")
