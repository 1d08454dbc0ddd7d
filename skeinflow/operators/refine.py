"""Refinement: chips of the nearest sections, with hints of the query and types that must be shown."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import search as S
from .chat import at

# Score of a chip of a supplemental section or of a section key in the query, and of a role in the query.
SECTION_WEIGHT, ROLE_WEIGHT = 0.2, 0.15
DEFAULT_LIMIT, MAX_LIMIT, MAX_SECTIONS = 15, 50, 200
# Fixed value: the pattern of a section key.
SECTION_KEY = re.compile(r"(?i)\b[a-z0-9]+(?:-[a-z0-9]+)*-section(?:-[a-z0-9]+)*\b")
SCORED = (("facets", ("sectionKey", "sectionName", "eventType")), ("envelope", ("sectionName", "locale", "country")))
COUNTED = (("facets", ("sectionKey", "sectionName", "sectionModel", "eventType")), SCORED[1])


def section_key() -> Column:
    """From the context, else from the path, else from the uri."""
    from_path = [F.coalesce(X.section_key(F.col(p)), F.when(F.contains(F.lower(last), F.lit("section")), F.lower(last))) for p in ("section_path", "section_uri") for last in [F.element_at(F.split(F.col(p), "/"), -1)]]
    return F.coalesce(*[F.lower(at(F.col("context"), *k)) for k in (("facets", "sectionKey"), ("envelope", "sectionKey"), ("sectionKey",))], *from_path)


def chip_values(context_keys: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Chips (type, value) of a section: field, key, tags, keywords and parts of the context."""

    def of(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    none = F.array().cast("array<string>")
    single = [of("sectionName", X.blank_to_null(F.col("original_field_name"))), of("sectionKey", section_key())]
    single += [of(f"Context:{part}.{k}", at(F.col("context"), part, k)) for part, keys in context_keys for k in keys]
    tags = F.transform(F.coalesce(F.col("tags"), none), lambda v: of("Tag", v))
    keywords = F.transform(F.coalesce(F.col("keywords"), none), lambda v: of("Keyword", v))
    return F.filter(F.concat(F.array(*single), tags, keywords), lambda x: x["value"].isNotNull())


def hints(query: str) -> tuple[list[str], list[str]]:
    """Section keys in the query, and the words in front of them as roles."""
    keys = list(dict.fromkeys(m[0].lower() for m in SECTION_KEY.finditer(query)))
    before = (re.search(r"([a-z0-9_-]{3,})\s+(?:(?:for|of|in|on)\s+)?$", query[: m.start()].lower()) for m in SECTION_KEY.finditer(query))
    roles = [m[1] for m in before if m and m[1] not in ("for", "the", "and", "with")]
    return keys, list(dict.fromkeys(r for r in roles if r not in keys))


def limit_of(limit: int | None) -> int:
    return min(limit, MAX_LIMIT) if limit and limit > 0 else DEFAULT_LIMIT


def ranked(chunks: DataFrame, sections: DataFrame, vector: Sequence[float], query: str, limit: int | None = None) -> DataFrame:
    """All chips (type, value, score, count), best first. Ties go by type and value.

    Scores add up over the nearest chunks, supplemental sections and hints; counts are of distinct sections.
    """
    spark, keys_roles = sections.sparkSession, hints(query)
    near = S.nearest(chunks.select(F.col("section_id").alias("id"), "vector", "chunk_id"), "vector", vector, min(max(50, 6 * limit_of(limit)), 200), "chunk_id").select("id", "distance")
    rows = sections.join(F.broadcast(near), "id")  # 200 rows at most
    scored = rows.select(F.explode(chip_values(SCORED)).alias("chip"), X.distance_score(F.col("distance")).alias("w")).where("w > 0").select("chip.*", "w")
    extra = None
    for key in keys_roles[0]:
        c = [F.contains(F.lower(F.coalesce(F.col(x), F.lit(""))), F.lit(key)) for x in ("original_field_name", "section_path", "section_uri")]
        found = sections.where(c[0] | c[1] | c[2]).orderBy(F.col("saved_at").desc_nulls_last(), "id").limit(MAX_SECTIONS)
        extra = found if extra is None else extra.unionByName(found)
    counted = rows.drop("distance")
    if extra is not None:
        scored = scored.unionByName(extra.select(F.explode(chip_values(COUNTED)).alias("chip")).select("chip.*", F.lit(SECTION_WEIGHT).alias("w")))
        counted = counted.unionByName(extra.select(*counted.columns))
    said = [("sectionKey", k, SECTION_WEIGHT) for k in keys_roles[0]] + [("sectionName", r, ROLE_WEIGHT) for r in keys_roles[1]]
    if said:
        scored = scored.unionByName(spark.createDataFrame(said, "type string, value string, w double"))
    counts = counted.dropDuplicates(["id"]).select(F.explode(chip_values(COUNTED)).alias("chip")).groupBy("chip.type", "chip.value").agg(F.count("*").alias("count"))
    scores = scored.groupBy("type", "value").agg(F.sum("w").alias("score"))
    return scores.join(counts, ["type", "value"], "left").select("type", "value", "score", F.coalesce("count", F.lit(0)).cast("int").alias("count")).orderBy(F.col("score").desc(), "type", "value")


def ensure(chosen: list, everything: list, limit: int, fits: Callable, default: object | None = None) -> list:
    """`chosen`, with the first fitting chip appended or in the last place if none fits yet."""
    if any(map(fits, chosen)):
        return chosen
    pick = next(filter(fits, everything), default)
    if pick is None:
        return chosen
    return [*(chosen if len(chosen) < limit else chosen[:-1]), pick]


def refine(chunks: DataFrame, sections: DataFrame, embed: Callable[[str], Sequence[float]], query: str, limit: int | None = None) -> list[dict]:
    """Up to 50 chips; a name and a key of a section and what the query names are always among them.

    Collected are the chips of at most 200 chunks and as many sections of each key in the query.
    """
    n = limit_of(limit)
    all_chips = [r.asDict() for r in ranked(chunks, sections, embed(query), query, n).collect()]
    chosen = all_chips[:n]
    for kind in ("sectionName", "sectionKey"):
        chosen = ensure(chosen, all_chips, n, lambda c, kind=kind: c["type"] == kind)
    keys, roles = hints(query)
    for kind, values in (("sectionKey", keys), ("sectionName", roles)):
        for v in values:
            same = lambda c, kind=kind, v=v: c["type"] == kind and (c["value"] or "").lower() == v
            chosen = ensure(chosen, all_chips, n, same, {"type": kind, "value": v, "score": 0.0, "count": 0})
    return chosen


def pinned(chips: Sequence[dict]) -> list[dict]:
    """Names of sections first, else in the given order."""
    return sorted(chips, key=lambda c: c["type"] != "sectionName")


def request_of(chips: Sequence[dict]) -> dict:
    """A search request from picked chips: tags, keywords, one role, and lists of context values by path."""
    out: dict = {"tags": [], "keywords": [], "role": None, "context": {}}
    for c in chips:
        kind, value = c["type"], c["value"]
        if kind in ("Tag", "Keyword"):
            out[kind.lower() + "s"].append(value)
        elif kind == "sectionName":
            out["role"] = out["role"] or value
        else:
            path = kind.removeprefix("Context:").split(".") if kind.startswith("Context:") else ["facets", kind]
            out["context"].setdefault(path[0], {}).setdefault(path[-1], []).append(value)
    return out
