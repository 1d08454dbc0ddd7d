"""Column functions: cleansing, hashing, paths and locales, lists, chunks and scores. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The macros of the content format, in the order of their removal.
MACROS = (
    r"\{%nbsp%\}",
    r"\{%br%\}",
    r"\{%sosumi type=\"[^\"]+\" metadata=\"\d+\"%\}",
    r":\[\s*:\[[^\]]+\]\(\{%url metadata=\"\d+\" destination-type=\"[^\"]+\"%\}\)\]\(\{%wj%\}\)",
    r":\s*\[[^\]]+\]\(\{%url metadata=\"\d+\" destination-type=\"[^\"]+\"%\}\)",
    r"\{% metadata=\"\d+\" %\}",
)
# Words that mark an event, tried in this order, and the event's name.
EVENTS = (("valentine", "Valentine day"), ("father's day", "Fathers day"), ("tax", "Tax day"), ("christmas", "Christmas"), ("mothers", "Mothers day"))
# Item types with one of these prefixes aren't annotated.
EXCLUDED = ("analytics", "disclaimers", "pageanalyticsattributes", "alt", "analyticsattributes", "url", "analyticstags", "accessibilitytext")
# Countries of each business region; all others belong to WW.
GEO_GROUPS = {
    "IN": ("IN",),
    "JP": ("JP",),
    "KR": ("KR",),
    "ANZ": ("AU", "NZ"),
    "SEA": ("SG", "MY", "TH", "VN", "ID", "PH", "BN", "KH", "LA", "MM"),
    "ALAC-CA": ("CA", "MX", "AR", "BO", "BR", "CL", "CO", "CR", "DO", "EC", "SV", "GT", "HN", "NI", "PA", "PY", "PE", "UY", "VE"),
    "Europe": ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK"),
    "CEMEA": ("AE", "SA", "QA", "KW", "OM", "BH", "JO", "IL", "EG", "MA", "TN", "DZ", "ZA", "NG", "KE", "UG", "CM", "CI", "BW", "MZ", "MU", "SN", "CF", "GW", "GN", "GQ", "ML", "NE", "AM", "AZ", "BY", "GE", "KZ", "KG", "MD", "ME", "MK", "RU", "TJ", "TM", "UA", "UZ", "TR"),
}
GEO_ORDER = ("Europe", "IN", "JP", "KR", "SEA", "WW", "CEMEA", "ANZ", "ALAC-CA")
# Other names of the annotation states.
STATUS_ALIASES = {
    "ENRICHMENT_TRIGGERED": ("CLEANSED_PENDING_ENRICHMENT", "QUEUED_FOR_ENRICHMENT", "ENRICHMENT_QUEUED"),
    "WAITING_FOR_RESULTS": ("WAITING_FOR_AI_OUTPUT", "AWAITING_AI_OUTPUT", "WAITING_FOR_RESULTS"),
    "ENRICHMENT_RUNNING": ("ENRICHMENT_IN_PROGRESS", "ENRICHMENT_PROCESSING", "AI_ENRICHMENT_IN_PROGRESS", "ENRICHMENT_STARTED"),
    "ENRICHMENT_COMPLETE": ("ENRICHMENT_DONE", "ENRICHED", "COMPLETED"),
}
# The annotation states in order of progress.
STATUS_ORDER = ("ENRICHMENT_TRIGGERED", "WAITING_FOR_RESULTS", "ENRICHMENT_RUNNING", "PARTIALLY_ENRICHED", "ENRICHMENT_COMPLETE")
REF = " ::ref:: "
CHUNK_CHARS, CHUNK_SENTENCES, CHUNK_OVERLAP = 500, 6, 1


def strip(x: Column) -> Column:
    """Without the characters up to space at both ends."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def first_filled(*xs: Column, forbidden: Sequence[str] = ()) -> Column:
    """The first argument that isn't null, blank or (without case) forbidden, trimmed."""
    filled = [blank_to_null(x) for x in xs]
    if forbidden:
        filled = [F.when(~F.lower(x).isin(*[f.lower() for f in forbidden]), x) for x in filled]
    return F.coalesce(*filled)


def resolved(requested: Column, inferred: Sequence[Column] = (), default: str | None = None) -> Column:
    """What a request asks for, else the first that the paths tell, else the default."""
    return first_filled(requested, *inferred, F.lit(default))


def slim_context(context: Column) -> Column:
    """Of a stored context (JSON) the facets and the envelope only."""
    return F.to_json(F.map_filter(F.from_json(context, "map<string,string>"), lambda k, _: k.isin("facets", "envelope")))


def keep_blank(cleansed: Column, blanks: bool = True) -> Column:
    """Whether an item stays after cleansing: null never, blank only with `blanks`."""
    return cleansed.isNotNull() if blanks else blank_to_null(cleansed).isNotNull()


def cleanse(x: Column) -> Column:
    """Macros, tags and white space become single spaces; one pass, null stays null."""
    x = reduce(lambda c, p: F.regexp_replace(c, p, " "), (*MACROS, r"<[^>]+?>", "\u00a0"), x)
    return strip(F.regexp_replace(x, r"\s+", " "))


def cleanse_legacy(x: Column) -> Column:
    """The older form: line breaks are kept as such, other macros vanish, blank becomes null."""
    nbsp, br, sosumi, nested, url, meta = MACROS
    x = F.regexp_replace(x, br, "\n")
    x = reduce(lambda c, p: F.regexp_replace(c, p, ""), (nbsp, sosumi, url, nested, meta, r"<[^>]+?>"), x)
    return blank_to_null(x)


def content_hash(content: Column, context: Column | None = None) -> Column:
    return F.sha2(content if context is None else F.concat(content, F.coalesce(context, F.lit(""))), 256)


def context_hash(context: Column) -> Column:
    return F.sha2(F.to_json(context, {"ignoreNullFields": "false"}), 256)


def joined_hash(*xs: Column) -> Column:
    """SHA-256 of the parts with bars between them, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in xs]), 256)


def event_tag(x: Column) -> Column:
    low = F.lower(x)
    return F.coalesce(*[F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in EVENTS])


def is_excluded(item_type: Column, prefixes: Sequence[str] = EXCLUDED) -> Column:
    low = F.lower(item_type)
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p.lower())) for p in prefixes], F.lit(False))


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


# Fixed values in the next functions: the patterns of locales, tenants, sites and section keys in paths.
def path_locale(path: Column) -> Column:
    """ll_CC of a path segment such as /ll-CC/."""
    pattern = r"(?<=/)([a-z]{2})[-_]([A-Z]{2})(?=/|$)"
    return F.concat(_found(path, pattern, 1), F.lit("_"), _found(path, pattern, 2))


def any_locale(path: Column) -> Column:
    pattern = r"([a-z]{2})[-_]([A-Z]{2})"
    return F.concat(_found(path, pattern, 1), F.lit("_"), _found(path, pattern, 2))


def path_tenant(path: Column) -> Column:
    return _found(path, r"/content/dam/([^/]+)/")


def path_page(path: Column) -> Column:
    """The segment behind a locale's."""
    return _found(path, r"/[a-z]{2}[_-][A-Z]{2}/([^/]+)/")


def path_site(path: Column) -> Column:
    return F.coalesce(_found(path, r"/assets-www/[a-z]{2}[_-][A-Z]{2}/([^/]+)/"), _found(path, r"/live/[a-z]{2}[_-][A-Z]{2}/([^/]+)/"))


def normalize_locale(x: Column, on_invalid: str = "partial") -> Column:
    """ll_CC. What has another form: 'partial' (dashes become underscores),
    'lower' (so, in lower case), 'null', 'blank' or 'original'."""
    t = F.replace(blank_to_null(x), F.lit("-"), F.lit("_"))
    good = F.concat(F.lower(F.substring(t, 1, 2)), F.lit("_"), F.upper(F.substring(t, 4, 2)))
    other = {"partial": t, "null": F.lit(None).cast("string"), "original": x, "lower": F.lower(t), "blank": F.lit("")}[on_invalid]
    return F.when((F.char_length(t) == 5) & (F.substring(t, 3, 1) == "_"), good).otherwise(other)


def geo_group(country: Column) -> Column:
    code, out = F.upper(strip(country)), F.lit("WW")
    for name, members in reversed(GEO_GROUPS.items()):
        out = F.when(code.isin(*members), name).otherwise(out)
    return out


def geo_group_of_locale(locale: Column) -> Column:
    t = normalize_locale(locale)
    return F.when(F.char_length(t) >= 5, geo_group(F.substring(t, 4, 1000))).otherwise("WW")


def geo_rank(group: Column) -> Column:
    """Position in the business order; unknown groups come last."""
    return F.coalesce(*[F.when(group == g, F.lit(i)) for i, g in enumerate(GEO_ORDER)], F.lit(len(GEO_ORDER)))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")


def chunks(x: Column) -> Column:
    """Texts of up to 500 characters whole, longer ones by six sentences with one of overlap; blank gives none."""
    stride = CHUNK_SENTENCES - CHUNK_OVERLAP

    def joined(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(stride))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, F.lit(CHUNK_SENTENCES)), " "))

    # the lambda's variable holds the sentences: as a plain expression they would be split again for every chunk
    long = F.get(F.transform(F.array(sentences(strip(x))), joined), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(blank_to_null(x).isNull(), none).when(F.char_length(x) <= CHUNK_CHARS, F.array(x)).otherwise(long)


def usage_container(path: Column) -> Column:
    return blank_to_null(F.get(F.split(path, REF, 2), F.lit(0)))


def usage_fragment(path: Column) -> Column:
    parts = F.split(path, REF, 2)
    return blank_to_null(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(path))


def strip_metadata(json: Column) -> Column:
    """A JSON object's top-level entries but for the content's own."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin("_model", "_path", "copy")))


def status_label(status: Column) -> Column:
    return F.when(status == "PARTIALLY_ENRICHED", "ENRICHMENT COMPLETE").otherwise(status)


def upload_status(source_uri: Column) -> Column:
    return F.when(F.startswith(source_uri, F.lit("file-upload:")), "FILE_UPLOAD_RECEIVED").when(F.startswith(source_uri, F.lit("classpath:")), "CLASSPATH_CONTENT_RECEIVED").otherwise("API_PAYLOAD_RECEIVED")


def clean_list(xs: Column) -> Column:
    """Trimmed, without blanks, each value once in order."""
    return F.array_distinct(F.filter(F.transform(xs, strip), lambda x: x != ""))


def to_list(x: Column) -> Column:
    """A JSON array's strings, or the parts between commas, semicolons, bars and >."""
    t = strip(x)
    return clean_list(F.when(t.rlike(r"^\[.*\]$"), F.from_json(t, "array<string>")).otherwise(F.split(t, r"[,;|>]")))


def list_text(xs: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.transform(xs, strip), lambda x: x != ""), ", "), F.lit(""))


def changed_fields(pairs: Mapping[str, tuple[Column, Column]], lists: Sequence[str] = ("keywords", "tags")) -> Column:
    """Names of the fields whose two values differ; a null list equals an empty one, order counts."""
    out = []
    for name, (a, b) in pairs.items():
        if name in lists:
            empty = F.array().cast("array<string>")
            a, b = F.coalesce(a, empty), F.coalesce(b, empty)
        out.append(F.when(~a.eqNullSafe(b), F.lit(name)))
    return F.array_compact(F.array(*out))


def distance_score(d: Column) -> Column:
    return F.when(F.isnan(d) | (d < 0), 0.0).otherwise(1 / (1 + d))


def section_key(x: Column) -> Column:
    return F.lower(_found(x, r"(?i)\b([a-z0-9]+(?:-[a-z0-9]+)*-section(?:-[a-z0-9]+)*)\b"))


def cosine_distance(a: Column, b: Column, norm_b: float | None = None) -> Column:
    """1 - cosine similarity; NaN for a zero vector. `norm_b` is the second vector's norm, where it is known."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if norm_b is None else F.lit(norm_b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / norm)


def match_terms(*xs: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*map(blank_to_null, xs))))


def locale_of_geo(geo: Column) -> Column:
    """en_ and a country of two letters; WW is en_US, all else null."""
    g = F.upper(blank_to_null(geo))
    return F.when(F.char_length(g) != 2, None).when(g == "WW", "en_US").otherwise(F.concat(F.lit("en_"), g))


def storefront_path(locale: Column) -> Column:
    """/country/ for English, /country/language/ for others, /us/ for what is no locale."""
    t = normalize_locale(locale)
    language, country = F.lower(F.substring(t, 1, 2)), F.lower(F.substring(t, 4, 1000))
    short = F.concat(F.lit("/"), country, F.lit("/"))
    return F.when(t.isNull() | (F.char_length(t) < 5), "/us/").when(language == "en", short).otherwise(F.concat(short, language, F.lit("/")))


def absolute_url(path: Column, prefix: str) -> Column:
    """http urls as they are, paths after `prefix` and one slash; blank is null."""
    t = blank_to_null(path)
    full = F.startswith(t, F.lit("http://")) | F.startswith(t, F.lit("https://"))
    return F.when(full, t).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(t, "^/", "")))


def status_alias(status: Column) -> Column:
    """The state that another name stands for; other names stay, in capitals."""
    s = F.upper(strip(status))
    for name, others in STATUS_ALIASES.items():
        s = F.when(s.isin(*others), name).otherwise(s)
    return s


def progress(status: Column, n_done: Column, n_all: Column) -> Column:
    """Per cent by the state's position (20 for unknown ones), or by the share of annotated items if that is more."""
    base = F.coalesce(*[F.when(status == x, F.lit((i + 1) * 100.0 / len(STATUS_ORDER))) for i, x in enumerate(STATUS_ORDER)], F.lit(20.0))
    by_items = F.when((n_all > 0) & (n_done > 0), 60 + n_done / n_all * 35)
    return F.when(status.isin("ENRICHMENT_COMPLETE", "ENRICHED_NO_ITEMS_TO_PROCESS"), 100.0).otherwise(F.greatest(base, by_items))
