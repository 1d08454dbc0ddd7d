"""Named queries over the driver's tables, each an operator at its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, locales
from ..functions import text as X
from ..operators import assets, chat, edits, fulltext, refine
from ..operators import lifecycle as L
from ..operators import search as S
from ..operators import versions as V
from ..session import ship
from ..sources import json_items, json_tree
from . import clicks, runs, upkeep

#: The query vector of the nearest-neighbour queries: 64 numbers by a rule that SQL can state too.
QUERY_VECTOR = [((i * 7) % 13 - 6) / 6 for i in range(64)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def previous_docs(spark: SparkSession, d: str) -> DataFrame:
    """An earlier version made by rule: every fifth document is missing, every seventh has another text."""
    rows = docs(spark, d).where("doc_id % 5 <> 0")
    return rows.select("doc_id", "source", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))


def cleanse_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.content_hash(X.cleanse(F.col("html"))).alias("cleansed_hash"))


def content_hash_dups(spark, d):
    return docs(spark, d).groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def delta_changed(spark, d):
    now = docs(spark, d).select("doc_id", "source", X.content_hash(F.col("text")).alias("content_hash"))
    old = previous_docs(spark, d).select("doc_id", "source", X.content_hash(F.col("text")).alias("content_hash"))
    return V.delta(now, old, ["doc_id", "source"], "content_hash").select("doc_id", "content_hash")


def delta_two_key_fallback(spark, d):
    """Keys of which some are null; the loose index keeps its last row."""
    rows = docs(spark, d).select("doc_id", F.nullif("source", F.lit("src3")).alias("source"), "lang", "n_chars")
    known = rows.withColumn("doc_id", F.col("doc_id") * 2)
    found = V.lookup_with_fallback(rows.select("doc_id", "source", "lang"), known, ["doc_id", "source"], ["source", "lang"], ["n_chars"], F.col("doc_id"))
    return found.select("doc_id", "source", "lang", F.col("found.n_chars").alias("found"))


def dedup_keep_first(spark, d):
    return V.first_per(table(spark, d, "conversations"), ["conv_id", "role"], F.col("turn").asc()).select("conv_id", "role", "turn", "text")


def last_wins(spark, d):
    return V.last_wins(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


def latest_version(spark, d):
    return V.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def previous_version(spark, d):
    return V.previous_version(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", F.col("previous_version").alias("previous_turn"))


def mark_latest(spark, d):
    return V.mark_latest(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


def assign_version(spark, d):
    """Some sources and some hashes are null, and rows repeat."""
    i, source = F.col("doc_id"), F.when(F.col("source") != "src3", F.col("source")).alias("source")
    hashed = docs(spark, d).select(i, source, F.when(i % 10 < 8, X.content_hash(F.col("text"))).alias("content_hash"))
    stored = hashed.where("doc_id % 2 = 0 and (doc_id % 10 < 8 or source < 'src4')").select("source", "content_hash").distinct()
    stored = stored.withColumn("version", F.row_number().over(Window.partitionBy("source").orderBy("content_hash")))
    incoming = hashed.where("doc_id % 2 = 1").select("source", "content_hash")
    return V.assign_version(incoming, stored, "source", "content_hash").select("source", "content_hash", "version")


def chunk_sentences(spark, d):
    return L.chunk_rows(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("chunk_text")).alias("n_chars"))


def missing_embeddings(spark, d):
    return L.without_chunks(docs(spark, d).select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def fifo_claim(spark, d):
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.claim(table(spark, d, "orders"), items, "o_orderkey", "o_orderstatus", "o_orderdate", 100).select("o_orderkey", "o_orderdate")


def status_counts(spark, d):
    return L.status_counts(table(spark, d, "events"), "event_type")


def _status() -> Column:
    return F.when(F.col("event_type") == "error", "ERROR_X").when(F.col("event_type") == "view", "ENRICHMENT_SKIPPED").when(F.col("event_type") == "purchase", "ENRICHED").otherwise("OTHER")


def final_status(spark, d):
    rows = table(spark, d, "events").select("user_id", _status().alias("status"), (F.col("user_id") % 2 == 0).alias("ready"))
    return L.final_status(rows, "status", F.col("ready"), "user_id")


def distinct_pairs(spark, d):
    return docs(spark, d).where("source <> '' and lang <> ''").select("source", "lang").distinct()


def grouped_locales(spark, d):
    rows = docs(spark, d).select(F.concat("lang", F.lit("_"), F.when(F.col("lang") == "en", F.when(F.col("doc_id") % 3 == 0, "IN").when(F.col("doc_id") % 3 == 1, "AU").otherwise("US")).when(F.col("lang") == "es", "MX").otherwise(F.upper("lang"))).alias("locale"))
    return L.grouped_locales(rows, "locale").select("geo", F.array_join("locales", ",").alias("locales"))


def geo_groups(spark, d):
    country = F.upper(F.substring("n_name", 1, 2))
    return table(spark, d, "nation").select("n_nationkey", country.alias("country"), X.geo_group(country).alias("geo"))


def optional_filter_page(spark, d):
    rows = table(spark, d, "orders")
    wanted = S.every([*S.optional_equal(F.col("o_orderstatus"), "o"), *S.optional_equal(F.col("o_orderpriority"), None)])
    return S.page_of(rows.where(wanted), [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], 2, 50).rows.select("o_orderkey", "o_orderdate")


def site_filter(spark, d):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return table(spark, d, "pages").where(S.every(S.site_matches(host, [F.col("url")], "en"))).select("page_id", "url")


def json_path_filter(spark, d):
    return table(spark, d, "events").where(S.every(S.json_filters(F.col("props"), {"k": ["1", "5", "69"]}))).select("event_id", "props")


def array_contains_all(spark, d):
    return docs(spark, d).where(S.has_all(F.split("text", " "), ["of", "the", "and"])).select("doc_id")


def _vectors(spark, d) -> DataFrame:
    """The embeddings, and after each two rows that are no neighbours: without a vector, and with one that is too short."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    bad = rows.select((-F.col("vec_id") - 1).alias("vec_id"), F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 63)).alias("embedding"), "label")
    return rows.unionByName(bad)


def vector_topk(spark, d):
    return S.nearest(_vectors(spark, d), "embedding", QUERY_VECTOR, 200, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


def vector_filtered(spark, d):
    return S.nearest(table(spark, d, "embeddings"), "embedding", QUERY_VECTOR, 50, "vec_id", [F.col("label") == 1], 1.05).select("vec_id", F.round("distance", 6).alias("distance"))


def chip_scores(spark, d):
    rows = S.nearest(table(spark, d, "embeddings"), "embedding", QUERY_VECTOR, 200, "vec_id").withColumn("section", F.floor(F.col("vec_id") / 2))
    made = F.array(F.struct(F.lit("tag").alias("type"), F.concat(F.lit("t"), F.col("label")).alias("value")), F.struct(F.lit("parity").alias("type"), (F.col("vec_id") % 2).cast("string").alias("value")))
    return S.chips(rows, made, "section", "distance").select("type", "value", F.round("score", 6).alias("score"), "count")


def merge_ranked_lists(spark, d):
    vectors = S.nearest(table(spark, d, "embeddings"), "embedding", QUERY_VECTOR, 30, "vec_id").select((F.col("vec_id") % 40).alias("key"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("pos"))
    texts = docs(spark, d).select((F.col("doc_id") % 55).alias("key"), (F.col("doc_id") + 1).cast("int").alias("pos"))
    return V.merge_ranked([vectors, texts], ["key"], "pos", 40).select("cf_id", "key")


def usage_fanout(spark, d):
    elements = table(spark, d, "orders").select("o_orderkey", F.lit("own").alias("default_usage"))
    usages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("u"), F.col("l_suppkey")).alias("usage"))
    return L.usage_fanout(elements, usages, ["o_orderkey"], "usage", "default_usage").select("o_orderkey", "usage")


def revision_append(spark, d):
    rows = table(spark, d, "conversations")
    stored = rows.where("turn < 2").select("conv_id", (F.col("turn") + 1).cast("int").alias("revision"))
    return L.append_revisions(stored, rows.where("turn >= 2").select("conv_id", "turn"), "conv_id", F.col("turn")).select("conv_id", "turn", "revision")


def save_annotated(spark, d):
    """All documents stored, and all again under ids that go on from 300: some meet stored ones, others are new."""
    stored = docs(spark, d).select("doc_id", F.col("lang").alias("summary"), F.col("source").alias("kept"), (F.col("doc_id") % 4 == 0).alias("user_override_active"), F.lit(False).alias("new_ai_available"))
    incoming = docs(spark, d).select((F.col("doc_id") + 300).alias("doc_id"), F.concat(F.lit("new "), F.col("source")).alias("summary"))
    return L.save_annotated(stored, incoming, ["doc_id"], ["summary"])


def consolidate(spark, d):
    keys = ["source", "lang"]
    stored = docs(spark, d).where("doc_id % 11 = 0").select(*keys).distinct()
    return L.consolidate(docs(spark, d).select(*keys), stored, keys)


def observe_locales(spark, d):
    """Two stored rows for each source and language, of which one goes on; seen are these and others."""
    stored = docs(spark, d).groupBy("source", "lang", (F.col("doc_id") % 2).alias("half")).agg(F.max("doc_id").alias("last_seen_at"), F.count("*").alias("seen_count")).withColumn("active", F.lit(True))
    seen = docs(spark, d).select(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat("source", F.lit("b"))).alias("source"), "lang", (F.col("doc_id") + 5).alias("seen_at"))
    return L.observe(stored, seen, ["source", "lang"])


def key_replace(spark, d):
    stored = docs(spark, d).select(F.nullif("doc_id", F.lit(7)).alias("doc_id"), F.lit("old").alias("state"))
    return V.replace_keys(stored, docs(spark, d).select(F.nullif(F.col("doc_id") + 300, F.lit(301)).alias("doc_id"), F.lit("new").alias("state")), ["doc_id"])


def locale_from_url(spark, d):
    path = F.concat(F.regexp_replace("url", r"/(en|fr|de|es)/", "/$1_US/"), F.lit("/"))
    return table(spark, d, "pages").select("page_id", X.path_locale(path).alias("locale"), X.slugify(F.col("url")).alias("slug"))


def scalar_functions(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", X.event_tag(t).alias("event"), X.is_excluded(F.col("source")).alias("excluded"), X.joined_hash(F.col("source"), F.lit(None), F.col("lang")).alias("slot_hash"), X.upload_status(F.concat(F.lit("file-upload:"), F.col("source"))).alias("status"), F.array_join(X.to_list(F.concat_ws("|", "lang", "source", "lang")), ",").alias("parts"), F.round(X.distance_score(F.col("n_chars") / 100.0), 6).alias("score"))


def storefront_paths(spark, d):
    country = F.upper(F.substring("n_name", 1, 2))
    locale = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "fr").otherwise("EN"), F.lit("-"), country)
    return table(spark, d, "nation").select("n_nationkey", X.locale_of_geo(country).alias("locale"), X.storefront_path(locale).alias("path"), X.absolute_url(X.storefront_path(locale), "http://example.com").alias("url"))


def user_progress(spark, d):
    status = F.when(F.col("user_id") % 4 == 0, "Enrichment_Queued").when(F.col("user_id") % 4 == 1, "ENRICHMENT_STARTED").when(F.col("user_id") % 4 == 2, "COMPLETED").otherwise("other")
    counted = table(spark, d, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "purchase").cast("long")).alias("n_done"), F.count("*").alias("n_all"))
    return counted.select("user_id", X.status_alias(status).alias("status"), X.progress(X.status_alias(status), F.col("n_done"), F.col("n_all")).alias("progress"))


def full_text_meta(spark, d):
    """Stop words and marks count for nothing, forms of a word for one."""
    return fulltext.full_text(docs(spark, d), ["text"], '"the idiots" -garbage !!! or trashing or zzz ...').select("doc_id")


def full_text_index(spark, d):
    """The same language over a positional index: phrases with their distances, exclusions, alternatives."""
    rows = docs(spark, d)
    return fulltext.search(fulltext.index(rows, "doc_id", ["text"]), rows, "doc_id", '"onst the things" -idiot or "then thor" -thing or scum -idiot -trash')


def _page_json(spark, d) -> DataFrame:
    node = F.struct(F.col("url").alias("_path"), F.lit("hero-section").alias("_model"), F.struct(F.col("html").alias("copy")).alias("headline"), F.array(F.lit("first"), F.lit("second")).alias("text"), F.struct(F.struct(F.col("url").alias("uri")).alias("viewportSmall"), F.lit("a picture").alias("alt")).alias("heroImage"))
    return table(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id")).alias("source_uri"), F.to_json(node).alias("json"))


def page_tree_extract(spark, d):
    return json_items.extract_items(_page_json(spark, d)).select("source_uri", "ordinal", "source_path", "item_type", "usage_path", "cleansed")


def page_assets(spark, d):
    return json_items.extract_assets(_page_json(spark, d)).select("source_uri", "asset_key", "preview_uri", "alt_text")


def annotate_stub(spark, d):
    done = L.annotate(docs(spark, d).select("doc_id", "text"), "text")
    return done.select("doc_id", "annotation.summary", L.is_valid(F.col("annotation")).alias("valid"))


def embed_stub(spark, d):
    """Vectors of word counts by a rule that SQL can state too."""
    return L.embed(docs(spark, d).select("doc_id", "text"), "text", L.embed_letters).select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def _sections(spark, d) -> DataFrame:
    """Sections made of documents: paths with tenant, locale, page and section; two tags; a context."""
    key, page = F.concat("source", F.lit("-section")), F.concat(F.lit("page"), F.col("doc_id") % 5)
    path = F.concat(F.lit("/content/dam/acme/"), "lang", F.lit("_"), F.upper("lang"), F.lit("/"), page, F.lit("/"), key)
    field = F.when(F.col("doc_id") % 3 == 0, "headline").when(F.col("doc_id") % 3 == 1, "copy").otherwise("body")
    context = F.to_json(F.struct(page.alias("pageId"), F.struct(key.alias("sectionKey")).alias("facets"), F.struct(F.col("lang").alias("language")).alias("envelope")))
    tags = F.array(F.col("lang"), F.concat(F.lit("t"), F.col("doc_id") % 2))
    return docs(spark, d).select(F.col("doc_id").alias("id"), path.alias("section_path"), path.alias("section_uri"), field.alias("original_field_name"), F.col("text").alias("cleansed_text"), F.lit("").alias("summary"), F.lit("").alias("classification"), tags.alias("tags"), F.array().cast("array<string>").alias("keywords"), context.alias("context"), F.timestamp_seconds(F.col("doc_id")).alias("saved_at"))


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("section_id"), F.col("embedding").alias("vector"), F.lit("copy").alias("source_field"))


def chat_search(spark, d):
    asked = chat.Request("src3-section headline in page3")
    return chat.answer(asked, _chunks(spark, d), _sections(spark, d), lambda _: QUERY_VECTOR).select("cf_id", "id", "content_role", "source", "page_id", F.array_join("match_terms", ",").alias("terms"))


def chat_relaxed(spark, d):
    """No section has the locale that is asked for, so the third level answers: without role, locale and context."""
    asked = chat.Request("src3-section headline in page3 ja-JP")
    return chat.answer(asked, _chunks(spark, d), _sections(spark, d), lambda _: QUERY_VECTOR).select("cf_id", "id", "content_role", "source", "page_id", F.array_join("match_terms", ",").alias("terms"))


def display_fields(spark, d):
    shown = chat.display_fields(_sections(spark, d), F.lit("sections"), locales.aliases(spark))
    return shown.select("id", "tenant", "page_id", "locale", "language", "country", "content_role")


def refine_chips(spark, d):
    return refine.ranked(_chunks(spark, d), _sections(spark, d), QUERY_VECTOR, "copy for src3-section").select("type", "value", F.round("score", 5).alias("score"), "count")


def section_search(spark, d):
    found = chat.metadata_arm(_sections(spark, d), chat.Criteria(section="src1-section"), 40)
    return found.select("id", "section_path")


def country_codes(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat("lang", F.lit("-"), F.when(F.col("doc_id") % 4 == 0, "Germany").when(F.col("doc_id") % 4 == 1, "FRA").when(F.col("doc_id") % 4 == 2, "mx").otherwise("nowhere")).alias("place"))
    return locales.with_code(locales.with_code(rows, "place", "language", "language"), "place", "country", "country").select("doc_id", "language", "country")


def _elements(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("summary"), none.alias("classification"), F.array(F.col("source")).alias("keywords"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("user_override_active"), F.lit(True).alias("new_ai_available"))


def _edits(spark, d) -> DataFrame:
    """Of every second document: a new summary for some, a blank or null one for others, tags with a repeat."""
    i = F.col("doc_id")
    summary = F.when(i % 4 == 0, F.lit(" new ")).when(i % 8 == 2, F.lit("  "))
    return docs(spark, d).where(i % 2 == 0).select(i.alias("id"), summary.alias("summary"), F.lit(None).cast("string").alias("classification"), F.lit(None).cast("array<string>").alias("keywords"), F.when(i % 3 == 0, F.array(F.lit("a "), F.lit(""), F.lit("a"), F.lit("b"))).alias("tags"))


def manual_edit(spark, d):
    elements = _elements(spark, d)
    done = edits.apply(elements, edits.changes(elements, _edits(spark, d)))
    return done.select("id", "summary", F.array_join("tags", ",").alias("tags"), "user_override_active", "new_ai_available")


def edit_revisions(spark, d):
    changed = edits.changes(_elements(spark, d), _edits(spark, d))
    stored = docs(spark, d).where("doc_id % 6 = 0").select(F.col("doc_id").alias("element_id"), F.lit(2).alias("revision"))
    return edits.record(stored, changed, "USER").select("element_id", "revision", "source", F.array_join("updated_fields", ",").alias("updated_fields"))


def _occurrences(spark, d) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, d, "orders").select(i.alias("id"), (i % 100).alias("catalog_id"), F.lit("acme").alias("tenant"), F.lit("prod").alias("environment"), F.col("o_orderpriority").alias("project"), F.when(i % 3 == 0, "Shop").otherwise("").alias("site"), F.when(i % 2 == 0, "DE").otherwise("FR").alias("geo"), F.when(i % 2 == 0, "de_DE").otherwise("fr_FR").alias("locale"), F.concat(F.lit("/x/"), F.when(i % 5 == 0, "shop").otherwise("y"), F.lit("/z")).alias("section_path"), F.lit("s").alias("source_uri"), F.col("o_orderdate").alias("created_at"))


def asset_search(spark, d):
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/p/"), F.col("p_partkey")).alias("preview_uri"))
    found = assets.search(_occurrences(spark, d), catalog, assets.Wanted(tenant="ACME", site="shop", geo="Europe", page=1, size=30), {"Europe": "de-de"}, "http://example.com")
    return found.rows.select("id", "locale", "preview_uri")


def asset_options(spark, d):
    return assets.options(["Home", "shop"], _occurrences(spark, d), "project")


def region_observations(spark, d):
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(i, F.when(i % 3 == 0, "de").alias("geo"), F.when(i % 3 == 1, "fr-fr").when(i % 6 == 2, "en-GB").alias("locale"))
    return assets.observations(rows, i, None, "ja-JP")


def json_nodes(spark, d):
    return json_tree.nodes(_page_json(spark, d)).select("source_uri", "ordinal", "id", "parent", "type")


def tree_filter(spark, d):
    return json_tree.filtered(json_tree.nodes(_page_json(spark, d)), "VIEWPORT").select("source_uri", "id")


def json_metadata(spark, d):
    made = F.to_json(F.struct(F.struct(F.concat("lang", F.lit("-us")).alias("localeCode")).alias("a"), F.array(F.struct(F.col("source").alias("page_id"))).alias("b")))
    return json_tree.metadata(docs(spark, d).select(F.col("doc_id").cast("string").alias("source_uri"), made.alias("json")))


def simple_extract(spark, d):
    section = F.struct(F.lit("hero").alias("_model"), F.concat("source", F.lit("<b>!")).alias("copy"), F.array(F.struct(F.col("lang").alias("value"))).alias("analyticsAttributes"))
    made = F.to_json(F.struct(F.struct(F.array(section).alias("sections"), F.struct(F.array(F.struct(F.col("source").alias("copy"))).alias("items")).alias("disclaimers")).alias("content")))
    return json_tree.simple_items(docs(spark, d).select(F.col("doc_id").cast("string").alias("source_uri"), made.alias("json")))


def label_functions(spark, d):
    i, source = F.col("doc_id"), F.col("source")
    uri = F.concat(F.when(i % 3 == 0, "file-upload:").when(i % 3 == 1, "x-api-").otherwise("classpath:"), source)
    name = F.concat(source, F.lit("_"), "lang", F.when(i % 2 == 0, "_US.json").otherwise(".json"))
    return docs(spark, d).select("doc_id", labels.source_label(labels.source_type(F.lit(None).cast("string"), uri)).alias("source_label"), labels.bytes_label(F.col("n_chars")).alias("size"), labels.path_label(F.concat(F.lit("/a ::ref:: /b/"), source, F.lit("-section/"))).alias("path_label"), labels.filename_locale(name).alias("locale"), labels.is_hidden(F.concat(F.when(i % 2 == 0, "Alt").otherwise("salt"), F.lit("[0]"))).alias("hidden"), labels.is_skipped(F.when(i % 2 == 0, "not-enriched")).alias("skipped"))


def element_groups(spark, d):
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/p/"), "source", F.lit("-x"))).alias("path"), F.when(F.col("doc_id") % 3 == 1, F.upper("lang")).alias("title"))
    return L.element_groups(rows, "doc_id")


def status_history(spark, d):
    named = F.when(F.col("event_type") == "click", "enriched").when(F.col("event_type") == "view", "WAITING_FOR_AI_OUTPUT").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "seen")
    return L.status_history(table(spark, d, "events").select("user_id", named.alias("state"), "event_id"), "user_id", "state", "event_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Cleanse, hash, compare with the previous version, chunk what changed."""
    now = docs(spark, d).select("doc_id", "source", X.cleanse(F.col("text")).alias("cleansed"))
    old = previous_docs(spark, d).select("doc_id", "source", X.content_hash(X.cleanse(F.col("text"))).alias("content_hash"))
    changed = V.delta(now.withColumn("content_hash", X.content_hash(F.col("cleansed"))), old, ["doc_id", "source"], "content_hash")
    return L.chunk_rows(changed, "doc_id", "cleansed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cleanse_html, content_hash_dups, delta_changed, delta_two_key_fallback, dedup_keep_first, last_wins, latest_version, previous_version, mark_latest, assign_version, chunk_sentences, missing_embeddings, fifo_claim,
        status_counts, final_status, distinct_pairs, grouped_locales, geo_groups, optional_filter_page, site_filter, json_path_filter, array_contains_all, vector_topk, vector_filtered, chip_scores, merge_ranked_lists, usage_fanout,
        revision_append, save_annotated, consolidate, observe_locales, key_replace, locale_from_url, scalar_functions, storefront_paths, user_progress, full_text_meta, full_text_index, page_tree_extract, page_assets, chat_search, chat_relaxed, display_fields, refine_chips, section_search, country_codes,
        manual_edit, edit_revisions, asset_search, asset_options, region_observations, json_nodes, tree_filter, json_metadata, simple_extract, label_functions, element_groups, status_history, annotate_stub, embed_stub, flagship,
    )
} | runs.QUERIES | upkeep.QUERIES | clicks.QUERIES
