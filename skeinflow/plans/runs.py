"""Queries of the extractor on rich documents, of the ingest and annotation runs and of the views, over whole tables; and their SQL.

Jobs, items, elements, sections and chunks are made of orders and lineitem by rules that the SQL states too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import enrich, ingest, store, views
from ..session import ship
from ..sources import json_items

QUERY_VECTOR = [((i * 7) % 13 - 6) / 6 for i in range(64)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- documents of the content format, one for each page


def rich_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents with every kind of field: provenance, icon, image, disclaimers, analytics, arrays, inner paths, nulls."""
    i = F.col("page_id")
    path = F.concat(F.lit("/content/dam/acme/"), F.when(i % 2 == 0, "en_US").otherwise("fr-FR"), F.lit("/page"), i)
    copy = lambda x: F.struct(x.alias("copy"))
    shown = F.struct(F.col("url").alias("uri2x"), F.concat("url", F.lit("?1x")).alias("_uri_path"))
    image = F.struct(F.lit("hidden").alias("_secret"), F.lit("a~b/c").alias("alt"), shown.alias("viewportMedium"), F.array(F.lit("x"), F.lit("y")).alias("sizes"))
    group = F.struct(F.array(copy(F.concat(F.lit("Tax <b>note"), F.lit("</b> "), i)), copy(F.lit("second"))).alias("items"))
    inner = F.struct(F.concat(path, F.lit("/inner-section")).alias("_path"), F.lit("tile-section").alias("_model"), F.lit("/given").alias("_usagePath"), F.array(copy(F.lit(" Christmas ")), copy(F.lit("plain"))).alias("text"), F.struct(F.lit("go").alias("text"), F.lit("/at").alias("_path")).alias("url"))
    tags = F.array(F.struct(F.lit("event").alias("name"), F.col("url").alias("value")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("v").alias("value")))
    node = F.struct(
        path.alias("_path"), F.lit("hero-section").alias("_model"), F.struct(F.col("url").alias("by")).alias("_provenance"), F.lit(5).alias("weight"), F.struct(F.lit("/i").alias("_uri_path"), F.lit("no").alias("_x"), F.lit("star").alias("name")).alias("icon"),
        image.alias("heroImageDesktop"), copy(F.col("html")).alias("headline"), F.lit("{%nbsp%}bare{%br%}").alias("copy"), F.array(group, group).alias("disclaimers"), tags.alias("analyticsTags"), F.array(inner, inner).alias("tiles"), F.lit(None).cast("string").alias("text"),
    )
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("page:"), i).alias("source_uri"), F.to_json(node, {"ignoreNullFields": "false"}).alias("json"))


def content_items(spark, d):
    items = json_items.extract_items(rich_documents(spark, d))
    facet = lambda k: F.col("facets")[k]
    return items.select(
        "source_uri", "ordinal", "source_path", "item_type", "usage_path", "model", "locale", "language", "country", "section_name", F.size("path_hierarchy").alias("depth"), F.element_at("provenance", "by").alias("by"), "cleansed", "content_hash", "skip_enrichment", "is_analytics",
        facet("sectionKey").alias("section_key"), facet("sectionIndex").alias("section_index"), facet("icon._uri_path").alias("icon"), facet("heroImageDesktop.viewportMedium.uri2x").alias("image"), facet("heroImageDesktop.sizes[1]").alias("size"), facet("eventType").alias("event"), F.size("facets").alias("n_facets"),
    )


def content_assets(spark, d):
    found = json_items.first_by_slot(json_items.extract_assets(rich_documents(spark, d)))
    return found.select("source_uri", "ordinal", "asset_key", "node_path", "section_path", "preview_uri", "alt_text", "slot_key", F.get_json_object("viewports", "$.viewportMedium.uri2x").alias("viewport"), F.get_json_object("viewports", "$.default._uri_path").alias("direct"))


def item_counters(spark, d):
    return json_items.counters(json_items.extract_items(rich_documents(spark, d)))


def item_view(spark, d):
    items = json_items.extract_items(rich_documents(spark, d))
    return views.item_rows(views.visible_items(items)).select("source_uri", "ordinal", "field", "cleansed")


_CLEAN = r"trim(regexp_replace(replace(regexp_replace({x}, '<[^>]+?>', ' ', 'g'), chr(160), ' '), '[ \t\n\v\f\r]+', ' ', 'g'))"
_PATH = "'/content/dam/acme/' || CASE WHEN page_id % 2 = 0 THEN 'en_US' ELSE 'fr-FR' END || '/page' || page_id"
#: ordinal, item type, place (0 the page, 1 the inner section, 2 its url), analytics, index of the inner section, facets besides the common ones, event by rule
_ITEMS = f"""
p AS (SELECT page_id, url, 'page:' || page_id AS source_uri, {_PATH} AS path, {_CLEAN.format(x="html")} AS html FROM pages),
n AS (SELECT * FROM (VALUES (0, 'headline', 0, false, NULL), (1, '#', 0, false, NULL), (2, 'disclaimer[0][0]', 0, false, NULL), (3, 'disclaimer[0][1]', 0, false, NULL), (4, 'disclaimer[1][0]', 0, false, NULL), (5, 'disclaimer[1][1]', 0, false, NULL),
  (6, 'analytics[event]', 0, true, NULL), (7, 'analytics[1]', 0, true, NULL), (8, 'text[0]', 1, false, 0), (9, 'text[1]', 1, false, 0), (10, 'url', 2, false, 0), (11, 'text[0]', 1, false, 1), (12, 'text[1]', 1, false, 1), (13, 'url', 2, false, 1)) AS t(ordinal, item_type, place, is_analytics, idx)),
i AS (SELECT *, CASE ordinal WHEN 0 THEN html WHEN 1 THEN 'bare' WHEN 6 THEN url WHEN 7 THEN 'v' WHEN 8 THEN 'Christmas' WHEN 11 THEN 'Christmas' WHEN 9 THEN 'plain' WHEN 12 THEN 'plain' WHEN 10 THEN 'go' WHEN 13 THEN 'go' WHEN 3 THEN 'second' WHEN 5 THEN 'second' ELSE 'Tax note ' || page_id END AS cleansed,
  CASE place WHEN 0 THEN path WHEN 1 THEN path || '/inner-section' ELSE '/at' END AS source_path FROM p, n)"""
_EVENT = "CASE WHEN contains(lower({x}), 'valentine') THEN 'Valentine day' WHEN contains(lower({x}), 'father''s day') THEN 'Fathers day' WHEN contains(lower({x}), 'tax') THEN 'Tax day' WHEN contains(lower({x}), 'christmas') THEN 'Christmas' WHEN contains(lower({x}), 'mothers') THEN 'Mothers day' END"
_SKIP = "regexp_matches(lower(item_type), '^(analytics|disclaimers|alt|url|accessibilitytext|pageanalytics)')"


# ---- the ingest run


def _raw(spark, d) -> DataFrame:
    """Version 1 of three quarters of the pages; of the eighth part its text is blank."""
    node = F.struct(F.concat(F.lit("/p/"), "page_id").alias("_path"), F.struct(F.col("html").alias("copy")).alias("headline"), F.array(F.lit("a"), F.lit("b")).alias("text"))
    rows = table(spark, d, "pages").where("page_id % 4 <> 3")
    return rows.select(F.concat(F.lit("page:"), "page_id").alias("source_uri"), F.lit(1).alias("version"), F.when(F.col("page_id") % 8 == 1, " ").otherwise(F.to_json(node)).alias("json"))


def _current(spark, d) -> DataFrame:
    """All pages: a third with another headline, a fifth with another second text; those without a version 1 enter with it. One in 13 isn't JSON."""
    i = F.col("page_id")
    node = F.struct(F.concat(F.lit("/p/"), "page_id").alias("_path"), F.struct(F.concat("html", F.when(i % 3 == 0, "!").otherwise("")).alias("copy")).alias("headline"), F.array(F.lit("a"), F.when(i % 5 == 0, "B").otherwise("b")).alias("text"))
    return table(spark, d, "pages").select(F.concat(F.lit("page:"), i).alias("source_uri"), F.when(i % 4 == 3, 1).otherwise(2).alias("version"), F.when(i % 13 == 12, "{broken").otherwise(F.to_json(node)).alias("json"))


def _hashes(spark, d) -> DataFrame:
    """Global hashes of the second texts, for blank versions: under the item's key, or under another usage path only."""
    i = F.col("page_id")
    path = F.concat(F.lit("/p/"), i)
    usage = F.when(i % 2 == 0, "elsewhere").otherwise(F.concat(F.lit("page:"), i, F.lit(X.REF), path))
    return table(spark, d, "pages").select(path.alias("source_path"), F.lit("text[1]").alias("item_type"), usage.alias("usage_path"), F.sha2(F.lit("b"), 256).alias("content_hash"), F.lit(None).cast("string").alias("context_hash"))


def _run(spark, d) -> ingest.Run:
    hashes = _hashes(spark, d)
    versions = hashes.select(F.lit("none").alias("source_uri"), F.lit(1).alias("version"), "*").where("source_path is null")
    return ingest.run(_current(spark, d), _raw(spark, d), hashes, versions, at=F.lit("2020-01-01").cast("timestamp"))


def ingest_changed(spark, d):
    return _run(spark, d).changed.select("source_uri", "version", "ordinal", "item_type", "content_hash")


def ingest_statuses(spark, d):
    return _run(spark, d).cleansed.select("source_uri", "version", "status", "error", "n_items")


def ingest_hashes(spark, d):
    return _run(spark, d).hashes.select("source_path", "item_type", "usage_path", "content_hash")


_INGEST = f"""
p AS (SELECT page_id, 'page:' || page_id AS source_uri, CASE WHEN page_id % 4 = 3 THEN 1 ELSE 2 END AS version, {_CLEAN.format(x="html")} AS old, {_CLEAN.format(x="html || CASE WHEN page_id % 3 = 0 THEN '!' ELSE '' END")} AS new FROM pages),
i AS (SELECT *, sha256(cleansed) AS content_hash FROM (SELECT page_id, source_uri, version, ordinal, item_type, CASE ordinal WHEN 0 THEN new WHEN 1 THEN 'a' WHEN 2 THEN CASE WHEN page_id % 5 = 0 THEN 'B' ELSE 'b' END END AS cleansed, CASE ordinal WHEN 0 THEN old WHEN 1 THEN 'a' ELSE 'b' END AS before
  FROM p, (VALUES (0, 'headline'), (1, 'text[0]'), (2, 'text[1]')) AS t(ordinal, item_type) WHERE page_id % 13 <> 12)),
c AS (SELECT * FROM i WHERE version = 1 OR CASE WHEN page_id % 8 = 1 THEN ordinal < 2 OR cleansed <> 'b' ELSE cleansed <> before END)"""


# ---- the annotation run


def _jobs(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "ENRICHMENT_QUEUED").when(F.col("o_orderstatus") == "F", "ENRICHED_COMPLETE").otherwise("ENRICHMENT_IN_PROGRESS")
    source = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("src"), F.col("o_custkey") % 50))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), source.alias("source_uri"), (1 + F.col("o_orderkey") % 3).cast("int").alias("version"), status.alias("status"), F.col("o_orderdate").alias("cleansed_at"))


def _place() -> tuple[Column, Column]:
    return F.concat(F.lit("/p/"), F.col("l_partkey") % 20), F.concat(F.lit("f"), F.col("l_linenumber") % 3)


def _items(spark, d) -> DataFrame:
    path, field = _place()
    text = F.concat(F.lit("text "), F.col("l_partkey") % 20 + F.col("l_linenumber") % 3 + F.col("l_orderkey") % 2)
    usage = F.concat(F.lit("/c/"), F.col("l_suppkey") % 4, F.lit(X.REF), path)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cleansed_id"), path.alias("source_path"), field.alias("original_field_name"), F.when(F.col("l_suppkey") % 3 != 0, usage).alias("usage_path"), text.alias("cleansed"), F.col("l_linenumber").alias("ordinal"))


def _elements(spark, d, *by: str) -> DataFrame:
    """Elements of every second job (a job's number is twice an order's), the first of each place by its smallest quantity."""
    path, field = _place()
    text = F.concat(F.lit("text "), F.col("l_partkey") % 20 + F.col("l_linenumber") % 3 + (F.col("l_orderkey") % 3 == 0).cast("int"))
    status = F.when(F.min("l_quantity") < 10, "ERROR_X").when(F.min("l_quantity") < 20, "ENRICHMENT_SKIPPED").otherwise("ENRICHED")
    lines = table(spark, d, "lineitem").withColumn("cleansed_id", F.col("l_orderkey") * 2)
    lines = lines.repartition(*by) if by else lines
    keyed = lines.select("cleansed_id", path.alias("item_source_path"), field.alias("item_original_field_name"), text.alias("cleansed_text"), (F.col("l_suppkey") % 50).alias("s"), F.col("l_quantity"))
    once = keyed.groupBy("cleansed_id", "item_source_path", "item_original_field_name", "cleansed_text").agg(F.min("s").alias("s"), status.alias("status"))
    none = F.lit(None).cast("string")
    return once.select(
        "cleansed_id", F.concat(F.lit("src"), "s").alias("source_uri"), (1 + F.col("s") % 3).cast("int").alias("version"), "item_source_path", "item_original_field_name", "cleansed_text", F.when(F.col("s") % 2 == 0, F.sha2("cleansed_text", 256)).alias("content_hash"), F.to_json(F.struct(F.struct(F.lit("/own").alias("usagePath")).alias("envelope"))).alias("context"),
        F.lit("old").alias("summary"), none.alias("classification"), F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("tags"), none.alias("sentiment"), "status", none.alias("enrichment_metadata"), (F.col("s") % 4 == 0).alias("user_override_active"), F.lit(False).alias("new_ai_available"),
    )


def to_annotate(spark, d):
    return enrich.to_annotate(_items(spark, d), _jobs(spark, d), _elements(spark, d)).select("cleansed_id", "source_path", "original_field_name", "cleansed")


def _done(spark, d) -> DataFrame:
    """Results for all places of all items."""
    once = _items(spark, d).groupBy("cleansed_id", "source_path", "original_field_name", "cleansed").agg(F.count("*").alias("n"))
    return once.select("cleansed_id", "source_path", "original_field_name", "cleansed", F.concat(F.lit("new "), "cleansed").alias("summary"), F.lit("c").alias("classification"), F.array(F.lit("k")).alias("keywords"), F.array(F.lit("t")).alias("tags"), F.lit("good").alias("sentiment"))


_KEYS = ["cleansed_id", "item_source_path", "item_original_field_name"]


def save_results(spark, d):
    done = enrich.save(_elements(spark, d), _done(spark, d), "model", F.lit("2020-01-01").cast("timestamp"))
    return done.select(*_KEYS, "cleansed_text", "summary", "sentiment", "status", "user_override_active", "new_ai_available", F.get_json_object("enrichment_metadata", "$.enrichedWithModel").alias("model"))


def save_failures(spark, d):
    done = enrich.save_error(_elements(spark, d), _done(spark, d), F.concat(F.lit("no answer for "), F.col("cleansed_text")))
    return done.select(*_KEYS, "cleansed_text", "summary", "status", "new_ai_available", F.get_json_object("enrichment_metadata", "$.enrichmentError").alias("error"))


def model_revisions(spark, d):
    none = spark.createDataFrame([], "element_id string, revision int")
    made = enrich.revisions(none, _elements(spark, d), _done(spark, d), "model")
    return made.select("element_id", "revision", "summary", "applied", "blocked_by")


def _usage_hashes(spark, d) -> DataFrame:
    """Distinct usages of all lines. They stand for a stored table that is asked several times, so they are made once."""
    path, field = _place()
    usage = F.concat(F.lit("/h/"), F.col("l_suppkey") % 2, F.lit(X.REF), F.lit("/u/"), F.col("l_suppkey") % 2)
    rows = table(spark, d, "lineitem").select(path.alias("source_path"), field.alias("item_type"), usage.alias("usage_path")).distinct().withColumn("content_hash", F.concat_ws("|", "source_path", "item_type", "usage_path"))
    return store.kept(rows)


def _no_sections(spark) -> DataFrame:
    return spark.createDataFrame([], "id string, cleansed_id long, version int, source_uri string, section_path string, section_uri string, original_field_name string, cleansed_text string, content_hash string, summary string, status string, saved_at timestamp")


def consolidate_run(spark, d):
    made = enrich.consolidated(_elements(spark, d), _items(spark, d), _usage_hashes(spark, d), _no_sections(spark))
    return made.select("version", "section_path", "section_uri", "original_field_name", "cleansed_text")


def section_hashes(spark, d):
    """The hash that each section gets: under its usage path, or else under path and field alone."""
    made = enrich.consolidated(_elements(spark, d), _items(spark, d), _usage_hashes(spark, d), _no_sections(spark))
    return made.groupBy("content_hash", "original_field_name").agg(F.count("*").alias("n"))


def _sections(spark, d) -> DataFrame:
    """A section for each line: state, text (some blank) and time by rule; sections 1, 3, 5 ... of the order have a chunk."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("saved_at"), F.min("l_quantity").alias("q"))
    text = F.when(F.col("l_linenumber") == 7, "  ").otherwise(F.concat(F.lit("Words of "), "l_orderkey", F.lit(".")))
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rows.select(i.alias("id"), F.col("l_orderkey").alias("cleansed_id"), F.lit("s").alias("source_uri"), F.concat(F.lit("/s/"), F.col("l_linenumber")).alias("section_path"), text.alias("cleansed_text"), F.when(F.col("q") < 25, "PENDING_EMBEDDING").otherwise("EMBEDDED").alias("status"), F.when(F.col("q") != 3, F.col("saved_at")).alias("saved_at"))


def _chunks(spark, d) -> DataFrame:
    rows = _sections(spark, d).where("id % 10 % 2 = 1")
    return rows.select(F.col("id").alias("section_id"), F.lit(0).alias("position"), F.col("cleansed_text").alias("chunk_text"), F.col("source_uri").alias("source_field"), "section_path", F.array(F.lit(0.0).cast("float")).alias("vector"))


def embedding_worker(spark, d):
    """One batch: sections and their states after it, those of the batch told by the vectors that they got."""
    done = enrich.embed_pending(_jobs(spark, d), _status_rows(spark, d), _sections(spark, d), _chunks(spark, d))
    made = done.chunks.join(done.sections.select(F.col("id").alias("section_id"), "status"), "section_id").where(F.size("vector") > 1)
    return made.select("section_id", "position", "chunk_text", "status")


def _status_rows(spark, d) -> DataFrame:
    return _elements(spark, d).select("cleansed_id", "status")


def missing_by_job(spark, d):
    return enrich.missing_embeddings(_sections(spark, d), _chunks(spark, d))


def chunk_delete(spark, d):
    jobs = _jobs(spark, d).where("status = 'ENRICHMENT_QUEUED'")
    return enrich.delete_chunks(_chunks(spark, d), _sections(spark, d), jobs).select("section_id", "position")


def claim_jobs(spark, d):
    """Compare and set: all jobs of even number are asked for, those in an eligible state are won."""
    jobs = _jobs(spark, d)
    return enrich.claim_status(jobs, jobs.where("id % 2 = 0"), enrich.ELIGIBLE, enrich.FINALIZING)[0].select("id", "status")


def final_job_statuses(spark, d):
    jobs = _jobs(spark, d)
    return enrich.final_statuses(jobs, _status_rows(spark, d), _sections(spark, d), _chunks(spark, d), jobs.select("id")).select("id", "status")


def typed_items(spark, d):
    """Items kept as JSON text, with the flag as boolean, word or absent; some rows are broken."""
    i = F.col("event_id")
    flag = F.when(i % 3 == 0, "true").when(i % 3 == 1, '"TRUE"').otherwise('"no"')
    made = F.concat(F.lit('{"sourcePath":"/p/'), i, F.lit('","originalFieldName":"'), "event_type", F.lit('","cleansedContent":"x","skipEnrichment":'), flag, F.when(i % 11 == 0, "").otherwise("}"))
    return enrich.typed_items(table(spark, d, "events").select("event_id", made.alias("item"))).select("event_id", "source_path", "original_field_name", "cleansed", "skip_enrichment")


def job_metrics(spark, d):
    return enrich.metrics(_elements(spark, d), "cleansed_id").select("cleansed_id", "total_fields_tagged")


# ---- views


def _documents(spark, d) -> DataFrame:
    """Sections made of documents, with a context."""
    page, key = F.concat(F.lit("page"), F.col("doc_id") % 40), F.concat("source", F.lit("-section"))
    context = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, page).alias("pageId"), F.struct(F.when(F.col("doc_id") % 3 == 0, key).alias("sectionKey")).alias("facets")))
    path = F.concat(F.lit("/x/"), F.when(F.col("doc_id") % 4 == 1, page).otherwise("other"), F.lit("/"), key)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("section_path"), path.alias("section_uri"), F.when(F.col("doc_id") % 2 == 0, "Copy").otherwise("title").alias("original_field_name"), F.col("text").alias("cleansed_text"), F.array("lang", "source").alias("tags"), F.array(F.lit("k")).alias("keywords"), context.alias("context"), F.timestamp_seconds(F.col("doc_id") % 100).alias("saved_at"))


def search_endpoint(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("section_id"), F.col("embedding").alias("vector"))
    found = views.search(chunks, _documents(spark, d), QUERY_VECTOR, "COPY", tags=["en"], keywords=["k"])
    return found.select("chunk_id", "source_field_name", "section_path", F.sha2("cleansed_text", 256).alias("text_hash"))


def page_sections(spark, d):
    return views.page_sections(_documents(spark, d), "PAGE9", 60).select("id", "section_path")


def section_discovery(spark, d):
    return views.discovered_sections(_documents(spark, d), "page9", 15)


def cleansed_contexts(spark, d):
    jobs = _jobs(spark, d)
    places = jobs.select("id", F.lit("en_US").alias("locale"), F.lit("p").alias("page_id"))
    made = views.cleansed_context(jobs, _items(spark, d), places, F.lit("2020-01-01").cast("timestamp"))
    return made.select("id", "started_at", "n_items", F.size("history").alias("n_history"), F.element_at("history", -1)["status"].alias("last"))


def locale_snapshots(spark, d):
    jobs = _jobs(spark, d).select("id", (F.col("id") % 1000).alias("raw_id"))
    raw = jobs.select(F.col("raw_id").alias("id")).distinct()
    own = jobs.select("id", F.when(F.col("id") % 2 == 0, "de_DE").otherwise(" ").alias("locale"), F.lit(None).cast("string").alias("page_id"))
    meta = raw.select(F.col("id").alias("raw_id"), F.lit("fr_FR").alias("locale"), F.concat(F.lit("p"), "id").alias("page_id"))
    return views.locale_snapshot(jobs, raw, own, meta)


def geo_locale_options(spark, d):
    country = F.upper(F.substring("n_name", 1, 2))
    refs = table(spark, d, "nation").select(F.lower(country).alias("geo_code"), F.concat(F.lit("EN-"), country).alias("locale_code"), F.col("n_name").alias("display_name"), F.lit("/x/").alias("storefront_path"), (F.col("n_nationkey") % 3 != 0).alias("active"))
    return views.geo_locales(views.active_locales(refs), {"US": ["en_US"]}).select("geo", F.array_join("locales", ",").alias("locales"))


def picked_fields(spark, d):
    """First filled value that isn't forbidden; place from paths; a locale's forms for bad input; a slim context."""
    i, locale = F.col("doc_id"), F.concat("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("-us")).otherwise(F.lit("-usa")))
    path = F.concat(F.lit("/content/dam/acme/x/live/en_US/"), "source", F.lit("/z/"))
    context = F.to_json(F.struct(F.struct(F.col("source").alias("a")).alias("facets"), F.struct(F.col("lang").alias("b")).alias("envelope"), F.lit("gone").alias("other")))
    return table(spark, d, "documents").select(
        "doc_id", X.first_filled(F.when(i % 2 == 0, "N/A").otherwise(" "), F.when(i % 3 == 0, "source"), F.col("lang"), forbidden=["n/a"]).alias("first"), X.resolved(F.when(i % 5 == 0, F.lit("asked")), [X.path_tenant(path)], "none").alias("tenant"), X.path_site(path).alias("site"), X.path_page(path).alias("page"),
        *[F.coalesce(X.normalize_locale(locale, how), F.lit("~")).alias(f"locale_{how}") for how in ("partial", "lower", "null", "blank", "original")], X.slim_context(context).alias("context"), X.keep_blank(F.col("text"), False).alias("kept"),
    )


_E = """e AS (SELECT l_orderkey * 2 AS job, '/p/' || l_partkey % 20 AS path, 'f' || l_linenumber % 3 AS field, 'text ' || (l_partkey % 20 + l_linenumber % 3 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS text, min(l_suppkey % 50) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3, 4)"""
_I = """i AS (SELECT DISTINCT l_orderkey AS job, '/p/' || l_partkey % 20 AS path, 'f' || l_linenumber % 3 AS field, 'text ' || (l_partkey % 20 + l_linenumber % 3 + l_orderkey % 2) AS text FROM lineitem)"""
_J = """j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'src' || o_custkey % 50 END AS source, 1 + o_orderkey % 3 AS version, CASE o_orderstatus WHEN 'O' THEN 'ENRICHMENT_QUEUED' WHEN 'F' THEN 'ENRICHED_COMPLETE' ELSE 'ENRICHMENT_IN_PROGRESS' END AS status, o_orderdate AS cleansed_at FROM orders)"""
_S = """s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job, CASE WHEN l_linenumber <> 7 THEN 'Words of ' || l_orderkey || '.' END AS text, CASE WHEN min(l_quantity) < 25 THEN 'PENDING_EMBEDDING' ELSE 'EMBEDDED' END AS status, CASE WHEN min(l_quantity) <> 3 THEN min(l_shipdate) END AS saved FROM lineitem GROUP BY l_orderkey, l_linenumber),
m AS (SELECT job, count(*) AS n FROM s WHERE text IS NOT NULL AND id % 10 % 2 = 0 GROUP BY 1)"""
_STATE = "CASE WHEN q < 10 THEN 'ERROR_X' WHEN q < 20 THEN 'ENRICHMENT_SKIPPED' ELSE 'ENRICHED' END"
_U = f"""
WITH {_E}, x AS (SELECT *, 'src' || s AS source, 1 + s % 3 AS version FROM e),
h AS (SELECT DISTINCT '/p/' || l_partkey % 20 AS path, 'f' || l_linenumber % 3 AS field, '/h/' || l_suppkey % 2 || ' ::ref:: /u/' || l_suppkey % 2 AS usage FROM lineitem),
u AS (SELECT l_orderkey AS job, '/p/' || l_partkey % 20 AS path, 'f' || l_linenumber % 3 AS field, '/c/' || l_suppkey % 4 || ' ::ref:: /p/' || l_partkey % 20 AS usage FROM lineitem WHERE l_suppkey % 3 <> 0
  UNION SELECT job, path, field, usage FROM e JOIN h USING (path, field)),
f AS (SELECT x.*, coalesce(u.usage, '/own') AS usage FROM x LEFT JOIN u USING (job, path, field)),
g AS (SELECT *, split_part(usage, ' ::ref:: ', 1) AS section_path, CASE WHEN contains(usage, ' ::ref:: ') THEN split_part(usage, ' ::ref:: ', 2) ELSE usage END AS section_uri FROM f)"""
_DOCS = """s AS (SELECT doc_id AS id, '/x/' || CASE WHEN doc_id % 4 = 1 THEN 'page' || doc_id % 40 ELSE 'other' END || '/' || source || '-section' AS section_path, source || '-section' AS key, doc_id % 100 AS saved, text, lang,
  (doc_id % 2 = 0 AND doc_id % 40 = 9) OR (doc_id % 4 = 1 AND doc_id % 40 = 9) AS nine FROM documents)"""
_FOUND = "list_cosine_distance(embedding::DOUBLE[], (list_transform(range(64), lambda i: ((i * 7) % 13 - 6) / 6.0))::DOUBLE[])"

SQL: dict[str, str] = {
    "content_items": f"""
WITH {_ITEMS},
v AS (SELECT *, {_EVENT.format(x="html")} AS html_event FROM i)
SELECT source_uri, ordinal, source_path, item_type, CASE WHEN ordinal = 0 THEN path WHEN place = 0 THEN source_uri || ' ::ref:: ' || path ELSE path || ' ::ref:: ' || path || '/inner-section' END AS usage_path,
  CASE WHEN place = 0 THEN 'hero-section' ELSE 'tile-section' END AS model, CASE WHEN place = 2 THEN NULL WHEN page_id % 2 = 0 THEN 'en_US' ELSE 'fr_FR' END AS locale, CASE WHEN place = 2 THEN NULL WHEN page_id % 2 = 0 THEN 'en' ELSE 'fr' END AS language, CASE WHEN place = 2 THEN NULL WHEN page_id % 2 = 0 THEN 'US' ELSE 'FR' END AS country,
  CASE place WHEN 0 THEN 'page' || page_id WHEN 1 THEN 'inner-section' ELSE 'at' END AS section_name, CASE place WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 2 END AS depth, url AS by, cleansed, sha256(cleansed) AS content_hash, {_SKIP} AS skip_enrichment, is_analytics,
  CASE WHEN place = 0 THEN 'page' || page_id ELSE 'inner-section' END AS section_key, idx::VARCHAR AS section_index, '/i' AS icon, url AS image, 'y' AS size,
  CASE WHEN ordinal = 0 THEN html_event WHEN ordinal = 1 THEN NULL WHEN ordinal < 6 THEN 'Tax day' WHEN idx IS NULL THEN coalesce({_EVENT.format(x="CASE WHEN ordinal = 6 THEN cleansed ELSE url END")}, 'Tax day') ELSE 'Christmas' END AS event,
  (CASE ordinal WHEN 0 THEN 13 + CASE WHEN html_event IS NULL THEN 0 ELSE 1 END WHEN 1 THEN 14 ELSE 15 END - CASE WHEN idx IS NULL THEN 0 ELSE 1 END)::INT AS n_facets
FROM v""",
    "content_assets": f"""
WITH a AS (SELECT page_id, url, 'page:' || page_id AS source_uri, {_PATH} AS path FROM pages)
SELECT source_uri, t.ordinal, asset_key, '#/' || asset_key AS node_path, path AS section_path, CASE WHEN t.ordinal = 1 THEN url ELSE '/i' END AS preview_uri, CASE WHEN t.ordinal = 1 THEN 'a~b/c' END AS alt_text, sha256(asset_key || '|#/' || asset_key || '|' || path || '|' || path) AS slot_key,
  CASE WHEN t.ordinal = 1 THEN url END AS viewport, CASE WHEN t.ordinal = 0 THEN '/i' END AS direct FROM a, (VALUES (0, 'icon'), (1, 'heroImageDesktop')) AS t(ordinal, asset_key)""",
    "item_counters": f"WITH {_ITEMS} SELECT source_uri, (count(*) FILTER (NOT is_analytics))::BIGINT AS copy_kept, (count(*) FILTER (is_analytics))::BIGINT AS analytics_kept, (count(*) FILTER (NOT is_analytics AND cleansed = ''))::BIGINT AS copy_blank, (count(*) FILTER (is_analytics AND cleansed = ''))::BIGINT AS analytics_blank FROM i GROUP BY 1",
    "item_view": f"WITH {_ITEMS} SELECT source_uri, ordinal, item_type AS field, cleansed FROM i WHERE NOT {_SKIP}",
    "ingest_changed": f"WITH {_INGEST} SELECT source_uri, version, ordinal, item_type, content_hash FROM c",
    "ingest_statuses": f"""
WITH {_INGEST}, n AS (SELECT source_uri, count(*) AS n FROM c GROUP BY 1)
SELECT source_uri, version, CASE WHEN page_id % 13 = 12 THEN 'EXTRACTION_FAILED' WHEN n IS NULL THEN 'PROCESSED_NO_CHANGES' ELSE 'CLEANSED_PENDING_ENRICHMENT' END AS status, CASE WHEN page_id % 13 = 12 THEN 'ExtractionError: not JSON' END AS error, coalesce(n, 0) AS n_items FROM p LEFT JOIN n USING (source_uri)""",
    "ingest_hashes": f"""
WITH {_INGEST}, k AS (SELECT '/p/' || page_id AS source_path, item_type, CASE WHEN ordinal = 0 THEN '' ELSE source_uri || ' ::ref:: ' END || '/p/' || page_id AS usage_path, content_hash FROM i),
h AS (SELECT '/p/' || page_id AS source_path, 'text[1]' AS item_type, CASE WHEN page_id % 2 = 0 THEN 'elsewhere' ELSE 'page:' || page_id || ' ::ref:: /p/' || page_id END AS usage_path, sha256('b') AS content_hash FROM pages)
SELECT * FROM k UNION ALL SELECT * FROM h WHERE (source_path, item_type, usage_path) NOT IN (SELECT (source_path, item_type, usage_path) FROM k)""",
    "to_annotate": f"""
WITH {_E}, {_I}, {_J}, x AS (SELECT *, 'src' || s AS source, 1 + s % 3 AS version, CASE WHEN s % 2 = 0 THEN sha256(text) END AS hash FROM e),
k AS (SELECT j.*, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.job = j.id) THEN 1 WHEN version > 1 AND source IS NOT NULL THEN 2 ELSE 3 END AS kind FROM j),
b AS (SELECT k.id, x.path, x.field, x.hash, x.text FROM k JOIN x ON k.kind = 1 AND x.job = k.id UNION ALL SELECT k.id, x.path, x.field, x.hash, x.text FROM k JOIN x ON k.kind = 2 AND x.source = k.source AND x.version = k.version - 1),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id, path, field ORDER BY hash NULLS LAST, text) = 1)
SELECT i.job AS cleansed_id, i.path AS source_path, i.field AS original_field_name, i.text AS cleansed FROM i JOIN k ON k.id = i.job LEFT JOIN f ON f.id = i.job AND f.path = i.path AND f.field = i.field
WHERE CASE WHEN kind < 3 THEN CASE WHEN f.hash IS NOT NULL THEN f.hash <> sha256(i.text) ELSE f.text IS NULL OR f.text <> i.text END
  ELSE NOT EXISTS (SELECT 1 FROM x WHERE (k.source IS NULL OR x.source = k.source) AND x.path = i.path AND x.field = i.field AND coalesce(x.hash, sha256(x.text)) = sha256(i.text)) END""",
    "save_results": f"""
WITH {_E}, {_I}
SELECT coalesce(e.job, i.job) AS cleansed_id, coalesce(e.path, i.path) AS item_source_path, coalesce(e.field, i.field) AS item_original_field_name, coalesce(i.text, e.text) AS cleansed_text,
  CASE WHEN i.text IS NOT NULL AND coalesce(s, 1) % 4 <> 0 THEN 'new ' || i.text ELSE 'old' END AS summary, CASE WHEN i.text IS NOT NULL THEN 'good' END AS sentiment, CASE WHEN i.text IS NOT NULL THEN 'ENRICHED' ELSE {_STATE} END AS status,
  coalesce(s % 4 = 0, false) AS user_override_active, coalesce(s % 4 = 0 AND i.text IS NOT NULL, false) AS new_ai_available, CASE WHEN i.text IS NOT NULL THEN 'model' END AS model
FROM e FULL JOIN i USING (job, path, field)""",
    "save_failures": f"""
WITH {_E}, {_I}
SELECT coalesce(e.job, i.job) AS cleansed_id, coalesce(e.path, i.path) AS item_source_path, coalesce(e.field, i.field) AS item_original_field_name, coalesce(i.text, e.text) AS cleansed_text, CASE WHEN e.job IS NOT NULL THEN 'old' END AS summary,
  CASE WHEN i.text IS NOT NULL THEN 'ERROR_ENRICHMENT_FAILED' ELSE {_STATE} END AS status, false AS new_ai_available, 'no answer for ' || i.text AS error
FROM e FULL JOIN i USING (job, path, field)""",
    "model_revisions": f"""
WITH {_E}, {_I}
SELECT i.job || '::' || i.path || '::' || i.field AS element_id, 1 AS revision, 'new ' || i.text AS summary, coalesce(s % 4, 1) <> 0 AS applied, CASE WHEN s % 4 = 0 THEN 'USER_OVERRIDE' END AS blocked_by FROM i LEFT JOIN e USING (job, path, field)""",
    "consolidate_run": f"{_U} SELECT DISTINCT version, section_path, section_uri, field AS original_field_name, text AS cleansed_text FROM g",
    "section_hashes": f"""{_U}, l AS (SELECT path, field, max(usage) AS usage FROM h GROUP BY 1, 2),
k AS (SELECT version, section_path, section_uri, field, text, min(CASE WHEN l.usage IS NOT NULL THEN path || '|' || field || '|' || coalesce(h.usage, l.usage) END) AS hash FROM g LEFT JOIN h USING (path, field, usage) LEFT JOIN l USING (path, field) GROUP BY ALL)
SELECT hash AS content_hash, field AS original_field_name, count(*) AS n FROM k GROUP BY 1, 2""",
    "embedding_worker": f"""
WITH {_S} SELECT id AS section_id, 0 AS position, text AS chunk_text, 'EMBEDDED' AS status FROM (SELECT * FROM s WHERE status = 'PENDING_EMBEDDING' AND text IS NOT NULL AND id % 10 % 2 = 0 ORDER BY saved NULLS LAST, id LIMIT 25)""",
    "missing_by_job": f"WITH {_S} SELECT job AS cleansed_id, n FROM m",
    "chunk_delete": f"WITH {_S}, {_J} SELECT s.id AS section_id, 0 AS position FROM s LEFT JOIN j ON j.id = s.job WHERE s.id % 10 % 2 = 1 AND j.status IS DISTINCT FROM 'ENRICHMENT_QUEUED'",
    "claim_jobs": f"WITH {_J} SELECT id, CASE WHEN id % 2 = 0 AND status <> 'ENRICHED_COMPLETE' THEN 'FINALIZING' ELSE status END AS status FROM j",
    "final_job_statuses": f"""
WITH {_E}, {_S}, t AS (SELECT job, count(*) FILTER (q >= 10) AS good, count(*) FILTER (q < 10) AS bad FROM e GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN coalesce(good, 0) = 0 THEN 'ENRICHMENT_FAILED' WHEN bad > 0 OR m.n > 0 THEN 'PARTIALLY_ENRICHED' ELSE 'ENRICHED_COMPLETE' END AS status FROM orders LEFT JOIN t ON t.job = o_orderkey LEFT JOIN m ON m.job = o_orderkey""",
    "typed_items": "SELECT event_id, '/p/' || event_id AS source_path, event_type AS original_field_name, 'x' AS cleansed, event_id % 3 < 2 AS skip_enrichment FROM events WHERE event_id % 11 <> 0",
    "job_metrics": f"WITH {_E} SELECT job AS cleansed_id, count(*) AS total_fields_tagged FROM e GROUP BY 1",
    "search_endpoint": f"""
WITH {_DOCS} SELECT vec_id AS chunk_id, 'Copy' AS source_field_name, section_path, sha256(text) AS text_hash FROM s JOIN embeddings ON vec_id = id WHERE id % 2 = 0 AND lang = 'en' ORDER BY {_FOUND}, vec_id LIMIT 200""",
    "page_sections": f"WITH {_DOCS} SELECT id, section_path FROM s WHERE nine ORDER BY saved DESC, id LIMIT 60",
    "section_discovery": f"WITH {_DOCS}, f AS (SELECT * FROM s WHERE nine ORDER BY saved DESC, id LIMIT 60) SELECT key AS section_key FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY saved DESC, id) = 1 ORDER BY saved DESC, id LIMIT 15",
    "cleansed_contexts": f"WITH {_J}, n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT id, epoch_ms(cleansed_at) AS started_at, coalesce(n, 0) AS n_items, 2 AS n_history, status AS last FROM j LEFT JOIN n USING (id)",
    "locale_snapshots": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'de_DE' ELSE 'fr_FR' END AS locale, 'p' || o_orderkey % 1000 AS page_id FROM orders",
    "geo_locale_options": "SELECT upper(n_name[1:2]) AS geo, string_agg(DISTINCT 'en_' || upper(n_name[1:2]), ',') AS locales FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1",
    "picked_fields": """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE lang END AS first, CASE WHEN doc_id % 5 = 0 THEN 'asked' ELSE 'acme' END AS tenant, source AS site, source AS page,
  CASE WHEN doc_id % 2 = 0 THEN lang || '_US' ELSE lang || '_usa' END AS locale_partial, CASE WHEN doc_id % 2 = 0 THEN lang || '_US' ELSE lang || '_usa' END AS locale_lower, CASE WHEN doc_id % 2 = 0 THEN lang || '_US' ELSE '~' END AS locale_null, CASE WHEN doc_id % 2 = 0 THEN lang || '_US' ELSE '' END AS locale_blank, CASE WHEN doc_id % 2 = 0 THEN lang || '_US' ELSE lang || '-usa' END AS locale_original,
  '{"facets":"{\\"a\\":\\"' || source || '\\"}","envelope":"{\\"b\\":\\"' || lang || '\\"}"}' AS context, coalesce(trim(text), '') <> '' AS kept FROM documents""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        content_items, content_assets, item_counters, item_view, ingest_changed, ingest_statuses, ingest_hashes, to_annotate, save_results, save_failures, model_revisions, consolidate_run, section_hashes, embedding_worker, missing_by_job, chunk_delete,
        claim_jobs, final_job_statuses, typed_items, job_metrics, search_endpoint, page_sections, section_discovery, cleansed_contexts, locale_snapshots, geo_locale_options, picked_fields,
    )
}
