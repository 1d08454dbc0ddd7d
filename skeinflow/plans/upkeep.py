"""Queries of what keeps the tables going, over whole tables: finishing jobs, replay, refresh, backfill, snapshots, skips, queues, edits, leases; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assets, edits, enrich, ingest, leases, store, versions, views
from ..operators import lifecycle as L
from . import runs
from .runs import table


def finalize_sections(spark, d):
    """Sections after finishing all jobs of even number that are still open."""
    jobs = runs._jobs(spark, d)
    sections = runs._no_sections(spark)
    chunks = spark.createDataFrame([], "section_id string, position int")
    done = enrich.finalize(jobs, jobs.where("id % 2 = 0"), runs._elements(spark, d, "cleansed_id"), runs._items(spark, d), runs._usage_hashes(spark, d), sections, chunks)
    return done.sections.select("version", "section_path", "section_uri", "original_field_name", "cleansed_text")


def finalize_claims(spark, d):
    """How many of the asked jobs were finished, by their last status before."""
    jobs = runs._jobs(spark, d).withColumn("before", F.col("status"))
    sections, chunks = runs._no_sections(spark), spark.createDataFrame([], "section_id string, position int")
    done = enrich.finalize(jobs, jobs.where("id % 2 = 0"), runs._elements(spark, d, "cleansed_id"), runs._items(spark, d), runs._usage_hashes(spark, d), sections, chunks)
    ended = F.col("status").isin("ENRICHED_COMPLETE", "PARTIALLY_ENRICHED", "ENRICHMENT_FAILED") & (F.col("before") != "ENRICHED_COMPLETE")
    return done.jobs.groupBy("before").agg(F.count_if(ended).alias("n_ended"), F.count("*").alias("n"))


def _stored(spark, d) -> DataFrame:
    """A version for each document: some texts are blank and in bytes only, some are missing."""
    i, text = F.col("doc_id"), F.col("text")
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc:"), i % 300).alias("source_uri"), (1 + F.floor(i / 300)).cast("int").alias("version"), F.when(i % 5 == 0, " ").when(i % 5 != 1, text).alias("raw_text"),
        F.when(i % 10 == 0, F.encode(text, "UTF-8")).alias("raw_binary"), F.sha2(text, 256).alias("content_hash"), F.when(i % 3 == 0, "").when(i % 3 == 1, "kept").alias("request_metadata"),
    )


def replay_documents(spark, d):
    raw = _stored(spark, d)
    found = ingest.replay(raw, raw.where("substr(source_uri, 5) % 2 = 0"))
    return found.select("source_uri", "version", F.sha2("json", 256).alias("json_hash"))


def backfill_rows(spark, d):
    """Every second text is uploaded again, with request metadata."""
    again = _stored(spark, d).where("version % 2 = 1").select("source_uri", "content_hash", F.lit("text").alias("raw_text"), F.lit("{}").alias("request_metadata"))
    done = ingest.backfill(_stored(spark, d), again)
    return done.select("source_uri", "version", F.sha2("raw_text", 256).alias("text_hash"), "request_metadata")


def refresh_rows(spark, d):
    """Resumed runs of two thirds of the sources, one half without a change."""
    orders = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    cleansed = orders.select(F.concat(F.lit("s"), "k").alias("source_uri"), F.lit(1).alias("version"), F.lit("OLD").alias("status"), F.lit("kept").alias("note"))
    done = orders.where("k % 3 <> 0").select(F.concat(F.lit("s"), "k").alias("source_uri"), (2 + F.col("k") % 5).cast("int").alias("version"), F.when(F.col("k") % 2 == 0, "PROCESSED_NO_CHANGES").otherwise("CLEANSED_PENDING_ENRICHMENT").alias("status"))
    return ingest.refresh(cleansed, done)


def saved_skips(spark, d):
    done = enrich.save_skipped(runs._elements(spark, d), runs._done(spark, d), F.lit("2020-01-01").cast("timestamp"))
    return done.select(*runs._KEYS, "cleansed_text", "summary", "status", "new_ai_available", F.get_json_object("enrichment_metadata", "$.reason").alias("reason"))


def queue_split(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_uri"), (F.col("l_partkey") % 20).alias("source_path"), (F.col("l_linenumber") % 3).alias("item_type"), "l_returnflag")
    skipped, queued, expected = L.partition_queue(rows, F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False))
    counted = queued.groupBy("source_uri").agg(F.count("*").alias("n_queued"))
    return expected.join(counted, "source_uri").join(skipped.groupBy("source_uri").agg(F.count("*").alias("n_skipped")), "source_uri", "left")


def prompt_search(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("section_id"), F.col("embedding").alias("vector"))
    return views.prompt_search("What is in SRC3-section", chunks, runs._documents(spark, d), lambda _: runs.QUERY_VECTOR, limit=40).select("id", "rank", "section_path")


def prompt_search_nearest(spark, d):
    """Without a section: the nearest chunks, of the hinted role."""
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("section_id"), F.col("embedding").alias("vector"))
    return views.prompt_search("anything", chunks, runs._documents(spark, d), lambda _: runs.QUERY_VECTOR, role="copy", limit=60).select("id", "rank", "section_path")


def snapshot_replaced(spark, d):
    """Occurrences of parts by supplier, replaced for the pairs (source, version) that come again."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("source_uri"), (F.col("l_linenumber") % 2).alias("source_version"), "l_partkey", "l_orderkey")
    stored = rows.select("source_uri", "source_version", "l_partkey", F.lit("old").alias("state"))
    incoming = rows.where("source_uri % 3 = 0 and source_version = 1").select("source_uri", "source_version", "l_partkey", F.lit("new").alias("state"))
    return assets.snapshot_replace(stored, incoming).groupBy("source_uri", "source_version", "state").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def worker_batches(spark, d):
    return views.by_job(runs._sections(spark, d))


def locale_picked(spark, d):
    i = F.col("c_custkey")
    rows = table(spark, d, "customer").select(i, F.when(i % 4 == 0, "de-de").when(i % 4 == 1, "DE_de").when(i % 4 == 2, "de_DE").otherwise("fr_FR").alias("locale"))
    return views.locale_rows(rows, " de-DE ")


def last_revisions(spark, d):
    """Each order's last line as an element's last revision."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_linenumber").alias("revision")).distinct()
    return edits.latest_revision(rows)


def recent_cleansed(spark, d):
    """Each customer's latest order, ties by number."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("source_uri"), F.col("o_orderdate").alias("cleansed_at"), F.col("o_orderkey").alias("id"))
    return versions.latest(rows, "source_uri", "cleansed_at", "id")


def text_helpers(spark, d):
    """Older cleansing, locales anywhere in a path, metadata of a JSON object, labels, lists as text."""
    i, text = F.col("doc_id"), F.col("text")
    made = F.to_json(F.struct(F.lit("m").alias("_model"), F.col("lang").alias("a"), F.lit("c").alias("copy"), F.col("source").alias("b")))
    status = F.when(i % 3 == 0, "PARTIALLY_ENRICHED").when(i % 3 == 1, "OTHER")
    marked = F.concat(F.lit("<p>"), F.col("source"), F.lit("</p>{%nbsp%}x{%br%}y"))
    return table(spark, d, "documents").select(
        "doc_id", X.cleanse_legacy(F.when(i % 4 != 0, marked).otherwise("<b></b>")).alias("legacy"), X.any_locale(F.concat(F.lit("/a/x"), "lang", F.when(i % 2 == 0, "-US/").otherwise("_us/"))).alias("locale"), X.strip_metadata(made).alias("metadata"),
        X.status_label(status).alias("status"), X.list_text(F.array(F.lit(" "), F.col("lang"), F.lit(None).cast("string"), F.concat(F.lit(" "), "source"))).alias("listed"), X.list_text(F.when(i % 2 == 0, F.array(F.lit(" ")))).alias("none"),
    )


def leased_claims(spark, d):
    """Two workers claim in turn, the first finishes a part of its rows, its lease ends, and a third comes: who holds what at last."""
    now = [0.0]
    book = leases.Leases(spark, f"{store.shared_folder(spark)}/leases-{uuid.uuid4().hex}", 60.0, clock=lambda: now[0])
    pending = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"), F.col("o_orderdate").alias("saved_at"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    first, _ = (book.claim(who, pending, done, "id", "text", "saved_at", 60) for who in "ab")
    book.finish(first.number, [r.id for r in first.rows.where("id % 2 = 0").collect()])
    now[0] = 61.0
    book.claim("c", pending, done, "id", "text", "saved_at", 60)
    return book.holders().select(F.col("id").cast("long").alias("id"), F.col("n").cast("int").alias("number"), "owner", "done")


_STORED = """
r AS (SELECT doc_id, text, 'doc:' || doc_id % 300 AS source_uri, (1 + doc_id // 300)::INT AS version, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 <> 1 THEN text END AS raw_text, sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'kept' END AS request_metadata FROM documents)"""
_WON = "w AS (SELECT o_orderkey AS job FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F')"

SQL: dict[str, str] = {
    "finalize_sections": f"{runs._U}, {_WON} SELECT DISTINCT version, section_path, section_uri, field AS original_field_name, text AS cleansed_text FROM g JOIN w USING (job)",
    "finalize_claims": f"WITH {runs._J} SELECT status AS before, count(*) FILTER (id % 2 = 0 AND status <> 'ENRICHED_COMPLETE') AS n_ended, count(*) AS n FROM j GROUP BY 1",
    "replay_documents": f"""
WITH {_STORED}, l AS (SELECT *, CASE WHEN trim(coalesce(raw_text, '')) <> '' THEN raw_text WHEN doc_id % 10 = 0 THEN text END AS json FROM r WHERE (doc_id % 300) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY source_uri ORDER BY version DESC) = 1)
SELECT source_uri, version, sha256(json) AS json_hash FROM l WHERE trim(coalesce(json, '')) <> ''""",
    "backfill_rows": f"""
WITH {_STORED}, g AS (SELECT DISTINCT source_uri, content_hash FROM r WHERE version % 2 = 1)
SELECT r.source_uri, version, sha256(coalesce(raw_text, CASE WHEN g.source_uri IS NOT NULL THEN 'text' END)) AS text_hash, coalesce(nullif(request_metadata, ''), CASE WHEN g.source_uri IS NOT NULL THEN '{{}}' END, request_metadata) AS request_metadata FROM r LEFT JOIN g USING (source_uri, content_hash)""",
    "refresh_rows": "SELECT 's' || c_custkey AS source_uri, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN 2 + c_custkey % 5 ELSE 1 END::INT AS version, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN 'CLEANSED_PENDING_ENRICHMENT' ELSE 'OLD' END AS status, 'kept' AS note FROM customer",
    "saved_skips": f"""
WITH {runs._E}, {runs._I}
SELECT coalesce(e.job, i.job) AS cleansed_id, coalesce(e.path, i.path) AS item_source_path, coalesce(e.field, i.field) AS item_original_field_name, coalesce(i.text, e.text) AS cleansed_text, CASE WHEN e.job IS NOT NULL THEN 'old' END AS summary,
  CASE WHEN i.text IS NOT NULL THEN 'ENRICHMENT_SKIPPED' ELSE {runs._STATE} END AS status, false AS new_ai_available, CASE WHEN i.text IS NOT NULL THEN 'Excluded via configuration' END AS reason FROM e FULL JOIN i USING (job, path, field)""",
    "queue_split": """
SELECT 'o' || l_orderkey AS source_uri, count(DISTINCT (l_partkey % 20, l_linenumber % 3)) FILTER (l_returnflag <> 'R') AS n_expected, count(*) FILTER (l_returnflag <> 'R') AS n_queued, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS n_skipped
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'R') > 0""",
    "prompt_search": f"WITH {runs._DOCS} SELECT id, row_number() OVER (ORDER BY saved DESC, id)::INT AS rank, section_path FROM s WHERE id % 3 = 0 AND key = 'src3-section' ORDER BY saved DESC, id LIMIT 40",
    "prompt_search_nearest": f"""
WITH {runs._DOCS}, n AS (SELECT vec_id, {runs._FOUND} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 60)
SELECT id, row_number() OVER (ORDER BY distance, id)::INT AS rank, section_path FROM n JOIN s ON s.id = vec_id WHERE id % 2 = 0""",
    "snapshot_replaced": """
SELECT l_suppkey % 20 AS source_uri, l_linenumber % 2 AS source_version, CASE WHEN (l_suppkey % 20) % 3 = 0 AND l_linenumber % 2 = 1 THEN 'new' ELSE 'old' END AS state, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY ALL""",
    "worker_batches": f"WITH {runs._S} SELECT job AS cleansed_id, count(*) AS n, min(saved) AS first_saved FROM s GROUP BY 1",
    "locale_picked": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'de-de' WHEN 1 THEN 'DE_de' ELSE 'de_DE' END AS locale FROM customer WHERE c_custkey % 4 < 3",
    "last_revisions": "SELECT l_orderkey AS element_id, max(l_linenumber) AS revision FROM lineitem GROUP BY 1",
    "recent_cleansed": "SELECT o_custkey AS source_uri, o_orderdate AS cleansed_at, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1",
    "leased_claims": """
WITH p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) AS place FROM orders WHERE trim(coalesce(o_orderstatus, '')) <> '' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
h AS (SELECT id, place, CASE WHEN place <= 60 THEN 'a' ELSE 'b' END AS owner, place <= 60 AND id % 2 = 0 AS done FROM p WHERE place <= 120),
c AS (SELECT id FROM p LEFT JOIN h USING (id, place) WHERE NOT coalesce(done, false) ORDER BY place LIMIT 60)
SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 4 WHEN owner = 'a' THEN 1 ELSE 2 END AS number, CASE WHEN id IN (SELECT id FROM c) THEN 'c' ELSE owner END AS owner, coalesce(done, false) AS done FROM p LEFT JOIN h USING (id, place) WHERE place <= 120 OR id IN (SELECT id FROM c)""",
    "text_helpers": """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source || 'x' || chr(10) || 'y' END AS legacy, CASE WHEN doc_id % 2 = 0 THEN lang || '_US' END AS locale, '{"a":"' || lang || '","b":"' || source || '"}' AS metadata,
  CASE doc_id % 3 WHEN 0 THEN 'ENRICHMENT COMPLETE' WHEN 1 THEN 'OTHER' END AS status, lang || ', ' || source AS listed, NULL::VARCHAR AS none FROM documents""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (finalize_sections, finalize_claims, replay_documents, backfill_rows, refresh_rows, saved_skips, queue_split, prompt_search, prompt_search_nearest, snapshot_replaced, worker_batches, locale_picked, last_revisions, recent_cleansed, text_helpers, leased_claims)
}
