"""The ingest run, the extractor's corners, searches on odd rows, tables, the queue, and calls to services."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import providers
from skeinflow.functions import text as X
from skeinflow.operators import enrich, fulltext, ingest, lifecycle, search, services, store, versions, views
from skeinflow.sources import json_items, json_tree
from skeinflow.streaming import inbox


def items(node, source="s"):
    names = [c.split()[0] for c in json_items.ITEM_SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in json_items.item_rows(json.dumps(node), source)]


def test_usage_path_stays_after_a_text_for_later_analytics():
    found = items({"_path": "/a", "analyticsOne": "x", "copy": "text", "analyticsTwo": "y"})
    assert [(i["item_type"], i["usage_path"]) for i in found] == [("analyticsOne", "s"), ("#", "s ::ref:: /a"), ("analyticsTwo", "s ::ref:: /a")]


def test_context_and_its_hash():
    base = {"_path": "/x/en_US/p", "_provenance": {"by": "me", "n": 1}, "copy": "text", "kind": "a"}
    one = items(base)[0]
    assert (one["language"], one["country"], one["locale"], one["section_name"]) == ("en", "US", "en_US", "p")
    assert dict(one["provenance"]) == {"by": "me", "n": "1"} and one["path_hierarchy"] == ["", "x", "en_US", "p"]
    assert one["context_hash"] == items(dict(reversed(base.items())) | {"copy": "text"})[0]["context_hash"]
    for change in ({"kind": "b"}, {"_provenance": {"by": "you"}}, {"_path": "/x/en_US/q"}, {"_model": "m"}):
        assert items(base | change)[0]["context_hash"] != one["context_hash"]
        assert items(base | change)[0]["content_hash"] == one["content_hash"]
    assert dict(items({"_provenance": ["no map"], "copy": "x"})[0]["provenance"]) == {}


def test_file_upload_paths_blank_paths_and_carried_events():
    found = items({"_path": "file-upload:x.json", "list": [{"copy": "Christmas time"}, {"_path": " ", "copy": "plain"}], "copy": "tax"})
    assert [(i["source_path"], dict(i["facets"]).get("eventType"), dict(i["facets"]).get("sectionIndex")) for i in found] == [("s", "Christmas", "0"), ("s", None, "1"), ("s", "Tax day", None)]


def test_image_keys_and_array_places_in_facets():
    facets = dict(items({"bigImageDesktop": {"alt": "a", "_x": 1, "list": ["p", {"q": None}, [1]]}, "icon": {"k": {"n": True}, "l": [1]}, "copy": "t"})[0]["facets"])
    assert {k: v for k, v in facets.items() if "." in k} == {"bigImageDesktop.alt": "a", "bigImageDesktop.list[0]": "p", "bigImageDesktop.list[1].q": "null", "icon.k.n": "true"}


@pytest.mark.parametrize("depth,some", [(300, True), (900, True), (5000, False), (200_000, False)])
def test_deep_documents_do_not_fail(spark, depth, some):
    text = '{"a":' * depth + '{"copy":"deep"}' + "}" * depth
    docs = spark.createDataFrame([("s", text), ("t", '{"copy":"x"}'), ("u", None), ("v", "[1,")], "source_uri string, json string")
    assert json_items.extract_items(docs).count() == 1 + some
    assert json_items.extract_assets(docs).count() == 0
    assert json_tree.nodes(docs).where("source_uri = 's'").isEmpty() != some


def test_assets_uri_order_slots_and_sections():
    names = [c.split()[0] for c in json_items.ASSET_SCHEMA.split(", ")]
    rows = lambda node: [dict(zip(names, r)) for r in json_items.asset_rows(json.dumps(node), "s")]
    node = {"_model": "m-section", "_path": "/sec", "in": {"_path": "/other", "heroImage": {"_uri2x_path": "2", "_uri_path": "p", "uri2x": "u2", "uri1x": "u1", "alt": {"copy": " an alt "}}}, "a/b~Icon": {"alt": "x", "deep": [{"uri": "first"}]}, "noImage": {"x": 1}}
    hero, icon = rows(node)
    assert (hero["preview_uri"], hero["alt_text"], hero["section_path"], hero["node_path"]) == ("u1", "an alt", "/sec", "#/in/heroImage")
    assert (icon["preview_uri"], icon["node_path"]) == ("first", "#/a~1b~0Icon")
    moved = rows(node | {"in": {"heroImage": node["in"]["heroImage"] | {"_path": "/own"}}})[0]
    assert moved["metadata_hash"] == hero["metadata_hash"] and moved["slot_key"] != hero["slot_key"]


def test_object_uris():
    assert json_items.object_uri("s3://b/k/x") == ("b", "k/x") and json_items.object_uri("s3:///k", "d") == ("d", "k")
    for bad in ("http://b/k", "s3://b", "s3://b/", "s3:///k"):
        with pytest.raises(ValueError):
            json_items.object_uri(bad)


def test_metadata_orders(spark):
    docs = spark.createDataFrame([("s", '{"a":{"locale":"en-us"},"b":{"locale":"de-de","page_id":"p"}}')], "source_uri string, json string")
    assert json_tree.metadata(docs).first().locale == "de_DE" and json_tree.metadata(docs, last_first=False).first().locale == "en_US"


def raw_rows(spark, *rows):
    return spark.createDataFrame([(s, v, json.dumps(j) if not isinstance(j, str) else j) for s, v, j in rows], "source_uri string, version int, json string")


HASHES = "source_path string, item_type string, usage_path string, content_hash string, context_hash string"


def test_ingest_run_from_version_to_version(spark):
    hashes = spark.createDataFrame([], HASHES)
    kept = spark.createDataFrame([], f"source_uri string, version int, {HASHES}")
    raw = raw_rows(spark)
    doc = {"_path": "/p", "text": ["a", "b"], "copy": "c"}
    seen = []
    for version, now in ((1, doc), (2, doc | {"text": ["a", "B", "new"]}), (3, doc | {"text": ["a", "B", "new"]}), (4, {"copy": "c", "_path": "/p"})):
        current = raw_rows(spark, ("s", version, now))
        done = ingest.run(current, raw, hashes, kept)
        seen.append((sorted(r.item_type for r in done.changed.collect()), done.cleansed.first().status))
        raw, hashes, kept = (raw.unionByName(current), *(spark.createDataFrame(t.collect(), t.schema) for t in (done.hashes, done.version_hashes)))
    pending = "CLEANSED_PENDING_ENRICHMENT"
    assert seen == [(["#", "text[0]", "text[1]"], pending), (["text[1]", "text[2]"], pending), ([], "PROCESSED_NO_CHANGES"), ([], "PROCESSED_NO_CHANGES")]
    assert kept.count() == 3 + 4 + 4 + 1 and hashes.count() == 4
    again = ingest.run(raw_rows(spark, ("s", 3, doc)), raw, hashes, kept, full=True)
    assert again.changed.count() == 3


def test_context_counts_only_when_asked(spark):
    old, new = ({"_path": "/p", "copy": "c", "kind": k} for k in "ab")
    args = raw_rows(spark, ("s", 2, new)), raw_rows(spark, ("s", 1, old)), spark.createDataFrame([], HASHES), spark.createDataFrame([], f"source_uri string, version int, {HASHES}")
    assert ingest.run(*args).changed.count() == 0 and ingest.run(*args, use_context=True).changed.count() == 1


def test_global_hashes_with_null_usage_and_strict_keys(spark):
    rows = spark.createDataFrame([("a", "t", None, "h1", None), ("b", "t", "u", "h2", None), ("c", "t", "u", "h3", None), (None, "t", "u", "h", None)], HASHES)
    known = spark.createDataFrame([("a", "t", "", "h1", None), ("a", "t", "z", "old", None), ("b", "t", "other", "h2", None)], HASHES)
    assert sorted(r.source_path for r in ingest.changed_globally(rows, known).collect()) == ["c"]
    assert sorted(r.source_path for r in ingest.changed_globally(rows, known, strict=True).collect()) == ["b", "c"]
    assert ingest.kept_hashes(known, rows).count() == 5


def test_fallback_lookup_prefers_the_exact_null_key(spark):
    df = spark.createDataFrame([("a", None)], "k string, u string")
    known = spark.createDataFrame([("a", "x", 3, 1), ("a", None, 7, 0)], "k string, u string, v int, at int")
    assert versions.lookup_with_fallback(df, known, ["k", "u"], ["k"], ["v"], F.col("at")).first().found.v == 7
    assert versions.lookup_with_fallback(df.withColumn("u", F.lit("q")), known, ["k", "u"], ["k"], ["v"], F.col("at")).first().found.v == 3


def test_receive_replay_backfill_and_refresh(spark):
    docs = spark.createDataFrame([("s", "{}"), ("s", "[1]"), ("s", "{}"), ("t", "{}")], "source_uri string, json string")
    stored = spark.createDataFrame([("s", "x", 4)], "source_uri string, content_hash string, version int")
    assert sorted((r.source_uri, r.version) for r in ingest.receive(docs, stored).collect()) == [("s", 5), ("s", 6), ("t", 1)]
    raw = spark.createDataFrame([("s", 1, "old", None, "h"), ("s", 2, " ", b'{"a":1}', "h2"), ("t", 1, None, None, "h")], "source_uri string, version int, raw_text string, raw_binary binary, content_hash string")
    assert [(r.source_uri, r.version, r.json) for r in ingest.replay(raw, raw).collect()] == [("s", 2, '{"a":1}')]
    again = spark.createDataFrame([("t", "h", "text")], "source_uri string, content_hash string, raw_text string")
    assert {(r.source_uri, r.version): r.raw_text for r in ingest.backfill(raw, again).collect()} == {("s", 1): "old", ("s", 2): " ", ("t", 1): "text"}
    cleansed = spark.createDataFrame([("s", 1, "OLD", "keep"), ("t", 1, "OLD", "keep")], "source_uri string, version int, status string, note string")
    done = spark.createDataFrame([("s", 2, "CLEANSED_PENDING_ENRICHMENT"), ("t", 2, "PROCESSED_NO_CHANGES")], "source_uri string, version int, status string")
    assert sorted(tuple(r) for r in ingest.refresh(cleansed, done).collect()) == [("s", 2, "CLEANSED_PENDING_ENRICHMENT", "keep"), ("t", 1, "OLD", "keep")]


def test_vectors_that_are_no_neighbours(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [0.0, 1.0])], "id int, v array<double>")
    assert [r.id for r in search.nearest(rows, "v", [1.0, 0.0], 9, "id").collect()] == [3, 5, 4]
    assert [r.id for r in search.nearest(rows, "v", [1.0, 0.0], 1, "id").collect()] == [3]
    assert search.nearest(rows.limit(0), "v", [1.0], 2, "id").count() == 0


def test_full_text_with_marks_and_json_keys_with_quotes(spark):
    rows = spark.createDataFrame([(1, "Hello wide world", '{"it\'s": {"a": "X"}}'), (2, None, None), (3, "!!!", "{}")], "id int, t string, j string")
    find = lambda q: [r.id for r in fulltext.full_text(rows, ["t"], q).collect()]
    assert find("hello !!!") == [1] and find('"wide world" -nothing') == [1] and find("!!!") == [] and find("") == [] and find("nope or HELLO") == [1]
    assert [r.id for r in rows.where(search.every(search.json_filters(F.col("j"), {"it's": {"a": "x"}}))).collect()] == [1]


def test_observed_rows_and_their_duplicates(spark):
    stored = spark.createDataFrame([("a", 1, 5, True, "n"), ("a", 3, 2, True, "m"), ("b", 1, 1, False, "n"), (None, 1, 1, True, "n")], "k string, last_seen_at int, seen_count long, active boolean, note string")
    seen = spark.createDataFrame([("a", 9), ("c", 4), (None, 2), ("a", 2)], "k string, seen_at int")
    got = sorted((tuple(r) for r in lifecycle.observe(stored, seen, ["k"]).collect()), key=str)
    assert got == sorted([("a", 9, 3, True, "m"), ("a", 1, 5, False, "n"), ("b", 1, 1, False, "n"), ("c", 4, 1, True, None), (None, 2, 2, True, "n")], key=str)


def test_embedding_failures_stay_pending(spark):
    jobs = spark.createDataFrame([(1, "PARTIALLY_ENRICHED"), (2, "PARTIALLY_ENRICHED")], "id long, status string")
    elements = spark.createDataFrame([(1, "ENRICHED"), (2, "ENRICHED")], "cleansed_id long, status string")
    at = datetime.datetime(2020, 1, 1)
    sections = spark.createDataFrame([(10, 1, "s", "/a", "good text", "PENDING_EMBEDDING", at), (20, 2, "s", "/b", "bad text", "PENDING_EMBEDDING", at)], "id long, cleansed_id long, source_uri string, section_path string, cleansed_text string, status string, saved_at timestamp")
    chunks = spark.createDataFrame([], "section_id long, position int, chunk_text string, source_field string, section_path string, vector array<float>")

    def provider(text):
        if "bad" in text:
            return None
        return [1.0, 2.0]

    done = enrich.embed_pending(jobs, elements, sections, chunks, services.Service("some", provider))
    assert {r.id: r.status for r in done.sections.collect()} == {10: "EMBEDDED", 20: "PENDING_EMBEDDING"}
    assert {r.id: r.status for r in done.jobs.collect()} == {1: "ENRICHED_COMPLETE", 2: "PARTIALLY_ENRICHED"}
    assert [r.section_id for r in done.chunks.collect()] == [10]


def test_finalize_consolidates_and_marks(spark):
    jobs = spark.createDataFrame([(1, "s", 1, "ENRICHMENT_QUEUED"), (2, "s", 1, "ENRICHED_COMPLETE")], "id long, source_uri string, version int, status string")
    element = "cleansed_id long, source_uri string, version int, item_source_path string, item_original_field_name string, cleansed_text string, content_hash string, context string, summary string, status string"
    elements = spark.createDataFrame([(j, "s", 1, "/p", f, t, "h", "{}", "sum", "ENRICHED") for j, f, t in ((1, "copy", "words"), (1, "blank", " "), (2, "copy", "other"))], element)
    items_ = spark.createDataFrame([(1, "/p", "copy", "/c ::ref:: /p"), (1, "/p", "copy", "/d ::ref:: /p")], "cleansed_id long, source_path string, original_field_name string, usage_path string")
    hashes = spark.createDataFrame([], HASHES)
    sections = spark.createDataFrame([("old", 1, 1, "s", "/c", "/p", "copy", "words", "x", "EMBEDDED")], "id string, cleansed_id long, version int, source_uri string, section_path string, section_uri string, original_field_name string, cleansed_text string, summary string, status string")
    chunks = spark.createDataFrame([("old", "chunk"), ("elsewhere", "chunk")], "section_id string, chunk_text string")
    done = enrich.finalize(jobs, jobs.select("id"), elements, items_, hashes, sections, chunks)
    assert {r.id: r.status for r in done.jobs.collect()} == {1: "PARTIALLY_ENRICHED", 2: "ENRICHED_COMPLETE"}
    assert sorted((r.section_path, r.original_field_name, r.status) for r in done.sections.collect()) == [("/c", "copy", "PENDING_EMBEDDING"), ("/d", "copy", "PENDING_EMBEDDING"), ("/p", "blank", "EMBEDDED")]
    assert [r.section_id for r in done.chunks.collect()] == ["elsewhere"]


SECTIONS = "id string, cleansed_id long, version int, source_uri string, section_path string, section_uri string, original_field_name string, cleansed_text string, content_hash string, summary string, status string"


def _to_finish(spark):
    """Elements, items, hashes and stored sections: equal elements of several jobs, usages that items and hashes both know, nulls and blanks."""
    rng = random.Random(5)
    places = [("/p", "f"), ("/p", "g"), ("/q", "f"), ("/r", None), ("/s", "f"), (None, "f")]
    elements = [(rng.choice([1, 2, 3, 4, None]), "s", rng.choice([1, 2]), *rng.choice(places), rng.choice(["one", "two", " ", None]), rng.choice(["{}", '{"envelope":{"usagePath":"/own ::ref:: /o"}}', None]), "sum", rng.choice(["ENRICHED", "ERROR_X"])) for _ in range(150)]
    items_ = [(rng.choice([1, 2, 3, None]), *rng.choice(places), rng.choice(["/c ::ref:: /p", "/d ::ref:: /p", "/h ::ref:: /u", None])) for _ in range(60)]
    hashes = [("/p", "f", "/h ::ref:: /u", "h1"), ("/p", "f", "/c ::ref:: /p", "h0"), ("/p", "f", None, "h9"), ("/p", "g", " ", "h2"), ("/q", "f", "/z ::ref:: /u", None), ("/r", None, "/h ::ref:: /u", "h4")]
    sections = [("old", 4, 1, "s", "/h", "/u", "f", "one", "x", "sum", "EMBEDDED")]
    return (
        spark.createDataFrame(elements, "cleansed_id long, source_uri string, version int, item_source_path string, item_original_field_name string, cleansed_text string, context string, summary string, status string"),
        spark.createDataFrame(items_, "cleansed_id long, source_path string, original_field_name string, usage_path string"),
        spark.createDataFrame(hashes, "source_path string, item_type string, usage_path string, content_hash string"),
        spark.createDataFrame(sections, SECTIONS),
    )


def _sections_by_hand(elements, items_, hashes, sections):
    stored = {(s.section_uri, s.section_path, s.original_field_name, s.cleansed_text, s.version): (s.content_hash, s.cleansed_id) for s in sections}
    last = lambda h: (h.usage_path is not None, h.usage_path or "")
    nulls_last = lambda x: (x is None, x or 0)
    made = {}
    for e in elements:
        if e.item_source_path is None or e.cleansed_text is None:
            continue
        place = (e.item_source_path, e.item_original_field_name)
        here = [h for h in hashes if (h.source_path, h.item_type) == place]
        used = {i.usage_path for i in items_ if (i.cleansed_id, i.source_path, i.original_field_name) == (e.cleansed_id, *place) and i.usage_path and place[1]} | {h.usage_path for h in here if (h.usage_path or "").strip() and place[1]}
        for u in used or {json.loads(e.context or "{}").get("envelope", {}).get("usagePath") or e.item_source_path}:
            exact = [h for h in here if h.usage_path == u]
            found = (exact or sorted(here, key=last)[-1:] or [None])[0]
            found = found.content_hash if found else None
            key = (u.split(" ::ref:: ")[-1], u.split(" ::ref:: ")[0], place[1], e.cleansed_text, e.version)
            made[key] = min([(found, e.cleansed_id), *([made[key]] if key in made else [])], key=lambda x: (("" if x[0] is None else x[0]) + "~" * (x[0] is None), nulls_last(x[1])))
    return made | stored


def test_sections_belong_to_the_least_job_by_hash(spark):
    """Whether sections are made whole or only their owners, equal elements of several jobs make one that is the same job's."""
    tables = _to_finish(spark)
    want = _sections_by_hand(*(t.collect() for t in tables))
    for made in (enrich.consolidated(*tables), enrich.section_owners(*tables)):
        rows = made.select(*enrich.SECTION, "content_hash", "cleansed_id").collect()
        assert len(rows) == len(want) and {tuple(r)[:5]: tuple(r)[5:] for r in rows} == want


def test_finished_jobs_wait_for_the_sections_that_are_theirs(spark, tmp_path):
    """Statuses agree with the sections given back, and elements are read once for their sections and once for their states."""
    frames = dict(zip(("elements", "items", "hashes", "sections"), _to_finish(spark)))
    for name, rows in frames.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    elements, items_, hashes, sections = (spark.read.parquet(f"{tmp_path}/{name}") for name in frames)
    jobs = spark.createDataFrame([(1, "s", 1, "ENRICHMENT_QUEUED"), (2, "s", 1, "FINALIZING"), (3, "s", 2, "ENRICHMENT_QUEUED"), (4, "s", 1, "ENRICHED_COMPLETE"), (5, "s", 1, "ENRICHMENT_QUEUED")], "id long, source_uri string, version int, status string")
    done = enrich.finalize(jobs, jobs.select("id"), elements.withColumn("status", F.lit("ENRICHED")), items_, hashes, sections, spark.createDataFrame([("old", "chunk")], "section_id string, chunk_text string"))
    waiting = {s.cleansed_id for s in done.sections.collect() if s.cleansed_text.strip()}
    assert {1} <= waiting and {r.id: r.status for r in done.jobs.collect()} == {j: "PARTIALLY_ENRICHED" if j in waiting else "ENRICHED_COMPLETE" for j in (1, 2, 3)} | {4: "ENRICHED_COMPLETE", 5: "ENRICHMENT_FAILED"}
    plan = done.jobs._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "item_original_field_name" in x for x in plan.splitlines()) == 2 and "chunk_text" not in plan


def test_skipped_items_are_saved_beside_annotations(spark):
    elements = spark.createDataFrame([(1, "/p", "f", "t", None, "sum", None, None, None, "ENRICHED", None, True, True)], "cleansed_id long, item_source_path string, item_original_field_name string, cleansed_text string, content_hash string, summary string, classification string, keywords array<string>, tags array<string>, status string, enrichment_metadata string, user_override_active boolean, new_ai_available boolean")
    items_ = spark.createDataFrame([(1, "/p", "f", "new"), (1, None, "g", "x")], "cleansed_id long, source_path string, original_field_name string, cleansed string")
    got = {r.item_original_field_name: r for r in enrich.save_skipped(elements, items_, F.lit("2020-01-01").cast("timestamp")).collect()}
    assert (got["f"].cleansed_text, got["f"].summary, got["f"].status, got["f"].user_override_active, got["f"].new_ai_available) == ("new", "sum", "ENRICHMENT_SKIPPED", True, True)
    assert got["g"].item_source_path is None and json.loads(got["g"].enrichment_metadata)["enrichmentSkipped"]


def test_views(spark):
    refs = spark.createDataFrame([("de", "de-DE", "n", "/de/", False)], "geo_code string, locale_code string, display_name string, storefront_path string, active boolean")
    assert [(r.geo, r.locales) for r in views.geo_locales(refs, {"US": ["en_US"]}).collect()] == [("US", ["en_US"])]
    assert [(r.geo, r.locales) for r in views.geo_locales(refs.withColumn("active", F.lit(True)), {"US": ["en_US"]}).collect()] == [("DE", ["de_DE"])]
    rows = spark.createDataFrame([("en-us",), ("en_US",), ("de_DE",)], "locale string")
    assert views.locale_rows(rows, " EN-us ").count() == 2 and views.locale_rows(rows, None).count() == 3


def test_chunks_of_long_texts():
    import time

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([("Some words in a sentence here. " * 8000,)], "t string").select(F.size(X.chunks(F.col("t"))).alias("n"))
    df.collect()
    began = time.time()
    assert df.first().n == 1600 and time.time() - began < 3


def test_tables(spark, tmp_path):
    assert store.read_path(spark, f"{tmp_path}/none", "a int").count() == 0
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/some")
    assert store.read_path(spark, f"{tmp_path}/some", "a int").count() == 1
    name = f"t_{abs(hash(str(tmp_path)))}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    location = f"{tmp_path}/table"
    assert store.read(spark, name, "k int, v string").count() == 0
    try:
        spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.option("path", location).saveAsTable(name)
        store.append(spark.createDataFrame([(None, "n")], "k int, v string"), name)
        assert store.read(spark, name, "k int").count() == 3
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_queue_handles_a_batch_again_without_harm(spark, tmp_path):
    box, done, checkpoint = f"{tmp_path}/box", f"{tmp_path}/done", f"{tmp_path}/checkpoint"
    schema = "job string, element int"
    for part in ([("a", 1), ("a", 2)], [("b", 1)]):
        inbox.send(spark.createDataFrame(part, schema), box)
    calls = []

    def handle(batch, number):
        calls.append(number)
        batch.write.mode("overwrite").parquet(f"{done}/{number}")  # by the batch's number: the same again
        if len(calls) == 1:
            raise RuntimeError("lost after writing")

    query = inbox.consume(inbox.messages(spark, box, spark.createDataFrame([], schema).schema, files=1), handle, checkpoint)
    with pytest.raises(Exception):
        query.awaitTermination(60)
    inbox.consume(inbox.messages(spark, box, spark.createDataFrame([], schema).schema, files=1), handle, checkpoint).awaitTermination(60)
    assert calls[0] == calls[1]
    rows = spark.read.parquet(*{f"{done}/{n}" for n in calls})
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("a", 2), ("b", 1)]
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0)], "job string, n_expected int")
    assert {r.job: r.complete for r in inbox.completed(expected, rows, "job").collect()} == {"a": True, "b": False, "c": True}


def test_attempts_wait_longer_and_longer(spark):
    rows = spark.range(1, 9).select(F.unix_seconds(inbox.next_attempt(F.timestamp_seconds(F.lit(0)), F.col("id").cast("int"))).alias("s"))
    assert [r.s for r in rows.collect()] == [30, 60, 120, 240, 300, 300, 300, 300]


def test_services_are_tried_again_at_a_rate():
    pauses, calls = [], []

    def throttled(x):
        calls.append(x)
        if len(calls) < 4:
            raise providers.Throttled
        return x

    assert providers.retried(throttled, base=0.8, sleep=pauses.append)(5) == 5
    assert [round(p - 0.125, 0) for p in pauses] == [1.0, 2.0, 3.0] and all(a <= p <= b for p, a, b in zip(pauses, (0.85, 1.65, 3.25), (1.0, 1.8, 3.4)))
    calls.clear()

    def always(x):
        calls.append(x)
        raise providers.Throttled

    with pytest.raises(providers.Throttled):
        providers.retried(always, sleep=lambda s: None)(1)
    assert len(calls) == 6
    with pytest.raises(ZeroDivisionError):
        providers.retried(lambda: 1 / 0)()
    assert providers.pause(9) == 10.0
    now = [0.0]
    rate = providers.Rate(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        providers.limited(lambda: None, rate)()
    assert now[0] == 2.0


@pytest.mark.parametrize("text,want", [(None, None), (' {"a":1} ', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ("```\nx\n```", "x"), ("```a b\nx```", "a b\nx"), ("``````", "")])
def test_code_fences(text, want):
    assert providers.unfenced(text) == want


def test_prompt_search(spark):
    at = datetime.datetime(2020, 1, 1)
    row = lambda i, key, field: (i, f"/x/{key}", field, f"words of text {i}", json.dumps({"facets": {"sectionKey": key}}), at + datetime.timedelta(days=i))
    sections = spark.createDataFrame([row(1, "hero-section", "Headline"), row(2, "hero-section", "copy"), row(3, "tile-section", "copy"), row(4, "hero-section", "copy")], "id long, section_path string, original_field_name string, cleansed_text string, context string, saved_at timestamp")
    chunks = spark.createDataFrame([(10 + i, i, [1.0, float(i)]) for i in (1, 2, 3)], "chunk_id long, section_id long, vector array<double>")

    def ask(message, made=None, role=None, limit=15):
        found = views.prompt_search(message, chunks, sections, lambda _: [1.0, 0.0], made, role, limit)
        return [r.id for r in found.orderBy("rank").collect()]

    assert ask("what is in Hero-Section") == [4, 2, 1] and ask("what is in hero-section", limit=2) == [4, 2]
    assert ask("give me copy for the hero-section") == [4] and ask("headline of hero-section") == [1]
    assert ask("picture for hero-section") == [4, 2, 1]  # no such role there
    assert ask("x", {"context": {"facets": {"sectionKey": "tile-section"}}}) == [3] and ask("x-section") == []
    assert ask("anything") == [1, 2, 3] and ask("anything", {"original_field_name": "COPY"}) == [2, 3] and ask("anything", limit=1) == [1]
    assert ask("text 3", {"original_field_name": "none"}) == [3]


def test_visible_items(spark):
    rows = spark.createDataFrame([("copy", None), ("copy", True), ("AnalyticsTags", False), (None, False)], "item_type string, skip_enrichment boolean")
    assert sorted((r.item_type for r in views.visible_items(rows).collect()), key=str) == [None, "copy"]
