"""The annotation run: which items need one, saving results, consolidating sections, finishing jobs, and embedding.

Tables: cleansed (id, source_uri, version, status), items (cleansed_id, source_path, original_field_name, usage_path, cleansed,
skip_enrichment), elements (cleansed_id, source_uri, version, item_source_path, item_original_field_name, cleansed_text,
content_hash, context JSON, summary, classification, keywords, tags, sentiment, status, enrichment_metadata,
user_override_active, new_ai_available), sections and chunks as in `consolidated` and `embed_pending`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import lifecycle as L
from . import search as S
from . import services, store
from .versions import append_absent, first_per, lookup_with_fallback, matching

ELEMENT = ["cleansed_id", "item_source_path", "item_original_field_name"]
VALUES = ["summary", "classification", "keywords", "tags"]
SECTION = ["section_uri", "section_path", "original_field_name", "cleansed_text", "version"]
# States of sections and of jobs.
PENDING, EMBEDDED = "PENDING_EMBEDDING", "EMBEDDED"
FINALIZING = "FINALIZING"
#: Baselines of a job's items: its own elements, those of the version before, and texts known of its source or anywhere.
OWN, BEFORE, SOURCE, ANYWHERE = range(4)
ELIGIBLE = ("ENRICHMENT_QUEUED", "ENRICHMENT_SKIPPED", "ENRICHMENT_IN_PROGRESS")


def typed_items(rows: DataFrame, json: str = "item") -> DataFrame:
    """Typed columns of items kept as JSON objects; rows that aren't objects go. The skip flag may be a boolean or a word."""
    get = lambda name: F.get_json_object(F.col(json), f"$.{name}")
    names = (("sourcePath", "source_path"), ("originalFieldName", "original_field_name"), ("usagePath", "usage_path"), ("cleansedContent", "cleansed"), ("model", "model"), ("context", "context"))
    skip = F.coalesce(F.lower(get("skipEnrichment")) == "true", F.lit(False))
    objects = rows.where(X.strip(F.col(json)).startswith("{") & F.try_parse_json(json).isNotNull())
    return objects.select(*[c for c in rows.columns if c != json], *[get(a).alias(b) for a, b in names], skip.alias("skip_enrichment"))


def to_annotate(items: DataFrame, cleansed: DataFrame, elements: DataFrame) -> DataFrame:
    """Items that need annotation, of each (cleansed_id, source_path, original_field_name) the first by `ordinal`.

    Their baseline is, for each cleansed id: its own elements if it has some; else those of its source's version before,
    from version 2 on; else any element of the source (of all sources where it is null) with the same text.
    Hashes are compared where both sides have one, texts otherwise. All baselines are one union, of which minima find the row of
    each name, and each item is looked up once.
    """
    pair = ["source_path", "original_field_name"]
    own = elements.select("cleansed_id", F.lit(None).cast("string").alias("source_uri"), F.lit(None).cast("int").alias("version"), F.lit(True).alias("own"), F.lit(False).alias("job"))
    jobs = cleansed.select(F.col("id").alias("cleansed_id"), "source_uri", F.col("version").cast("int").alias("version"), F.lit(False).alias("own"), F.lit(True).alias("job")).unionByName(own)
    jobs = jobs.groupBy("cleansed_id").agg(F.max("source_uri").alias("_source"), F.max("version").alias("_version"), F.max("own").alias("_own"), F.max("job").alias("_job")).where("_job")
    kind = F.when(F.col("_own"), OWN).when(F.col("_source").isNull(), ANYWHERE).when(F.col("_version") > 1, BEFORE).otherwise(SOURCE)
    once = first_per(items.join(jobs, "cleansed_id"), ["cleansed_id", *pair], F.col("ordinal").asc_nulls_last())
    known = elements.where("item_source_path is not null and item_original_field_name is not null")
    known_hash = F.coalesce("content_hash", X.content_hash(F.col("cleansed_text")))

    def named(kinds: Column, by_kind: dict[int, tuple[Column, ...]]) -> Column:
        """A baseline's name: its kind and what it is looked up by, in one string."""
        parts = {k: F.to_json(F.array(*[c.cast("string") for c in by]), {"ignoreNullFields": "false"}) for k, by in by_kind.items()}
        return F.concat(kinds.cast("string"), F.coalesce(*[F.when(kinds == k, p) for k, p in parts.items()]))

    e = lambda c: F.col(f"e.{c}")
    hashed = known.withColumn("_hash", known_hash).select(F.struct("cleansed_id", "source_uri", "version", "item_source_path", "item_original_field_name", "cleansed_text", "content_hash", "_hash").alias("e"))
    keys = ["_name", "_path", "_field"]

    def baseline(rows: DataFrame, name: Column, valued: Column) -> DataFrame:
        """Names with what they stand for; where only the name counts, nothing, so that equal ones are one row."""
        value = lambda c: F.when(valued, e(c))
        return rows.select(name.alias("_name"), e("item_source_path").alias("_path"), e("item_original_field_name").alias("_field"), value("content_hash").isNull().alias("none"), value("content_hash").alias("content_hash"), value("cleansed_text").alias("cleansed_text"))

    # elements of jobs of their own are about one a name and go to it unsorted; of the others equal rows are one before any sort
    own_rows = baseline(hashed, named(F.lit(OWN), {OWN: (e("cleansed_id"),)}), F.lit(True)).repartition(*keys)
    spread = hashed.withColumn("k", F.explode(F.array(*map(F.lit, (BEFORE, SOURCE, ANYWHERE)))))
    spread = spread.where((F.col("k") != BEFORE) | e("source_uri").isNotNull() & e("version").isNotNull()).where((F.col("k") != SOURCE) | e("source_uri").isNotNull())
    names = named(F.col("k"), {BEFORE: (e("source_uri"), e("version")), SOURCE: (e("source_uri"), e("_hash")), ANYWHERE: (e("_hash"),)})
    base = own_rows.unionByName(baseline(spread, names, F.col("k") == BEFORE).distinct())
    base = base.groupBy(*keys).agg(F.min(F.struct("none", "content_hash", "cleansed_text")).alias("_found"))
    mine = once.withColumn("_kind", kind).withColumn("_hash", X.content_hash(F.col("cleansed")))
    mine = mine.withColumn("_mine", named(F.col("_kind"), {OWN: (F.col("cleansed_id"),), BEFORE: (F.col("_source"), F.col("_version") - 1), SOURCE: (F.col("_source"), F.col("_hash")), ANYWHERE: (F.col("_hash"),)}))
    joined = mine.join(base, (F.col("_mine") == F.col("_name")) & (F.col("source_path") == F.col("_path")) & (F.col("original_field_name") == F.col("_field")), "left")
    old, text = F.col("_found.content_hash"), F.col("_found.cleansed_text")
    differs = F.when(old.isNotNull() & F.col("_hash").isNotNull(), F.col("_hash") != old).otherwise(text.isNull() | ~text.eqNullSafe(F.col("cleansed")))
    return joined.where(F.when(F.col("_kind").isin(OWN, BEFORE), differs).otherwise(F.col("_found").isNull())).select(*items.columns)


def save(elements: DataFrame, done: DataFrame, model: str, at: Column | None = None) -> DataFrame:
    """Elements with annotations saved; what a user has overridden keeps its values and is marked as having newer ones."""
    stamp = F.to_json(F.struct(F.lit(model).alias("enrichedWithModel"), (at if at is not None else F.current_timestamp()).cast("string").alias("enrichmentTimestamp")))
    rows = _described(done, elements).withColumn("enrichment_metadata", stamp).withColumn("status", F.lit("ENRICHED"))
    always = [c for c in ("source_uri", "version", "cleansed_text", "content_hash", "context", "sentiment", "status", "enrichment_metadata") if c in elements.columns]
    return L.save_annotated(elements, rows, ELEMENT, VALUES, always)


def save_marked(elements: DataFrame, items: DataFrame, status: str, metadata: Column) -> DataFrame:
    """Elements of items that failed or were skipped: text, hash, status and metadata; annotations and flags stay."""
    rows = _described(items, elements).withColumn("enrichment_metadata", metadata).withColumn("status", F.lit(status))
    always = [c for c in ("source_uri", "version", "cleansed_text", "content_hash", "context", "status", "enrichment_metadata") if c in elements.columns]
    done = L.save_annotated(elements.withColumn("_flag", F.coalesce("new_ai_available", F.lit(False))), rows, ELEMENT, [], always)
    return done.withColumn("new_ai_available", F.coalesce("_flag", F.lit(False))).drop("_flag")


def save_error(elements: DataFrame, items: DataFrame, message: Column, status: str = "ERROR_ENRICHMENT_FAILED") -> DataFrame:
    return save_marked(elements, items, status, F.to_json(F.struct(message.alias("enrichmentError"))))


def save_skipped(elements: DataFrame, items: DataFrame, at: Column, status: str = "ENRICHMENT_SKIPPED") -> DataFrame:
    return save_marked(elements, items, status, F.to_json(F.struct(F.lit(True).alias("enrichmentSkipped"), F.lit("Excluded via configuration").alias("reason"), at.cast("string").alias("timestamp"))))


def _described(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Items under the names of elements, with their text's hash; columns that they lack are null."""
    named = rows.withColumnsRenamed({"source_path": "item_source_path", "original_field_name": "item_original_field_name", "cleansed": "cleansed_text"})
    named = named.withColumn("content_hash", X.content_hash(F.col("cleansed_text")))
    lacking = [f for f in elements.schema.fields if f.name not in named.columns]
    return named.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}) if lacking else named


def revisions(stored: DataFrame, before: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """New revisions by the model for annotated items: `applied` is false where a user's override held in `before`."""
    rows = _described(done, before)
    keys = before.select(*[F.col(k).alias(f"_b_{k}") for k in ELEMENT], F.coalesce("user_override_active", F.lit(False)).alias("_held"))
    joined = rows.join(keys, matching(rows, keys, ELEMENT, "_b_"), "left")
    held = F.coalesce("_held", F.lit(False))
    made = joined.select(F.concat_ws("::", *[F.col(k).cast("string") for k in ELEMENT]).alias("element_id"), *[joined[v] for v in VALUES], F.lit("AI").alias("source"), F.lit(model).alias("model_used"), (~held).alias("applied"), F.when(held, "USER_OVERRIDE").alias("blocked_by"))
    return L.append_revisions(stored, made, "element_id", F.col("element_id"))


def spread_usages(elements: DataFrame, items: DataFrame, hashes: DataFrame, once: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """`elements` for each `usage_path`: usages in a job's own items, and those that the hashes know of its path and field; where there are none, column `own_usage`.

    A usage that both have comes twice. Each element goes once to its job's usages and once to those of its place, so they are read once and
    the two don't multiply; `once` may make equal rows one before they go to the latter.
    """
    names = {"cleansed_id": "cleansed_id", "source_path": ELEMENT[1], "original_field_name": ELEMENT[2]}
    own = items.where("source_path is not null and original_field_name is not null and usage_path is not null").select(*[F.col(k).alias(f"_u_{n}") for k, n in names.items()], "usage_path").distinct()
    twice = elements.withColumn("_place", F.explode(F.array(F.lit(False), F.lit(True))))
    mine = twice.join(own, matching(twice, own, ELEMENT, "_u_") & ~twice["_place"], "left").drop(*[f"_u_{k}" for k in ELEMENT])
    rows = once(mine.withColumn("own_usage", F.when(~F.col("_place") & F.col("usage_path").isNull(), F.col("own_usage"))))
    # of each place all usages, and one row that says that it has some
    some = F.explode(F.array(F.struct(F.lit(True).alias("place"), F.col("usage_path").alias("usage")), F.struct(F.lit(False).alias("place"), F.lit(None).cast("string").alias("usage"))))
    known = hashes.where(X.blank_to_null(F.col("usage_path")).isNotNull()).select(F.col("source_path").alias("_path"), F.col("item_type").alias("_field"), some.alias("_at")).select("_path", "_field", "_at.*").distinct()
    at = (F.col(ELEMENT[1]) == F.col("_path")) & (F.col(ELEMENT[2]) == F.col("_field")) & (F.col("_place") == F.col("place"))
    used = F.when(F.col("_place"), F.col("usage")).otherwise(F.coalesce("usage_path", F.when(F.col("place").isNull(), F.col("own_usage"))))
    return rows.join(known, at, "left").withColumn("usage_path", used).where("usage_path is not null").drop("own_usage", "_place", "_path", "_field", "place", "usage")


def _usable(elements: DataFrame) -> DataFrame:
    own = F.coalesce(X.blank_to_null(F.get_json_object("context", "$.envelope.usagePath")), F.col("item_source_path"))
    return elements.where("item_source_path is not null and cleansed_text is not null").withColumn("own_usage", own)


def _placed(usable: DataFrame, items: DataFrame, hashes: DataFrame, once: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """`usable` for each usage path, under the names of sections, with place and hash."""
    spread = spread_usages(usable, items, hashes, once).drop("content_hash").withColumn("item_type", F.col("item_original_field_name")).withColumn("source_path", F.col("item_source_path"))
    found = lookup_with_fallback(spread, hashes, ["source_path", "item_type", "usage_path"], ["source_path", "item_type"], ["content_hash"], F.col("usage_path"))
    place = {"section_path": X.usage_container(F.col("usage_path")), "section_uri": X.usage_fragment(F.col("usage_path"))}
    return found.select("*", F.col("found.content_hash").alias("content_hash"), F.col("item_original_field_name").alias("original_field_name"), *[F.coalesce(c, F.col("item_source_path")).alias(n) for n, c in place.items()])


def _first_owner(columns: Sequence[str]) -> list[Column]:
    """Of elements that make one section the first by hash, then by job: the same whatever else is asked of it."""
    return [F.col(c).asc_nulls_last() for c in ("content_hash", "cleansed_id") if c in columns]


def consolidated(elements: DataFrame, items: DataFrame, hashes: DataFrame, sections: DataFrame) -> DataFrame:
    """`sections` and the new ones of `elements`: each element once for each usage path, with its hash, unless the section is there in that version."""
    made = _placed(_usable(elements), items, hashes)
    missing = [f for f in sections.schema.fields if f.name not in made.columns]
    made = made.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else made
    return append_absent(sections, made.select(*sections.columns), SECTION, *_first_owner(sections.columns))


def section_owners(elements: DataFrame, items: DataFrame, hashes: DataFrame, sections: DataFrame) -> DataFrame:
    """Keys, job and hash of all sections of `consolidated`, without what else they hold.

    Of elements with equal keys only the least job counts, so they are one row in each task before they meet usages and hashes, and again before their sections are ranked.
    """
    least = lambda rows: rows.groupBy(*[c for c in rows.columns if c != "cleansed_id"]).agg(F.min("cleansed_id").alias("cleansed_id"))
    columns = [*SECTION, *[c for c in ("content_hash", "cleansed_id") if c in sections.columns]]
    usable = _usable(elements).select(*ELEMENT, "cleansed_text", "version", "own_usage")
    made = least(_placed(usable, items, hashes, least).select(*SECTION, "content_hash", "cleansed_id").select(*columns))
    return append_absent(sections.select(*columns), made, SECTION, *_first_owner(columns))


def claim_status(jobs: DataFrame, ids: DataFrame, expected: Sequence[str], to: str) -> tuple[DataFrame, DataFrame]:
    """(jobs after, ids won): rows of `ids` (id) in one of the `expected` states get the new one. One writer at a time, as a file table has no row locks."""
    won = jobs.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status").isin(*expected)).select("id")
    return set_status(jobs, won, to), won


def set_status(rows: DataFrame, ids: DataFrame, status: str, key: str = "id", only: Column | None = None) -> DataFrame:
    """`rows` with the status of those named in `ids` (key) replaced, where `only` holds."""
    marked = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False)) & (only if only is not None else F.lit(True))
    return marked.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).select(*rows.columns)


def delete_chunks(chunks: DataFrame, sections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunks but for those of the sections of `jobs` (id)."""
    gone = sections.join(jobs.select(F.col("id").alias("cleansed_id")), "cleansed_id", "left_semi").select(F.col("id").alias("section_id"))
    return chunks.join(gone, "section_id", "left_anti").select(*chunks.columns)


def missing_embeddings(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (cleansed_id, n): sections with text and without a chunk."""
    filled = sections.where(X.blank_to_null(F.col("cleansed_text")).isNotNull()).join(chunks.select(F.col("section_id").alias("id")), "id", "left_anti")
    return filled.groupBy("cleansed_id").agg(F.count("*").alias("n"))


def final_statuses(jobs: DataFrame, elements: DataFrame, sections: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """`jobs` with the final status of those in `ids` (id), by the states of their elements and what is still to embed."""
    return _decided(jobs, elements, missing_embeddings(sections, chunks), ids)


def _decided(jobs: DataFrame, elements: DataFrame, open_ones: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the jobs asked for, of their elements and of what they have open are counted together: nothing is sorted to be joined before."""
    asked = ids.select(F.col("id").alias("cleansed_id"))
    of = lambda rows, status, n: rows.select("cleansed_id", status.alias("status"), n.alias("n"))
    theirs = lambda rows: rows.join(asked, "cleansed_id", "left_semi")
    none = F.lit(0).cast("long")
    states = of(asked, F.lit(None).cast("string"), none).unionByName(of(theirs(elements.select("cleansed_id", "status")), F.col("status"), none)).unionByName(of(theirs(open_ones), F.lit(None).cast("string"), F.col("n")))
    waits = F.when(F.col("n") > 0, False)  # null where nothing is open, so that one row that waits decides
    decided = L.final_status(states, "status", waits, "cleansed_id").select(F.col("cleansed_id").alias("id"), "final_status")
    return jobs.join(decided, "id", "left").withColumn("status", F.coalesce("final_status", "status")).select(*jobs.columns)


@dataclass(frozen=True)
class Final:
    jobs: DataFrame
    sections: DataFrame
    chunks: DataFrame


def finalize(jobs: DataFrame, ids: DataFrame, elements: DataFrame, items: DataFrame, hashes: DataFrame, sections: DataFrame, chunks: DataFrame) -> Final:
    """Finish the jobs of `ids` that can be: consolidate, drop old chunks, mark sections for embedding (blank ones as done), set the status."""
    _, won = claim_status(jobs, ids, (*ELIGIBLE, FINALIZING), FINALIZING)
    own = lambda df: df.join(won.select(F.col("id").alias("cleansed_id")), "cleansed_id", "left_semi").select(*df.columns)
    after = consolidated(own(elements), own(items), hashes, sections)
    left = delete_chunks(chunks, after, won)
    versions = jobs.join(won, "id", "left_semi").select(F.col("id").alias("cleansed_id"), F.col("version").alias("_v"))
    blank = X.blank_to_null(F.col("cleansed_text")).isNull()
    marked = after.join(versions.withColumn("_hit", F.lit(True)), "cleansed_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("_v").isNull() | (F.col("version") == F.col("_v")))
    marked = marked.withColumn("status", F.when(hit, F.when(blank, EMBEDDED).otherwise(PENDING)).otherwise(F.col("status"))).select(*after.columns)
    # no section of these jobs has chunks now, so all that have text are still to embed
    filled = section_owners(own(elements), own(items), hashes, sections).where(X.blank_to_null(F.col("cleansed_text")).isNotNull())
    return Final(_decided(jobs, elements, filled.groupBy("cleansed_id").agg(F.count("*").alias("n")), won), marked, left)


OFFLINE = services.Service("embed_offline", L.embed_offline)


def embed_pending(jobs: DataFrame, elements: DataFrame, sections: DataFrame, chunks: DataFrame, service: services.Service = OFFLINE, limit: int = 25, ledger: str | None = None) -> Final:
    """One batch of the embedding worker: the longest waiting sections get their chunks with vectors.

    The batch is claimed and its chunks are asked for before anything else is planned: each text is asked once, and not at all if the ledger has it. A
    section of which a chunk fails gets no chunks and stays pending, so it comes again. Jobs with nothing left to embed get their final status.
    """
    wanted = sections.where(F.col("status") == PENDING)
    batch = store.kept(S.claim(wanted, chunks.select(F.col("section_id").alias("id")), "id", "cleansed_text", "saved_at", limit))
    cut = L.chunk_rows(batch, "id", "cleansed_text").withColumnRenamed("id", "section_id")
    asked = services.ask(cut, "chunk_text", service, ledger or services.ledger_folder(sections.sparkSession)).withColumnRenamed("answer", "vector")
    made = store.kept(asked.join(batch.select(F.col("id").alias("section_id"), F.col("source_uri").alias("source_field"), "section_path"), "section_id"))
    failed = made.where("vector is null").select("section_id").distinct()
    good = made.join(failed, "section_id", "left_anti")
    after_chunks = chunks.unionByName(good.select(*chunks.columns))
    embedded = good.select(F.col("section_id").alias("id")).distinct()
    after = set_status(sections, embedded, EMBEDDED)
    touched = batch.select(F.col("cleansed_id").alias("id")).distinct()
    still = missing_embeddings(after, after_chunks).select(F.col("cleansed_id").alias("id"))
    return Final(final_statuses(jobs, elements, after, after_chunks, touched.join(still, "id", "left_anti")), after, after_chunks)


def metrics(elements: DataFrame, *keys: str) -> DataFrame:
    """Per job: annotated fields, the mean readability gain and errors, where elements carry such columns."""
    number = lambda name, f: f(F.col(name)) if name in elements.columns else F.lit(None).cast("double")
    return elements.groupBy(*keys).agg(F.coalesce(number("fields_tagged", F.sum), F.count("*").cast("double")).cast("long").alias("total_fields_tagged"), number("readability_delta", F.avg).alias("readability_improved"), number("errors_found", F.sum).cast("long").alias("errors_found"))
