"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations

from . import clicks, runs, upkeep

_VECTOR = "list_transform(range(64), lambda i: ((i * 7) % 13 - 6) / 6.0)"
_DISTANCE = f"list_cosine_distance(embedding::DOUBLE[], ({_VECTOR})::DOUBLE[])"
_OLD = "(SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"
_CLEAN = r"trim(regexp_replace(replace(regexp_replace({x}, '<[^>]+?>', ' ', 'g'), chr(160), ' '), '[ \t\n\v\f\r]+', ' ', 'g'))"


def _chunks(text: str, source: str) -> str:
    """Chunks (doc_id, position, chunk_text) of `source` (doc_id, text)."""
    return rf"""
WITH cut AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(trim({text}, chr(32) || chr(10) || chr(9) || chr(13)), '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM ({source})),
whole AS (
  SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] ELSE list_transform(range(0, greatest(len(s), 1), 5), lambda i: array_to_string(s[i + 1:i + 6], ' ')) END AS c FROM cut WHERE trim(text, chr(32) || chr(10) || chr(9) || chr(13)) <> ''),
single AS (SELECT doc_id, unnest(c) AS chunk_text, unnest(range(len(c))) AS i FROM whole),
once AS (SELECT doc_id, chunk_text, min(i) AS i FROM single GROUP BY doc_id, chunk_text),
chunked AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS position, chunk_text FROM once)
"""


_SECTIONS = """
s AS (SELECT doc_id AS id, source || '-section' AS key, 'page' || doc_id % 5 AS page_id, lang || '_' || upper(lang) AS locale, lang, text,
  '/content/dam/acme/' || lang || '_' || upper(lang) || '/page' || doc_id % 5 || '/' || source || '-section' AS path, ['headline', 'copy', 'body'][(doc_id % 3 + 1)::INT] AS role FROM documents)"""
_EDITED = """
e AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 8 = 2 THEN NULL ELSE lang END AS summary, CASE WHEN doc_id % 6 = 0 THEN 'a,b' ELSE '' END AS tags FROM documents),
c AS (SELECT *, summary IS DISTINCT FROM lang AS s, tags <> '' AS t FROM e)"""
_PAGE_NODES = """(VALUES (0, '_path', NULL, 'value'), (1, '_model', NULL, 'value'), (2, 'headline', NULL, 'object'), (3, 'headline.copy', 'headline', 'value'), (4, 'text', NULL, 'array'), (5, 'text.[0]', 'text', 'value'), (6, 'text.[1]', 'text', 'value'),
  (7, 'heroImage', NULL, 'object'), (8, 'heroImage.viewportSmall', 'heroImage', 'object'), (9, 'heroImage.viewportSmall.uri', 'heroImage.viewportSmall', 'value'), (10, 'heroImage.alt', 'heroImage', 'value')) AS n(ordinal, id, parent, type)"""

SQL: dict[str, str] = {
    "chat_search": f"""
WITH {_SECTIONS},
v AS (SELECT * FROM (SELECT s.*, {_DISTANCE} AS dist FROM s JOIN embeddings ON vec_id = id WHERE key = 'src3-section' AND page_id = 'page3' ORDER BY dist, id LIMIT 15) WHERE role = 'headline'),
m AS (SELECT * FROM (SELECT *, -id AS dist FROM s WHERE key = 'src3-section' ORDER BY id DESC LIMIT 30) WHERE role = 'headline' AND page_id = 'page3'),
b AS (SELECT *, 0 AS arm FROM v UNION ALL SELECT *, 1 FROM m),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY path, role, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) ORDER BY arm, dist, id) = 1)
SELECT 'cf' || row_number() OVER (ORDER BY arm, dist, id) AS cf_id, id, role AS content_role, ['content_chunks', 'consolidated_enriched_sections'][arm + 1] AS source, page_id, 'src3-section,headline,page3' AS terms FROM o ORDER BY arm, dist, id LIMIT 15""",
    "chat_relaxed": f"""
WITH {_SECTIONS},
v AS (SELECT * FROM (SELECT s.*, {_DISTANCE} AS dist FROM s JOIN embeddings ON vec_id = id WHERE key = 'src3-section' AND page_id = 'page3' ORDER BY dist, id LIMIT 15)),
m AS (SELECT * FROM (SELECT *, -id AS dist FROM s WHERE key = 'src3-section' ORDER BY id DESC LIMIT 30) WHERE page_id = 'page3'),
b AS (SELECT *, 0 AS arm FROM v UNION ALL SELECT *, 1 FROM m),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY path, role, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) ORDER BY arm, dist, id) = 1)
SELECT 'cf' || row_number() OVER (ORDER BY arm, dist, id) AS cf_id, id, role AS content_role, ['content_chunks', 'consolidated_enriched_sections'][arm + 1] AS source, page_id, 'src3-section,' || role || ',page3' AS terms FROM o ORDER BY arm, dist, id LIMIT 15""",
    "display_fields": f"WITH {_SECTIONS} SELECT id, 'acme' AS tenant, page_id, locale, lang AS language, upper(lang) AS country, role AS content_role FROM s",
    "refine_chips": f"""
WITH {_SECTIONS},
r AS (SELECT vec_id AS id, 1 / (1 + {_DISTANCE}) AS w, s.* EXCLUDE id FROM (SELECT * FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 90) JOIN s ON id = vec_id),
x AS (SELECT id, 0.2::DOUBLE AS w, s.* EXCLUDE id FROM s WHERE key = 'src3-section' ORDER BY id DESC LIMIT 200),
b AS (SELECT * FROM r UNION ALL SELECT * FROM x),
c AS (SELECT id, w, unnest([{{'type': 'sectionName', 'value': role}}, {{'type': 'sectionKey', 'value': key}}, {{'type': 'Tag', 'value': lang}}, {{'type': 'Tag', 'value': 't' || id % 2}}, {{'type': 'Context:facets.sectionKey', 'value': key}}]) AS chip FROM b)
SELECT chip.type AS type, chip.value AS value, round(sum(w) + CASE WHEN chip.type = 'sectionKey' AND chip.value = 'src3-section' THEN 0.2 WHEN chip.type = 'sectionName' AND chip.value = 'copy' THEN 0.15 ELSE 0 END, 5)::DOUBLE AS score, count(DISTINCT id)::INT AS count FROM c GROUP BY 1, 2""",
    "section_search": f"WITH {_SECTIONS} SELECT id, path AS section_path FROM s WHERE contains(path, 'src1-section') ORDER BY id DESC LIMIT 40",
    "country_codes": "SELECT doc_id, lang AS language, ['DE', 'FR', 'MX', NULL][(doc_id % 4 + 1)::INT] AS country FROM documents",
    "manual_edit": f"WITH {_EDITED} SELECT id, summary, tags, s OR t AS user_override_active, NOT (s OR t) AS new_ai_available FROM c",
    "edit_revisions": f"WITH {_EDITED} SELECT id AS element_id, CASE WHEN id % 6 = 0 THEN 3 ELSE 1 END AS revision, 'USER' AS source, concat_ws(',', CASE WHEN s THEN 'summary' END, CASE WHEN t THEN 'tags' END) AS updated_fields FROM c WHERE s OR t",
    "asset_search": """
SELECT o_orderkey AS id, 'de_DE' AS locale, 'http://example.com/p/' || p_partkey AS preview_uri FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 30 OFFSET 30)
LEFT JOIN part ON p_partkey = o_orderkey % 100""",
    "asset_options": "SELECT value, min(rank)::INT AS rank FROM (SELECT 'home' AS value, 0 AS rank UNION ALL SELECT 'shop', 1 UNION ALL SELECT DISTINCT lower(trim(o_orderpriority)), 2 FROM orders WHERE trim(o_orderpriority) <> '') GROUP BY 1",
    "region_observations": "SELECT geo, locale, 'Uploaded locale ' || locale AS display_name, path AS storefront_path FROM (VALUES ('DE', 'en_DE', '/de/'), ('FR', 'fr_FR', '/fr/fr/'), ('GB', 'en_GB', '/gb/'), ('JP', 'ja_JP', '/jp/ja/')) AS t(geo, locale, path)",
    "json_nodes": f"SELECT 'page:' || page_id AS source_uri, n.* FROM pages, {_PAGE_NODES}",
    "tree_filter": f"SELECT 'page:' || page_id AS source_uri, id FROM pages, {_PAGE_NODES} WHERE id IN ('heroImage', 'heroImage.viewportSmall')",
    "label_functions": """
WITH t AS (SELECT *, CASE WHEN n_chars >= 1048576 THEN 2 WHEN n_chars >= 1024 THEN 1 ELSE 0 END AS p, n_chars / 1024.0::DOUBLE ** CASE WHEN n_chars >= 1048576 THEN 2 WHEN n_chars >= 1024 THEN 1 ELSE 0 END AS v FROM documents)
SELECT doc_id, ['File upload', 'API payload', 'Classpath resource'][(doc_id % 3 + 1)::INT] AS source_label, CASE WHEN p = 0 OR v > 9 THEN printf('%.0f', floor(v + 0.5)) ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) END || ' ' || ['B', 'KB', 'MB'][p + 1] AS size,
  source || ' section' AS path_label, lang || CASE WHEN doc_id % 2 = 0 THEN '-US' ELSE '' END AS locale, doc_id % 2 = 0 AS hidden, doc_id % 2 = 0 AS skipped FROM t""",
    "element_groups": """
SELECT CASE doc_id % 3 WHEN 0 THEN '/p/' || source || '-x' WHEN 1 THEN 'title:' || lang ELSE 'group-' || doc_id END AS group_key, CASE doc_id % 3 WHEN 0 THEN source || ' x' WHEN 1 THEN lang ELSE 'Element group ' || (doc_id + 1) END AS label,
  count(*) AS n, min(doc_id) AS first_position FROM documents GROUP BY 1, 2""",
    "status_history": """
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'ENRICHMENT_COMPLETE' WHEN 'view' THEN 'WAITING_FOR_RESULTS' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'SEEN' END AS status FROM events),
o AS (SELECT user_id, status, min(event_id) AS at FROM e WHERE status IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'WAITING_FOR_RESULTS' THEN 1 WHEN 'ENRICHMENT_COMPLETE' THEN 2 WHEN 'ERROR' THEN 3 ELSE 4 END)::INT AS place FROM o""",
    "json_metadata": "SELECT doc_id::VARCHAR AS source_uri, lang || '_US' AS locale, source AS page_id FROM documents",
    "simple_extract": """
SELECT doc_id::VARCHAR AS source_uri, ordinal, path AS source_path, field, CASE ordinal WHEN 0 THEN source || '!' WHEN 1 THEN lang ELSE source END AS cleansed, model FROM documents,
(VALUES (0, 'content/sections[0]/copy', 'copy', 'hero'), (1, 'content/sections[0]/analyticsAttributes[0]/value', 'value', 'hero'), (2, 'content/disclaimers/items[0]/copy', 'copy', NULL)) AS t(ordinal, path, field, model)""",
    "page_tree_extract": f"""
SELECT 'page:' || page_id AS source_uri, ordinal, url AS source_path, item_type, CASE WHEN ordinal > 0 THEN 'page:' || page_id || ' ::ref:: ' ELSE '' END || url AS usage_path, CASE ordinal WHEN 0 THEN {_CLEAN.format(x='html')} WHEN 1 THEN 'first' ELSE 'second' END AS cleansed
FROM pages, (VALUES (0, 'headline'), (1, 'text[0]'), (2, 'text[1]')) AS t(ordinal, item_type)""",
    "full_text_meta": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id FROM t WHERE (list_has_any(w, ['idiot', 'idiots']) AND NOT list_has_any(w, ['garbage', 'garbages'])) OR list_has_any(w, ['trash', 'trashes', 'trashed', 'trashing', 'trashly']) OR list_contains(w, 'zzz')""",
    "full_text_index": r"""
WITH t AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS line FROM documents),
f AS (SELECT doc_id, regexp_matches(line, ' idiots? ') AS idiot, regexp_matches(line, ' trash(es|ed|ing|ly)? ') AS trash, regexp_matches(line, ' scums? ') AS scum, regexp_matches(line, ' thing(es|ed|ing|ly|lyed|ingly)? ') AS thing,
  regexp_matches(line, ' onst(es|ed|ing|ly)? [^ ]+ thing(es|ed|ing|ly|lyed|ingly)? ') AS near, regexp_matches(line, ' thor(ly|lyed)? ') AS thor FROM t)
SELECT doc_id FROM f WHERE (near AND NOT idiot) OR (thor AND NOT thing) OR (scum AND NOT idiot AND NOT trash)""",
    "annotate_stub": r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CASE WHEN text <> '' THEN array_to_string(w[1:12], ' ') END AS summary, coalesce(text, '') <> '' AS valid FROM w""",
    "storefront_paths": """
WITH n AS (SELECT n_nationkey, upper(n_name[1:2]) AS c, n_nationkey % 3 = 0 AS french FROM nation),
p AS (SELECT *, '/' || lower(c) || '/' || CASE WHEN french THEN 'fr/' ELSE '' END AS path FROM n)
SELECT n_nationkey, 'en_' || c AS locale, path, 'http://example.com' || path AS url FROM p""",
    "user_progress": """
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'ENRICHMENT_TRIGGERED' WHEN 1 THEN 'ENRICHMENT_RUNNING' WHEN 2 THEN 'ENRICHMENT_COMPLETE' ELSE 'OTHER' END AS status,
  CASE WHEN user_id % 4 = 2 THEN 100.0::DOUBLE ELSE greatest(CASE user_id % 4 WHEN 1 THEN 60.0::DOUBLE ELSE 20.0::DOUBLE END, CASE WHEN done > 0 THEN 60 + done / n * 35 END) END AS progress FROM c""",
    "cleanse_html": f"SELECT page_id, sha256({_CLEAN.format(x='html')}) AS cleansed_hash FROM pages",
    "content_hash_dups": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "delta_changed": f"SELECT d.doc_id, sha256(d.text) AS content_hash FROM documents d LEFT JOIN {_OLD} o USING (doc_id, source) WHERE o.text IS NULL OR sha256(o.text) <> sha256(d.text)",
    "delta_two_key_fallback": """
WITH r AS (SELECT doc_id, nullif(source, 'src3') AS source, lang, n_chars FROM documents),
k AS (SELECT doc_id * 2 AS doc_id, source, lang, n_chars FROM r),
loose AS (SELECT source, lang, arg_max(n_chars, doc_id) AS n FROM k GROUP BY 1, 2)
SELECT r.doc_id, r.source, r.lang, coalesce(k.n_chars, l.n) AS found FROM r LEFT JOIN k ON k.doc_id = r.doc_id AND k.source IS NOT DISTINCT FROM r.source LEFT JOIN loose l ON l.source IS NOT DISTINCT FROM r.source AND l.lang = r.lang""",
    "dedup_keep_first": "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1",
    "last_wins": "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1",
    "latest_version": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    "previous_version": "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_turn FROM conversations",
    "mark_latest": "SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS latest FROM conversations",
    "assign_version": """
WITH h AS (SELECT doc_id, nullif(source, 'src3') AS source, CASE WHEN doc_id % 10 < 8 THEN sha256(text) END AS content_hash FROM documents),
stored AS (SELECT DISTINCT source, content_hash FROM h WHERE doc_id % 2 = 0 AND (doc_id % 10 < 8 OR source < 'src4')),
top AS (SELECT source, count(*) AS n FROM stored GROUP BY 1),
new AS (SELECT source, content_hash FROM h WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.source IS NOT DISTINCT FROM h.source AND s.content_hash IS NOT DISTINCT FROM h.content_hash))
SELECT new.source, content_hash, (coalesce(n, 0) + dense_rank() OVER (PARTITION BY new.source ORDER BY content_hash NULLS FIRST))::INT AS version FROM new LEFT JOIN top ON top.source IS NOT DISTINCT FROM new.source""",
    "chunk_sentences": _chunks("text", "SELECT doc_id, text FROM documents") + "SELECT doc_id, count(*) AS n_chunks, sum(length(chunk_text))::BIGINT AS n_chars FROM chunked GROUP BY doc_id",
    "missing_embeddings": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "fifo_claim": "SELECT o_orderkey, o_orderdate FROM orders WHERE trim(o_orderstatus) <> '' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 100",
    "status_counts": "SELECT upper(event_type) AS status, count(*) AS n FROM events GROUP BY 1",
    "final_status": """
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_success, count(*) FILTER (event_type = 'view') AS n_skipped, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1)
SELECT *, CASE WHEN n_success + n_skipped = 0 THEN 'ENRICHMENT_FAILED' WHEN n_error > 0 OR user_id % 2 <> 0 THEN 'PARTIALLY_ENRICHED' ELSE 'ENRICHED_COMPLETE' END AS final_status FROM c""",
    "distinct_pairs": "SELECT DISTINCT source, lang FROM documents WHERE source <> '' AND lang <> ''",
    "grouped_locales": """
SELECT CASE locale WHEN 'en_IN' THEN 'IN' WHEN 'en_AU' THEN 'ANZ' WHEN 'es_MX' THEN 'ALAC-CA' WHEN 'fr_FR' THEN 'Europe' WHEN 'de_DE' THEN 'Europe' ELSE 'WW' END AS geo, string_agg(DISTINCT locale, ',' ORDER BY locale) AS locales
FROM (SELECT lang || '_' || CASE WHEN lang = 'en' THEN ['IN', 'AU', 'US'][(doc_id % 3 + 1)::INT] WHEN lang = 'es' THEN 'MX' ELSE upper(lang) END AS locale FROM documents) GROUP BY 1""",
    "geo_groups": """
SELECT n_nationkey, upper(substr(n_name, 1, 2)) AS country, CASE WHEN c = 'IN' THEN 'IN' WHEN c = 'JP' THEN 'JP' WHEN c = 'KR' THEN 'KR' WHEN list_contains(string_split('AU NZ', ' '), c) THEN 'ANZ'
  WHEN list_contains(string_split('SG MY TH VN ID PH BN KH LA MM', ' '), c) THEN 'SEA' WHEN list_contains(string_split('CA MX AR BO BR CL CO CR DO EC SV GT HN NI PA PY PE UY VE', ' '), c) THEN 'ALAC-CA'
  WHEN list_contains(string_split('AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MT NL NO PL PT RO SE SI SK', ' '), c) THEN 'Europe'
  WHEN list_contains(string_split('AE SA QA KW OM BH JO IL EG MA TN DZ ZA NG KE UG CM CI BW MZ MU SN CF GW GN GQ ML NE AM AZ BY GE KZ KG MD ME MK RU TJ TM UA UZ TR', ' '), c) THEN 'CEMEA' ELSE 'WW' END AS geo
FROM (SELECT *, upper(substr(n_name, 1, 2)) AS c FROM nation)""",
    "optional_filter_page": "SELECT o_orderkey, o_orderdate FROM orders WHERE lower(o_orderstatus) = 'o' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100",
    "site_filter": "SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '://([^/?#]*)', 1)) = 'en' OR contains(lower(url), '/en/')",
    "json_path_filter": "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') IN ('1', '5', '69')",
    "array_contains_all": "SELECT doc_id FROM documents WHERE list_has_all(string_split(text, ' '), ['of', 'the', 'and'])",
    "vector_topk": f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 200",
    "vector_filtered": f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings WHERE label = 1 AND {_DISTANCE} < 1.05 ORDER BY {_DISTANCE}, vec_id LIMIT 50",
    "chip_scores": f"""
WITH r AS (SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 200),
c AS (SELECT 'tag' AS type, 't' || label AS value, vec_id, distance FROM r UNION ALL SELECT 'parity', (vec_id % 2)::VARCHAR, vec_id, distance FROM r)
SELECT type, value, round(sum(1 / (1 + distance)), 6) AS score, count(DISTINCT vec_id // 2) AS count FROM c GROUP BY 1, 2""",
    "merge_ranked_lists": f"""
WITH v AS (SELECT vec_id % 40 AS key, row_number() OVER (ORDER BY {_DISTANCE}, vec_id) AS pos, 0 AS arm FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 30),
t AS (SELECT doc_id % 55 AS key, doc_id + 1 AS pos, 1 AS arm FROM documents ORDER BY doc_id LIMIT 60),
f AS (SELECT * FROM (SELECT * FROM v UNION ALL SELECT * FROM t) QUALIFY row_number() OVER (PARTITION BY key ORDER BY arm, pos) = 1)
SELECT 'cf' || row_number() OVER (ORDER BY arm, pos, key) AS cf_id, key FROM f ORDER BY arm, pos, key LIMIT 40""",
    "usage_fanout": "WITH u AS (SELECT DISTINCT l_orderkey, 'u' || l_suppkey AS usage FROM lineitem) SELECT o_orderkey, coalesce(usage, 'own') AS usage FROM orders LEFT JOIN u ON o_orderkey = l_orderkey",
    "revision_append": """
WITH top AS (SELECT conv_id, max(turn + 1) AS n FROM conversations WHERE turn < 2 GROUP BY 1)
SELECT conv_id, turn, (coalesce(n, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS revision FROM conversations LEFT JOIN top USING (conv_id) WHERE turn >= 2""",
    "save_annotated": """
SELECT coalesce(s.doc_id, i.doc_id + 300) AS doc_id, CASE WHEN i.doc_id IS NOT NULL AND coalesce(s.doc_id, 1) % 4 <> 0 THEN 'new ' || i.source ELSE s.lang END AS summary, s.source AS kept,
  coalesce(s.doc_id % 4 = 0, false) AS user_override_active, coalesce(s.doc_id % 4 = 0 AND i.doc_id IS NOT NULL, false) AS new_ai_available
FROM documents s FULL JOIN documents i ON s.doc_id = i.doc_id + 300""",
    "consolidate": "SELECT DISTINCT source, lang FROM documents",
    "observe_locales": """
WITH s AS (SELECT source, lang, doc_id % 2 AS half, max(doc_id) AS a, count(*) AS n FROM documents GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY a DESC, n DESC) AS k FROM s),
o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source ELSE source || 'b' END AS source, lang, max(doc_id + 5) AS b FROM documents GROUP BY 1, 2)
SELECT coalesce(r.source, o.source) AS source, coalesce(r.lang, o.lang) AS lang, half, greatest(a, b) AS last_seen_at, coalesce(n, 0) + CASE WHEN b IS NULL THEN 0 ELSE 1 END AS seen_count, b IS NOT NULL OR k = 1 AS active
FROM r FULL JOIN o ON r.source = o.source AND r.lang = o.lang AND r.k = 1""",
    "key_replace": """
WITH s AS (SELECT nullif(doc_id, 7) AS doc_id FROM documents), i AS (SELECT nullif(doc_id + 300, 301) AS doc_id FROM documents)
SELECT doc_id, 'old' AS state FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id IS NOT DISTINCT FROM s.doc_id) UNION ALL SELECT doc_id, 'new' FROM i""",
    "locale_from_url": r"""
SELECT page_id, CASE WHEN regexp_matches(url, '/(en|fr|de|es)/') THEN regexp_extract(url, '/(en|fr|de|es)/', 1) || '_US' END AS locale,
  regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""",
    "scalar_functions": """
SELECT doc_id, CASE WHEN contains(lower(text), 'valentine') THEN 'Valentine day' WHEN contains(lower(text), 'father''s day') THEN 'Fathers day' WHEN contains(lower(text), 'tax') THEN 'Tax day' WHEN contains(lower(text), 'christmas') THEN 'Christmas' WHEN contains(lower(text), 'mothers') THEN 'Mothers day' END AS event,
  false AS excluded, sha256(source || '||' || lang) AS slot_hash, 'FILE_UPLOAD_RECEIVED' AS status, lang || ',' || source AS parts, round(1 / (1 + n_chars / 100.0), 6) AS score FROM documents""",
    "page_assets": "SELECT 'page:' || page_id AS source_uri, 'heroImage' AS asset_key, url AS preview_uri, 'a picture' AS alt_text FROM pages",
    "embed_stub": "SELECT doc_id, CASE WHEN text <> '' THEN array_to_string(list_transform(range(26), lambda k: length(text) - length(replace(lower(text), chr((97 + k)::INT), ''))), ',') END AS vector FROM documents",
    **runs.SQL,
    **upkeep.SQL,
    **clicks.SQL,
    "flagship": _chunks("text", f"SELECT d.doc_id, {_CLEAN.format(x='d.text')} AS text FROM documents d LEFT JOIN {_OLD} o USING (doc_id, source) WHERE o.text IS NULL OR {_CLEAN.format(x='o.text')} <> {_CLEAN.format(x='d.text')}") + "SELECT doc_id, position, chunk_text FROM chunked",
}
