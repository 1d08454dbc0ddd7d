"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, media, packing, quality, sharding, simhash, suffixdedup, tokencount, toxicity, txlog, urls, whitening
from ._common import table

#: Host, path and verdict of the URL rules that the query applies.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A conversation that is made of control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    done = chat.format_conversations(rows.unionByName(tricky))
    turns = chat.parse_turns(F.col("formatted"))
    read = done.select("conv_id", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), '<part/>', '<\part/>') AS body,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN before IS DISTINCT FROM role THEN length(role) + 14 ELSE 7 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    done = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as WAV samples, sniffed, carved and read back."""
    return media.media_digests(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)([^?#]*)', 1) ELSE '' END AS h,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path FROM pages),
lowered AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM cut),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, max(length(rh || rp)) AS n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM lowered JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT l.page_id, l.host, l.path, b.rule, coalesce(b.rv, 'allow') AS verdict FROM lowered l LEFT JOIN best b USING (page_id)
"""

#: A vocabulary file of a public tokenizer, outside the repository.
VOCABULARY = os.environ.get("SKEINFLOW_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of a document with a smaller id."""
    return suffixdedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    done = toxicity.score(docs, model)
    return done.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH words AS (
  SELECT side, id, unnest(w) AS w, unnest(range(len(w))) AS i, least(len(w), 5) AS most FROM (
    SELECT 'd' AS side, doc_id AS id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') FROM benchmark)),
runs AS (
  SELECT side, id, most, w AS s1, w || ' ' || lead(w, 1) OVER p AS s2, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS s3,
    w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS s4,
    w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS s5
  FROM words WINDOW p AS (PARTITION BY side, id ORDER BY i)),
wide AS (
  SELECT side, id, most, 1 AS width, s1 AS shingle FROM runs UNION ALL SELECT side, id, most, 2, s2 FROM runs UNION ALL SELECT side, id, most, 3, s3 FROM runs
  UNION ALL SELECT side, id, most, 4, s4 FROM runs UNION ALL SELECT side, id, most, 5, s5 FROM runs),
items AS (SELECT DISTINCT id AS item_id, width, shingle FROM wide WHERE side = 'i' AND width = most AND shingle IS NOT NULL),
docs AS (SELECT DISTINCT id AS doc_id, width, shingle FROM wide WHERE side = 'd' AND shingle IS NOT NULL),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*) / any_value(n) AS containment
FROM docs JOIN items USING (width, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted text, and whether it is kept."""
    judged, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_symbols", "bits_per_symbol", F.pow(F.lit(2.0), "bits_per_symbol").alias("perplexity"), "threshold", "keep")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in tokens, packed in bins of five lengths."""
    return packing.best_fit(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole embeddings along their first eight components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one log: the store after each epoch, and every change undone."""
    done = txlog.replay(txlog.document_log(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    states = done.states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    return states.unionByName(done.undone.select("kind", F.col("position").alias("id"), F.col("by").alias("n"), F.col("key").alias("value")))


#: Shards of the query.
N_SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into shards whose counts differ by one at most."""
    done = sharding.shards(table(spark, sf_dir, "documents"), N_SHARDS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return done.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_toxicity": op2_toxicity, "op3_token_counts": op3_token_counts, "op4_decontaminate": op4_decontaminate, "op5_quality": op5_quality, "op6_packing": op6_packing, "op7_chat": op7_chat, "op8_simhash": op8_simhash, "op9_media": op9_media, "op10_urls": op10_urls, "op11_whitening": op11_whitening, "op12_transactions": op12_transactions, "op13_sharding": op13_sharding}
ORACLES = {"op4_decontaminate": OP4_SQL, "op7_chat": OP7_SQL, "op10_urls": OP10_SQL}
