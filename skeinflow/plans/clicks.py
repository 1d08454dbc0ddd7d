"""Queries over JSON as it arrives: the properties of all clicks, of which some are missing, broken, repeated or nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources import json_tree

PATHS = {"k": "k", "os": "device.os", "second_tag": "tags.[1]", "first_sku": "items.[0].sku", "items": "items"}


def _clicks(spark, d) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/clicks.parquet")


def _nodes(spark, d) -> DataFrame:
    return json_tree.nodes(_clicks(spark, d).select(F.col("click_id").cast("string").alias("source_uri"), F.col("props").alias("json")))


def click_nodes(spark, d):
    """Every node of every click's properties; broken ones have none."""
    return _nodes(spark, d)


def click_leaves(spark, d):
    """Nodes without children."""
    return json_tree.leaves(_nodes(spark, d)).select("source_uri", "id", "type", "value")


def click_tree_filter(spark, d):
    """Labels that hold a text, without case, and the nodes above them."""
    return json_tree.filtered(_nodes(spark, d), "SKU").select("source_uri", "ordinal", "id")


def click_values(spark, d):
    """What some paths lead to, objects and arrays not among them; null where a path leads nowhere."""
    values = [json_tree.value_at(F.col("props"), p).alias(n) for n, p in PATHS.items() if n != "items"]
    return _clicks(spark, d).select("click_id", *values, json_tree.value_at(F.col("props"), PATHS["items"]).isNotNull().alias("has_items"))


QUERIES = {f.__name__: f for f in (click_nodes, click_leaves, click_tree_filter, click_values)}

_ID = r"regexp_replace(replace({}, '[', '.['), '^\$\.', '')"
_NODES = f"""
good AS MATERIALIZED (SELECT row_number() OVER () AS doc, click_id::VARCHAR AS source_uri, props::JSON AS json FROM clicks WHERE json_valid(props)),
tree AS (
  SELECT source_uri, (row_number() OVER (PARTITION BY doc ORDER BY t.id) - 1)::INT AS ordinal, {_ID.format('fullkey')} AS id, CASE WHEN path <> '$' THEN {_ID.format('path')} END AS parent,
    CASE WHEN fullkey LIKE '%]' THEN '[' || key || ']' ELSE key END AS label, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'value' END AS type,
    CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN CASE WHEN t.value::VARCHAR IN ('{{}}', '[]') THEN t.value::VARCHAR END WHEN t.type = 'NULL' THEN 'null' ELSE t.value ->> '$' END AS value
  FROM good, json_tree(good.json) AS t WHERE fullkey <> '$')"""
_GOOD = "good AS MATERIALIZED (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS props FROM clicks)"

SQL = {
    "click_nodes": f"WITH {_NODES} SELECT * FROM tree",
    "click_leaves": f"WITH {_NODES} SELECT source_uri, id, type, value FROM tree WHERE (source_uri, id) NOT IN (SELECT (source_uri, parent) FROM tree WHERE parent IS NOT NULL AND source_uri IS NOT NULL)",
    "click_tree_filter": f"""
WITH {_NODES}, hit AS (SELECT DISTINCT source_uri, id FROM tree WHERE lower(label) LIKE '%sku%')
SELECT source_uri, ordinal, id FROM tree WHERE EXISTS (SELECT 1 FROM hit WHERE hit.source_uri = tree.source_uri AND (hit.id = tree.id OR starts_with(hit.id, tree.id || '.')))""",
    "click_values": f"WITH {_GOOD} SELECT click_id, "
    + ", ".join(f"props ->> '$.{p.replace('.[', '[')}' AS {n}" for n, p in PATHS.items() if n != "items")
    + ", coalesce(json_exists(props, '$.items'), false) AS has_items FROM good",
}
