"""What a task holds at a time doesn't grow with the documents that Spark hands it at once."""

import json

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinflow.operators import enrich
from skeinflow.sources import json_items, json_tree


def test_rows_are_handed_over_by_the_size_of_their_documents(spark):
    texts = [json.dumps({"_path": "/p", "headline": {"copy": "word " * 20_000}, "text": ["a", "b"]})] * 60 + [None, "{broken", "{}"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([f"s{i}" for i in range(len(texts))]), pa.array([7] * len(texts), pa.int32())], names=["json", "source_uri", "version"])
    kinds = to_arrow_schema(T.StructType.fromDDL(f"{json_items.ITEM_SCHEMA}, version int"))
    made = list(json_items._handed_over(iter([batch, batch]), json_items.item_rows, kinds))
    assert max(b.nbytes for b in made) < 6 * json_items.BATCH_CHARS  # all of a batch in one: 18 MB
    rows = pa.Table.from_batches(made).to_pylist()
    assert [(r["source_uri"], r["ordinal"], r["version"]) for r in rows] == [(f"s{i}", k, 7) for i in range(60) for k in range(3)] * 2
    assert list(json_items._handed_over(iter([]), json_items.item_rows, kinds)) == []


def test_filtered_trees_walk_their_documents_once(spark):
    """Nodes of documents with one source count together, whatever document a hit is in; names with dots stand for paths, as ids do."""
    docs = spark.createDataFrame([("a", '{"x": {"SKU": 1, "y": 2}, "z": [{"sku": {}}, 3]}'), ("a", '{"x": {"y": 5}, "z": [1, {"w": 1}], "q": {"r": 1}}'), ("a", '{"q.r.sku": 1}'), ("b", '{"x": {"y": 1}}'), (None, '{"sku": 1}')], "source_uri string, json string")
    got = json_tree.filtered(json_tree.nodes(docs), "Sku")
    assert sorted(got.select("source_uri", "id").collect()) == sorted(("a", i) for i in ("x", "x.SKU", "z", "z.[0]", "z.[0].sku", "x", "z", "z.[0]", "q", "q.r", "q.r.sku"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_baselines_of_annotation_are_few_before_they_are_sorted(spark):
    """Elements stand in a sort once, under their own job; of the other baselines equal ones are one row before."""
    jobs = spark.createDataFrame([(1, "s", 1, "Q"), (2, "s", 2, "Q"), (3, None, 5, "Q"), (4, "t", 1, "Q"), (5, "s", 3, "Q")], "id long, source_uri string, version int, status string")
    items = spark.createDataFrame([(j, "/p", "f", t, o) for j in range(1, 6) for o, t in enumerate(("known", "new"))] + [(j, "/q", "f", "known", 0) for j in range(1, 6)], "cleansed_id long, source_path string, original_field_name string, cleansed string, ordinal int")
    elements = spark.createDataFrame([(2, "s", 2, "/p", "f", "other", None), (9, "s", 2, "/p", "f", "known", None), (9, "s", 2, "/p", "f", "a", None), (9, None, None, "/q", "f", "known", None)], "cleansed_id long, source_uri string, version int, item_source_path string, item_original_field_name string, cleansed_text string, content_hash string")
    got = enrich.to_annotate(items, jobs, elements)
    assert sorted((r.cleansed_id, r.source_path) for r in got.collect()) == [(1, "/q"), (2, "/p"), (2, "/q"), (4, "/p"), (4, "/q"), (5, "/p"), (5, "/q")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([1,2,3])" in plan and "explode([0,1,2,3])" not in plan and "RepartitionByExpression" in plan
