"""Queries of the registry on small tables of their own."""

from skeinflow.plans import registry


def test_merge_ranks_all_documents(spark, tmp_path):
    ids = [55 * k for k in range(60)] + [55 * 60 + k for k in range(1, 11)]  # the first 60 have one key
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.merge_ranked_lists(spark, str(tmp_path)).collect()
    assert sorted(r.key for r in got) == list(range(11))


def test_values_at_paths(spark):
    from pyspark.sql import functions as F

    from skeinflow.sources import json_tree

    text = '{"a":{"b c":[1,null,"null",{"d":"é"}]},"e":null,"f":[]}'
    rows = spark.createDataFrame([(text,), ('{"a":1',), ("",), (None,)], "json string")
    paths = ["a.b c.[0]", "a.b c.[1]", "a.b c.[2]", "a.b c.[3].d", "a.b c.[4]", "e", "f", "g.[0]"]
    got = rows.select(*[json_tree.value_at(F.col("json"), p) for p in paths]).collect()
    assert tuple(got[0]) == ("1", None, "null", "é", None, None, "[]", None)
    assert all(v is None for r in got[1:] for v in r)
