import shutil

from pyspark.sql import functions as F

from lexweave import registry


def test_fallback_only_without_dense_hits(spark, data, tmp_path):
    shutil.copy(f"{data}/documents.parquet", tmp_path)
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = [r["query_id"] for r in registry._hits(spark, data)[1].select("query_id").distinct().orderBy("query_id").collect()]
    bad = F.when(F.col("vec_id") == asked[0], F.lit(None)).otherwise(F.transform("embedding", lambda x: F.when(F.col("vec_id") == asked[-1], F.lit(float("nan"))).otherwise(x)))
    v.withColumn("embedding", bad.cast(v.schema["embedding"].dataType)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.whole_fallback_topk(spark, str(tmp_path)).collect()
    # Without a vector, or with one of NaN: sparse hits; every other query: its dense hits.
    assert {r["query_id"] for r in got if r["fallback"]} == {asked[0], asked[-1]}
    dense = registry.dense_topk(spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got if not r["fallback"]} == {tuple(r) for r in dense}
