from lexweave.llm import queries


def test_canonical_form_of_both_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.p7_canonical(spark, d).collect()
    for name in ("legal_chunks", "normalized_artifacts"):
        assert sum(r["table_name"] == name for r in rows) == spark.read.parquet(f"{d}/{name}.parquet").count()
    assert {(r["table_name"], r["record_key"]) for r in rows if r["changed"] and r["record_key"]} == {tuple(r) for r in queries.p7_found(spark, d).collect()}
