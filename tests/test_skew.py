from collections import Counter

from lexweave.operators import skew


def rows(spark):
    data = [("hot", f"c{i % 40}", f"a{i % 7}", "x" * (i % 5)) for i in range(400)] + [(None, "c1", None, None), ("b", None, "a1", ""), ("b", "c1", "a1", "ab"), ("b", "c1", "a1", "ab")]
    return data, spark.createDataFrame(data, "law_id string, chunk_id string, article string, text string").selectExpr("*", "1 AS k", "2 AS n", "3 AS v", "4 AS s", "5 AS n_rows")


def test_states(spark):
    data, df = rows(spark)
    got = {r["law_id"]: r for r in skew.key_states(df, "law_id", "text", ["chunk_id", "article"]).collect()}
    for key in {d[0] for d in data}:
        own = [d for d in data if d[0] == key]
        r = got[key]
        assert (r["n_rows"], r["size_sum"]) == (len(own), sum(len(d[3] or "") for d in own))
        assert r["distinct_chunk_id"] == len({d[1] for d in own} - {None}) and r["distinct_article"] == len({d[2] for d in own} - {None})
    assert len(got) == 3


def test_join_without_joining_rows(spark):
    data, df = rows(spark)
    other = spark.createDataFrame([("hot", "yy"), ("hot", None), ("c", "z"), (None, "q")], "law_id string, body string")
    got = {r["law_id"]: r for r in skew.joined_states(df, other, "law_id", "text", "body").collect()}
    real = df.join(other, "law_id").selectExpr("law_id", "length(text) AS a", "length(body) AS b").collect()
    n = Counter(r["law_id"] for r in real)
    assert {k: r["n_joined"] for k, r in got.items()} == dict(n)
    left = {r["law_id"]: r for r in skew.joined_states(df, other, "law_id", "text", how="left").collect()}
    assert (left["b"]["n_right"], left["b"]["n_joined"], left["b"]["left_size_joined"]) == (0, 3, 4) and left[None]["n_left"] == 1
    assert got["hot"]["left_size_joined"] == sum(r["a"] or 0 for r in real) and got["hot"]["right_size_joined"] == sum(r["b"] or 0 for r in real)


def test_heavy_keys_and_empty_table(spark):
    _, df = rows(spark)
    assert [r["law_id"] for r in skew.heavy_keys(df, "law_id", 0.05, df).collect()] == ["hot"]
    empty = df.limit(0)
    assert skew.heavy_keys(empty, "law_id", 0.05, df).count() == 0 and skew.key_states(empty, "law_id", "text", ["chunk_id"]).count() == 0


def test_plan_combines_before_the_shuffle(spark):
    _, df = rows(spark)
    plan = skew.key_states(df, "law_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_heavy_keys_run_the_join(spark):
    from lexweave import registry

    plan = registry.p4_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "normalized_artifacts" in plan or plan.count("Relation") == 2
    assert plan.count("Aggregate") == 2
