import pytest
from pyspark.sql import functions as F

from lexweave.operators import splits


def test_one_rule_above_100000_components(spark):
    n = 100_100
    c = spark.range(n + 50_000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("c"), F.least("id", F.lit(n))).alias("component"))
    forced = {f"c{i}": "dev" for i in range(40)}
    s = splits.grouped_split(c, {"dev": 0.5, "test": 0.2, "held": 0.3}, forced=forced)
    s = s.groupBy("component").agg(F.count("*").alias("n"), F.min("split").alias("split"), F.count_distinct("split").alias("k")).collect()
    assert len(s) == n + 1 and all(r["k"] == 1 for r in s)
    got = {r["component"]: r["split"] for r in s}
    assert all(got[x] == "dev" for x in forced)
    big, total = got[f"c{n}"], n + 50_000
    for name, share in (("dev", 0.5), ("test", 0.2)):
        held = sum(r["n"] for r in s if r["split"] == name)
        assert held == round(total * share) or (name == big and held < round(total * share) + 50_000)


def test_greedy_fill_in_the_same_order(spark):
    c = spark.range(60).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("c"), F.floor(F.sqrt("id"))).alias("component"))
    ratios = {"dev": 0.4, "test": 0.3, "held": 0.3}
    got = {r["component"]: r["split"] for r in splits.grouped_split(c, ratios, 7, {"c3": "test"}).collect()}
    sizes = c.groupBy("component").count().withColumn("u", F.pmod(F.xxhash64(F.lit(7), "component"), F.lit(splits.BUCKETS << 20))).orderBy("u", "component").collect()
    have = dict.fromkeys(ratios, 0)
    have["test"] = next(r["count"] for r in sizes if r["component"] == "c3")
    want = {"c3": "test"}
    for r in sizes:
        if r["component"] != "c3":
            name = next((x for x in ("dev", "test") if have[x] < round(60 * ratios[x])), "held")
            want[r["component"]] = name
            have[name] += r["count"]
    assert got == want
    with pytest.raises(ValueError):
        splits.grouped_split(c, ratios, forced={"c1": "none"})
