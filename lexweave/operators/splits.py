"""Splits of records that keep related ones together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.graph import connected_components
from lexweave.session import materialize

#: Ranges of the seeded hash that sizes are summed up by.
BUCKETS = 4096


def components_by_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, component): records that share a non-blank value of any field, directly or through others, are together."""
    pairs = F.array(*[F.when(F.trim(F.col(f).cast("string")) != "", F.concat(F.lit(f"{f}="), F.trim(F.col(f).cast("string")))) for f in fields])
    ids = F.concat(F.lit("#"), F.col(key).cast("string"))
    e = df.where(F.col(key).isNotNull()).select(ids.alias("src"), F.explode(F.concat(F.array(ids), F.filter(pairs, lambda x: x.isNotNull()))).alias("dst"))
    c = connected_components(e).where(F.startswith(F.col("node"), F.lit("#")))
    least = c.groupBy("component").agg(F.min("node").alias("least"))
    return c.join(least, "component").select(F.substring("node", 2, 1_000_000).alias("key"), F.substring("least", 2, 1_000_000).alias("component"))


def grouped_split(components: DataFrame, ratios: Mapping[str, float], seed: int = 13, forced: Mapping[str, str] | None = None) -> DataFrame:
    """(key, component, split): whole components, in order of a seeded hash, fill the splits up to their rounded shares;
    the last split takes the rest. ``forced``: component to split, assigned first.

    Sizes are summed up along the order in BUCKETS ranges of the hash; only the ranges' totals reach the driver."""
    names = list(ratios)
    if wrong := set((forced or {}).values()) - set(names):
        raise ValueError(f"no such split: {sorted(wrong)}")
    spark = components.sparkSession
    fixed = spark.createDataFrame(list((forced or {}).items()), "component string, _forced string")
    u = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(BUCKETS << 20))
    sizes = materialize(components.where("component is not null").groupBy("component").agg(F.count("*").alias("n")).join(fixed, "component", "left").withColumn("_u", u).withColumn("_bucket", F.shiftright("_u", 20)))
    totals = {r["_forced"]: r["n"] for r in sizes.groupBy("_forced").agg(F.sum("n").alias("n")).collect()}
    n = sum(totals.values())
    rest = sizes.where("_forced is null")
    offsets, at = [], 0
    for b, k in sorted((r["_bucket"], r["n"]) for r in rest.groupBy("_bucket").agg(F.sum("n").alias("n")).collect()):
        offsets.append((b, at))
        at += k
    w = Window.partitionBy("_bucket").orderBy("_u", "component").rowsBetween(Window.unboundedPreceding, -1)
    starts = spark.createDataFrame(offsets, "_bucket bigint, _start bigint")
    placed = rest.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(starts), "_bucket")
    placed = materialize(placed.select("component", (F.col("_before") + F.col("_start")).alias("_before")))
    # A split ends at the first component before which its share is full; the next one begins there.
    split, begin = F.lit(names[-1]), 0
    ends = []
    for name in names[:-1]:
        full = begin + max(0, round(n * ratios[name]) - totals.get(name, 0))
        ends.append((name, full))
        first = placed.where(F.col("_before") >= full).agg(F.min("_before")).first()[0]
        if first is None:
            break
        begin = first
    for name, full in reversed(ends):
        split = F.when(F.col("_before") < full, name).otherwise(split)
    done = placed.select("component", split.alias("split")).unionByName(sizes.where("_forced is not null").select("component", F.col("_forced").alias("split")))
    return components.join(done, "component").select("key", "component", "split")
