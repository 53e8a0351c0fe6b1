"""Fusion of two rankings: weighted reciprocal rank, source quotas, metadata diversity; and mixing with a second score."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def best_per_source(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, score) with the best rank of every document; null documents are left out."""
    return hits.where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"))).alias("m")).select("query_id", "doc_id", "m.rank", (-F.col("m.s")).alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """(query_id, doc_id, dense_rank, sparse_rank, fused): weights by k + rank, summed; a source that lacks a document adds nothing."""
    if k <= 0 or dense_weight < 0 or sparse_weight < 0 or dense_weight + sparse_weight == 0:
        raise ValueError("k is positive, weights aren't negative, and not both are 0")
    d = best_per_source(dense).select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    s = best_per_source(sparse).select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    part = lambda c, w: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    return both.withColumn("fused", F.round(part("dense_rank", dense_weight) + part("sparse_rank", sparse_weight), 9))


def fused_order() -> Sequence[Column]:
    return (F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("doc_id"))


def top_fused(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates of every query by fused score, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*fused_order())
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_with_quotas(candidates: DataFrame, k: int, fused_quota: int, sparse_quota: int, dense_quota: int) -> DataFrame:
    """First the best ``fused_quota``, then the next ``sparse_quota`` by sparse rank that are new, then ``dense_quota``
    new ones by dense rank, then the rest by fused score: k per query, ranked in the order of selection."""
    w = lambda *o: Window.partitionBy("query_id").orderBy(*o)
    c = candidates.withColumn("by_fused", F.row_number().over(w(*fused_order())))
    c = c.withColumn("phase", F.when(F.col("by_fused") <= fused_quota, 0))
    for phase, source, quota in ((1, "sparse_rank", sparse_quota), (2, "dense_rank", dense_quota)):
        free = F.col("phase").isNull() & F.col(source).isNotNull()
        c = c.withColumn("place", F.row_number().over(w(F.when(free, 0).otherwise(1), F.asc_nulls_last(source), "doc_id")))
        c = c.withColumn("phase", F.coalesce("phase", F.when(free & (F.col("place") <= quota), phase)))
    inside = F.when(F.col("phase") == 1, F.col("sparse_rank")).when(F.col("phase") == 2, F.col("dense_rank")).otherwise(F.col("by_fused"))
    c = c.withColumn("phase", F.coalesce("phase", F.lit(3))).withColumn("inside", inside)
    return c.withColumn("rank", F.row_number().over(w("phase", "inside", "doc_id"))).where(F.col("rank") <= k).drop("place", "inside", "by_fused")


def _could_be_chosen(candidates: DataFrame, k: int, group: Sequence[str], detail: Sequence[str]) -> DataFrame:
    """The candidates that a greedy choice of k can reach, so that a query's list in a task is bounded without losing any.

    Of equal group and detail only the k first can be chosen, as their penalties are always equal. And while fewer than k
    are chosen, one of the k best leaders of distinct groups is free of penalty, so nothing below the k-th leader is."""
    same = Window.partitionBy("query_id", *group, *detail).orderBy(*fused_order())
    c = candidates.withColumn("_place", F.row_number().over(same)).where(F.col("_place") <= k).drop("_place")
    free = F.forall(F.array(*[F.col(g).cast("string") for g in group]), lambda x: x.isNull())
    of = F.when(free, F.struct(F.lit(True).alias("f"), F.col("doc_id").cast("string").alias("d"))).otherwise(F.struct(F.lit(False).alias("f"), F.to_json(F.array(*[F.col(g).cast("string") for g in group]), {"ignoreNullFields": "false"}).alias("d")))
    leaders = c.groupBy("query_id", of.alias("_g")).agg(F.max("fused").alias("lead"))
    best = leaders.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lead"))))
    floor = best.where(F.col("_n") == k).select("query_id", F.col("lead").alias("_floor"))
    return c.join(floor, "query_id", "left").where(F.col("_floor").isNull() | (F.col("fused") >= F.col("_floor"))).drop("_floor")


def select_diverse(candidates: DataFrame, k: int, group: str | Sequence[str], penalty: float = 0.01, detail: Sequence[str] = ()) -> DataFrame:
    """Greedy choice of k: again and again the candidate with the best score less ``penalty`` for each chosen one of its
    group (the values of one or more columns; all null is no group). With ``detail`` columns, half a penalty is given back
    to a candidate whose (group, detail) none of the chosen has, if any of its detail is known. Ties go to the better dense
    rank, then the better sparse rank (a missing one last), then the smaller id. All candidates compete."""
    if k <= 0 or penalty < 0:
        raise ValueError("k is positive and the penalty is not negative")
    groups = [group] if isinstance(group, str) else list(group)
    reach = _could_be_chosen(candidates, k, groups, list(detail))

    def greedy(df: pd.DataFrame) -> pd.DataFrame:
        val = lambda r, cs: tuple(None if pd.isna(r[c]) else r[c] for c in cs)
        order = lambda x: float("inf") if pd.isna(x) else x
        rows = [(r["fused"], order(r["dense_rank"]), order(r["sparse_rank"]), r["doc_id"], val(r, groups), val(r, detail)) for r in df.to_dict("records")]
        chosen: list[tuple] = []
        seen: dict[tuple, int] = {}
        details: set[tuple] = set()
        while rows and len(chosen) < k:

            def cost(r: tuple) -> tuple:
                n = seen.get(r[4], 0) if any(x is not None for x in r[4]) else 0
                off = penalty * n
                if n and any(x is not None for x in r[5]) and (r[4], r[5]) not in details:
                    off = max(0.0, off - penalty / 2)
                return (-(r[0] - off), *r[1:4])

            r = min(rows, key=cost)
            rows.remove(r)
            seen[r[4]] = seen.get(r[4], 0) + 1
            details.add((r[4], r[5]))
            chosen.append(r)
        q = df["query_id"].iloc[0]
        return pd.DataFrame([(q, r[3], n, r[0]) for n, r in enumerate(chosen, 1)], columns=["query_id", "doc_id", "rank", "fused"])

    t = dict(candidates.dtypes)
    return reach.groupBy("query_id").applyInPandas(greedy, f"query_id {t['query_id']}, doc_id {t['doc_id']}, rank int, fused double")


def min_max(c: str, by: str = "query_id") -> Column:
    """A score within its query scaled to 0 .. 1; non-finite counts as 0, equal scores all give 1."""
    v = F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    w = Window.partitionBy(by)
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(hi - lo <= 1e-12, 1.0).otherwise((v - lo) / (hi - lo))


def rerank(candidates: DataFrame, scores: DataFrame, k: int, weight: float = 0.7, base_weight: float = 0.3) -> DataFrame:
    """Candidates mixed with a second score (query_id, doc_id, score): both min-max scaled in their query, weighted, and
    ranked by (mix, second score, base score, doc_id). A candidate without a second score counts as 0 there."""
    s = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("second"))
    c = candidates.select("query_id", "doc_id", "fused").join(s, ["query_id", "doc_id"], "left").withColumn("second", F.coalesce("second", F.lit(0.0)))
    c = c.withColumn("mixed", F.round(weight * min_max("second") + base_weight * min_max("fused"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("mixed"), F.desc("second"), F.desc("fused"), "doc_id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "mixed")


def rerank_with_quotas(candidates: DataFrame, scores: DataFrame, k: int, sparse_quota: int, dense_quota: int, weight: float = 0.7, base_weight: float = 0.3) -> DataFrame:
    """k candidates mixed with a second score as in :func:`rerank`, of which at least ``sparse_quota`` have a sparse rank and
    ``dense_quota`` a dense one, as far as there are such and room: first the best with a sparse rank, then as many with a
    dense rank as those lack, then the best of the rest. The chosen are ranked by (mix, second score, base score, dense
    rank, sparse rank, doc_id)."""
    s = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("second"))
    c = candidates.select("query_id", "doc_id", "dense_rank", "sparse_rank", "fused").join(s, ["query_id", "doc_id"], "left").withColumn("second", F.coalesce("second", F.lit(0.0)))
    c = c.withColumn("mixed", F.round(weight * min_max("second") + base_weight * min_max("fused"), 6))
    by = (F.desc("mixed"), F.desc("second"), F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "doc_id")
    q = lambda *o: Window.partitionBy("query_id").orderBy(*o)
    has = {x: F.col(f"{x}_rank").isNotNull() for x in ("sparse", "dense")}
    c = c.withColumn("place", F.row_number().over(q(F.when(has["sparse"], 0).otherwise(1), *by)))
    c = c.withColumn("phase", F.when(has["sparse"] & (F.col("place") <= min(sparse_quota, k)), 0))
    held = F.count_if(F.col("phase").isNotNull()).over(Window.partitionBy("query_id"))
    held_dense = F.count_if(F.col("phase").isNotNull() & has["dense"]).over(Window.partitionBy("query_id"))
    c = c.withColumn("want", F.least(F.lit(dense_quota) - held_dense, F.lit(k) - held))
    free = F.col("phase").isNull() & has["dense"]
    c = c.withColumn("place", F.row_number().over(q(F.when(free, 0).otherwise(1), *by)))
    c = c.withColumn("phase", F.coalesce("phase", F.when(free & (F.col("place") <= F.col("want")), 1), F.lit(2)))
    c = c.withColumn("place", F.row_number().over(q(F.when(F.col("phase") < 2, 0).otherwise(1), *by))).where(F.col("place") <= k)
    return c.withColumn("rank", F.row_number().over(q(*by))).select("query_id", "doc_id", "rank", "mixed", (F.col("phase") < 2).alias("by_quota"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first ranking, and the second one for the queries that the first has no row of."""
    return first.select("query_id", "doc_id", "rank", F.lit(False).alias("fallback")).unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "rank", F.lit(True).alias("fallback")))
