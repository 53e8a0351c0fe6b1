"""Retrieval quality by query, in total and by breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def fraction(a: Column, b: Column) -> Column:
    """a by b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def per_query(ranking: DataFrame, judgments: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """One row per judged query. ``ranking``: query_id, doc_id, rank; ``judgments``: query_id, doc_id, gain (0 .. 3; 2 and
    3 are direct). recall_at_k says whether a direct document is among the first k, rr is the reciprocal of the first
    direct rank up to 10, ndcg compares with the best order of all judged documents. Queries without hits give 0."""
    j = judgments.groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    disc = lambda r: F.lit(1.0) / F.log2(r + 1)
    hits = ranking.join(j, ["query_id", "doc_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    got = hits.groupBy("query_id").agg(F.min(F.when(F.col("gain") >= 2, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, F.col("gain") * disc(F.col("rank")))).alias("dcg"), F.count_if((F.col("gain") >= 2) & (F.col("rank") <= 10)).alias("n_found"))
    # The ideal needs the ten largest gains only; gains are few values, so their counts give it without sorting documents.
    n = j.groupBy("query_id").agg(*[F.count_if(F.col("gain") == g).alias(f"n{g}") for g in (1, 2, 3)], F.count_if(F.col("gain") >= 2).alias("n_direct"))
    upto = {3: F.col("n3"), 2: F.col("n3") + F.col("n2"), 1: F.col("n3") + F.col("n2") + F.col("n1")}
    place = lambda p: F.when(upto[3] >= p, 3).when(upto[2] >= p, 2).when(upto[1] >= p, 1).otherwise(0) * disc(F.lit(p))
    ideal = sum((place(p) for p in range(2, 11)), place(1))
    out = n.withColumn("ideal", ideal).join(got, "query_id", "left")
    return out.select(
        "query_id", "n_direct", F.coalesce("n_found", F.lit(0)).alias("n_found"), *[F.coalesce(F.col("first") <= k, F.lit(False)).cast("int").alias(f"recall_at_{k}") for k in cutoffs],
        F.round(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0), 6).alias("rr"), F.round(fraction(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")), 6).alias("ndcg"),
    )


def _means(cutoffs: Sequence[int]) -> list[Column]:
    rnd = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return [F.count("*").alias("n_queries"), *[rnd(F.avg(f"recall_at_{k}")).alias(f"recall_at_{k}") for k in cutoffs], rnd(F.avg("rr")).alias("mrr"), rnd(F.avg("ndcg")).alias("ndcg"), F.round(fraction(F.sum("n_found"), F.sum("n_direct")), 6).alias("coverage")]


def aggregate(cases: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Means over all queries; coverage is found by wanted documents, both summed (micro)."""
    return cases.agg(*_means(cutoffs))


def breakdowns(cases: DataFrame, dimensions: Sequence[str], multi: Sequence[str] = (), cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """The means by each value of each dimension, in one pass: rows (dimension, value, ...). A query counts once for each
    element of a ``multi`` dimension; null and empty count as 'unknown'."""
    tag = lambda d: lambda x: F.struct(F.lit(d).alias("dimension"), F.coalesce(x, F.lit("unknown")).alias("value"))
    one = [F.array(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value"))) for d in dimensions]
    many = [F.transform(F.when(F.size(d) > 0, F.array_distinct(d)).otherwise(F.array(F.lit("unknown"))), tag(d)) for d in multi]
    rows = cases.withColumn("x", F.explode(F.concat(*one, *many))).select("*", "x.dimension", "x.value")
    return rows.groupBy("dimension", "value").agg(*_means(cutoffs))
