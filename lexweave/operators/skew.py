"""Problem 4: per-key results where a few keys hold most records.

Method: eager aggregation through joins. Both inputs are aggregated by the join key first; the compact states are joined,
counts multiplied and sums scaled by the other side's count; the result is rolled up. Distinct counts take a first
aggregation by key and value, which spreads a hot key over its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, size: str | None = None, distinct: Sequence[str] = ()) -> DataFrame:
    """One row per key (null is a key of its own): n_rows, size_sum (characters of the text column ``size``; null text
    counts 0) and distinct_<column> (nulls don't count) for each column of ``distinct``.

    A hot key is never one task's work: rows and sizes are combined before the shuffle, and the values of a distinct
    count are aggregated by (key, value), where a key's rows are spread by value.
    """
    length = F.coalesce(F.length(size), F.lit(0)) if size else F.lit(0)
    k = F.col(key).alias("k")
    if distinct:
        first, rest = distinct[0], distinct[1:]
        one = df.select(k, F.col(first).alias("v"), length.alias("s")).groupBy("k", "v").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
        out = one.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("s").cast("bigint").alias("size_sum"), F.count("v").alias(f"distinct_{first}"))
        for c in rest:
            d = df.select(k, F.col(c).alias("v")).where("v is not null").distinct().groupBy("k").agg(F.count("*").alias(f"distinct_{c}"))
            both = out.alias("o").join(d.alias("d"), F.expr("o.k <=> d.k"), "left")
            out = both.select("o.*", F.coalesce(f"d.distinct_{c}", F.lit(0)).alias(f"distinct_{c}"))
    else:
        out = df.select(k, length.alias("s")).groupBy("k").agg(F.count("*").alias("n_rows"), F.sum("s").cast("bigint").alias("size_sum"))
    return out.withColumnRenamed("k", key)


def joined_states(left: DataFrame, right: DataFrame, key: str, left_size: str | None = None, right_size: str | None = None, how: str = "inner") -> DataFrame:
    """What a join on ``key`` would count, without joining rows: n_joined = n_left * n_right, and the sums of both sides'
    sizes over the joined rows. ``how`` is inner or left; a left key without match joins as one row of nulls. Null keys
    match nothing: an inner join leaves them out."""
    keep = left if how == "left" else left.where(F.col(key).isNotNull())
    a = key_states(keep, key, left_size).select(key, F.col("n_rows").alias("n_left"), F.col("size_sum").alias("s_left"))
    b = key_states(right.where(F.col(key).isNotNull()), key, right_size).select(key, F.col("n_rows").alias("n_right"), F.col("size_sum").alias("s_right"))
    j = a.join(b, key, how).withColumn("n_right", F.coalesce("n_right", F.lit(0))).withColumn("s_right", F.coalesce("s_right", F.lit(0)))
    times = F.greatest("n_right", F.lit(1))
    return j.select(key, "n_left", "n_right", (F.col("n_left") * times).alias("n_joined"), (F.col("s_left") * times).alias("left_size_joined"), (F.col("s_right") * F.col("n_left")).alias("right_size_joined"))


def heavy_keys(df: DataFrame, key: str, share: float, other: DataFrame) -> DataFrame:
    """(key, n_rows, share, n_other) of the non-null keys with more than ``share`` of all rows, null keys' rows included;
    n_other is the key's number of rows in ``other``. Both inputs are aggregated by key and the states are joined; the test
    is made on the rows that the join would have: a key is heavy if they are more than ``share`` of all rows, each counted
    once for every match of the key. The number of all rows is read from the files' footers."""
    total = df.count()
    matches = F.greatest("n_right", F.lit(1))
    s = joined_states(df, other, key, how="left").where(F.col(key).isNotNull() & (F.col("n_joined") > F.lit(share) * F.lit(total) * matches))
    return s.select(key, F.col("n_left").alias("n_rows"), F.round(F.col("n_left") / F.lit(max(1, total)), 6).alias("share"), F.col("n_right").alias("n_other"))
