"""Where evidence is lost between wanted, retrieved and selected documents, and which groups of cases are weakest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What became of a case's required evidence; the last two count besides.
OUTCOMES = ("no_required_evidence_defined", "required_evidence_not_retrieved", "required_evidence_retrieved_and_selected", "required_evidence_retrieved_but_not_selected")
EMPTY = "selected_evidence_empty"


def overlaps(required: DataFrame, retrieved: DataFrame, selected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_required, n_retrieved, n_selected, n_required_retrieved, n_required_selected, n_missed, outcome) of every
    query; the other frames hold (query_id, doc_id). n_missed are required and retrieved but not selected. Flags are
    aggregated by (query, document), so no set is gathered in a cell."""
    tag = lambda df, name: df.select("query_id", "doc_id", *[F.lit(n == name).alias(n) for n in ("w", "r", "s")])
    flags = tag(required, "w").unionByName(tag(retrieved, "r")).unionByName(tag(selected, "s"))
    one = flags.where("doc_id is not null").groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in "wrs"])
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    g = one.groupBy("query_id").agg(n("w", "n_required"), n("r", "n_retrieved"), n("s", "n_selected"), n("w and r", "n_required_retrieved"), n("w and s", "n_required_selected"), n("w and r and not s", "n_missed"))
    out = queries.select("query_id").distinct().join(g, "query_id", "left").fillna(0, [c for c in g.columns if c != "query_id"])
    outcome = F.when(F.col("n_required") == 0, OUTCOMES[0]).when(F.col("n_required_retrieved") == 0, OUTCOMES[1]).when(F.col("n_required_selected") > 0, OUTCOMES[2]).otherwise(OUTCOMES[3])
    return out.withColumn("outcome", outcome)


def outcome_counts(cases: DataFrame) -> DataFrame:
    """(outcome, n) over a fixed domain, zeros included; cases without any selection count once more as such."""
    domain = cases.sparkSession.createDataFrame([(x,) for x in (*OUTCOMES, EMPTY)], "outcome string")
    got = cases.select(F.explode(F.array_compact(F.array("outcome", F.when(F.col("n_selected") == 0, EMPTY)))).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))
    return domain.join(got, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def mode(df: DataFrame, column: str, without: Sequence[str] = ()) -> DataFrame:
    """(value, n): the most frequent non-null value, the greatest name among equals; no row if there is none."""
    rows = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*without)) if without else df.where(F.col(column).isNotNull())
    g = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return g.agg(F.max(F.struct("n", "value")).alias("m")).where("m is not null").select("m.value", "m.n")


def group_summary(cases: DataFrame, dimensions: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    """(dimension, value, n_cases, n_missed_cases, missed_rate, n_empty, n_not_retrieved) in one pass; null and empty are
    'unknown', a case counts once for each element of a ``multi`` dimension."""
    name = lambda c: F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", "unknown").otherwise(c.cast("string"))
    one = [F.array(F.struct(F.lit(d).alias("dimension"), name(F.col(d)).alias("value"))) for d in dimensions]
    tag = lambda d: lambda x: F.struct(F.lit(d).alias("dimension"), name(x).alias("value"))
    many = [F.transform(F.when(F.size(d) > 0, F.array_distinct(d)).otherwise(F.array(F.lit("unknown"))), tag(d)) for d in multi]
    missed = F.count_if(F.col("outcome") == OUTCOMES[3])
    return (
        cases.withColumn("x", F.explode(F.concat(*one, *many)))
        .groupBy("x.dimension", "x.value")
        .agg(F.count("*").alias("n_cases"), missed.alias("n_missed_cases"), F.round(missed / F.count("*"), 6).alias("missed_rate"), F.count_if(F.col("n_selected") == 0).alias("n_empty"), F.count_if(F.col("outcome") == OUTCOMES[1]).alias("n_not_retrieved"))
    )


def top_groups(rows: DataFrame, by: str, order: Sequence[Column], k: int = 5) -> DataFrame:
    """The first k rows of every value of ``by`` in the given order, with their place: weakest or most failing groups."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def deltas(current: DataFrame, baseline: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """keys and <measure>_delta: current less baseline, for the keys of ``current`` that the baseline has too."""
    b = baseline.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures])
    return current.join(b, list(keys)).select(*keys, *[F.round(F.col(m) - F.col(f"b_{m}"), 6).alias(f"{m}_delta") for m in measures])
