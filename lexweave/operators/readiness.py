"""Whether tables are fit for an index and answers fit to show: counts, coverages and checks over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text

# Words of headings that extraction tears in two.
TORN = (r"Đ\s+iều", r"Ch\s+ương", r"Kho\s+ản", r"Đi\s+ểm", r"M\s+ục", r"Ph\s+ần")


def vector_checks(vector: str, dim: int) -> dict[str, Column]:
    """Checks of a stored vector: there, of the right dimension, finite, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return {
        "VECTOR_MISSING": v.isNull() | (F.size(v) == 0),
        "VECTOR_DIMENSION": (F.size(v) > 0) & (F.size(v) != dim),
        "VECTOR_NOT_FINITE": (F.size(v) > 0) & ~finite,
        "VECTOR_ZERO": (F.size(v) > 0) & F.forall(v, lambda x: x == 0),
    }


def filter_counts(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """(filter, n, empty) of every filter, all counted in one pass; null is not true."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"f{k}") for k, c in enumerate(filters.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(f"f{k}").alias("n")) for k, name in enumerate(filters)])
    return one.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.n") == 0).alias("empty"))


def completeness(hits: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """(by, n_hits, completeness): the share of the fields that the hits of a group fill with more than white space."""
    there = sum((F.when(text.blank_to_null(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return hits.groupBy(by).agg(F.count("*").alias("n_hits"), F.round(F.sum(there) / (F.count("*") * len(fields)), 6).alias("completeness"))


def group_coverage(groups: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, n_groups, n_covered, coverage): a group is covered if any of its documents is selected. ``groups``:
    query_id, group_id, doc_id; ``selected``: query_id, doc_id. Joined by document; no set is gathered."""
    s = selected.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True))
    g = groups.where("group_id is not null").select("query_id", "group_id", "doc_id").distinct().join(s, ["query_id", "doc_id"], "left")
    one = g.groupBy("query_id", "group_id").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))
    out = one.groupBy("query_id").agg(F.count("*").alias("n_groups"), F.count_if("hit").alias("n_covered"))
    return out.withColumn("coverage", F.round(F.col("n_covered") / F.col("n_groups"), 6))


def duplicate_texts(df: DataFrame, key: str, content: str) -> DataFrame:
    """(code, text_key, n_rows, n_forms, first_key): texts that agree but for case and punctuation (SAME_TEXT), and those of
    different texts that agree when marks are left out too (SAME_WITHOUT_MARKS, for people to look at; nothing is merged)."""
    t = df.where(text.blank_to_null(content).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), text.duplicate_key(content).alias("same"), text.bare_key(content).alias("bare")).where("same <> ''")
    own = t.groupBy("bare", "same").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    same = own.where("n > 1").select(F.lit("SAME_TEXT").alias("code"), F.col("same").alias("text_key"), F.col("n").alias("n_rows"), F.lit(1).cast("bigint").alias("n_forms"), F.col("k").alias("first_key"))
    bare = own.groupBy("bare").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms"), F.min("k").alias("first_key")).where("n_forms > 1")
    return same.unionByName(bare.select(F.lit("SAME_WITHOUT_MARKS").alias("code"), F.col("bare").alias("text_key"), "n_rows", "n_forms", "first_key"))


def count_report(df: DataFrame, dimensions: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Rows and sums by all dimensions, by each leading part of them and in total, in one pass; a dimension that is summed
    over reads '*', a missing value 'unknown'."""
    d = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in dimensions], *[v.alias(k) for k, v in sums.items()])
    g = d.rollup(*dimensions).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums])
    return g.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in dimensions], "n_rows", *sums)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The non-null keys of both tables, once each."""
    return a.where(F.col(key).isNotNull()).select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def readiness(issues: DataFrame, blocking: Sequence[str], n_rows: int) -> DataFrame:
    """One row: status (blocked where a blocking code or no row at all, ready_with_warnings where any code, else ready),
    n_blocking and n_warnings. ``issues``: code, n."""
    hard = F.col("code").isin(*blocking)
    s = issues.agg(F.coalesce(F.sum(F.when(hard, F.col("n"))), F.lit(0)).alias("n_blocking"), F.coalesce(F.sum(F.when(~hard, F.col("n"))), F.lit(0)).alias("n_warnings"))
    status = F.when((F.col("n_blocking") > 0) | F.lit(n_rows == 0), "blocked").when(F.col("n_warnings") > 0, "ready_with_warnings").otherwise("ready")
    return s.select(status.alias("status"), "n_blocking", "n_warnings")


def torn_words(c: Column | str) -> Column:
    """How often a heading's word stands torn in two."""
    t = F.coalesce(text.col(c), F.lit(""))
    return sum((F.regexp_count(t, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){p}(?![\p{{L}}\p{{N}}_])")) for p in TORN), F.lit(0))


def claims(c: Column | str) -> Column:
    """The sentences of an answer: cut after closing punctuation and at line breaks, trimmed, without blank ones."""
    parts = F.split(F.coalesce(text.col(c), F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def phrases_in(c: Column | str, phrases: Sequence[str]) -> Column:
    """The phrases that a text holds, case ignored, in their order."""
    t = text.fold(F.coalesce(text.col(c), F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(t, text.fold(F.lit(p))), F.lit(p)) for p in phrases]))


def hints_met(hits: DataFrame, hints: DataFrame, content: str) -> DataFrame:
    """(query_id, n_hints, n_met, met): whether every hint of a query is held by the text of some hit, case ignored.
    ``hints``: query_id, hint; a query without hits meets none."""
    h = hints.where(text.blank_to_null("hint").isNotNull()).select("query_id", text.fold(text.collapse("hint")).alias("hint")).distinct()
    t = hits.where(F.col(content).isNotNull()).select("query_id", text.fold(text.collapse(content)).alias("t"))
    j = h.join(t, "query_id", "left").groupBy("query_id", "hint").agg(F.coalesce(F.max(F.contains("t", "hint")), F.lit(False)).alias("ok"))
    out = j.groupBy("query_id").agg(F.count("*").alias("n_hints"), F.count_if("ok").alias("n_met"))
    return out.withColumn("met", F.col("n_hints") == F.col("n_met"))
