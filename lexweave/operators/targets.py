"""Retrieved hits against expected provisions, at the depth of an article, a clause or a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depths from the coarsest down, with the columns that must agree.
DEPTHS = {"article": ("law_id", "article_number"), "clause": ("law_id", "article_number", "clause_number"), "point": ("law_id", "article_number", "clause_number", "point_label")}
FIELDS = DEPTHS["point"]


def _folded(c: Column) -> Column:
    return F.lower(F.trim(c))


def match_ranks(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, target_id, match_level, article_rank, clause_rank, point_rank, exact_rank, exact_depth) of every target.

    ``targets``: query_id, target_id, match_level and the four provision columns; ``hits``: query_id, rank and the same
    columns. Values compare trimmed and in small letters; null never matches, so a target without a clause has no clause
    rank. exact_rank is the first rank at the target's own depth, exact_depth that depth if there is one. An equality join
    on (query, law, article); targets without a hit keep their row."""
    t = targets.select("query_id", "target_id", "match_level", *[_folded(F.col(c)).alias(c) for c in FIELDS])
    h = hits.select("query_id", "rank", *[_folded(F.col(c)).alias(f"h_{c}" if c in FIELDS[2:] else c) for c in FIELDS])
    j = t.join(h, ["query_id", "law_id", "article_number"], "left")
    clause = F.col("clause_number") == F.col("h_clause_number")
    point = clause & (F.col("point_label") == F.col("h_point_label"))
    ranks = {"article": F.col("rank"), "clause": F.when(clause, F.col("rank")), "point": F.when(point, F.col("rank"))}
    g = j.groupBy("query_id", "target_id", "match_level").agg(*[F.min(r).alias(f"{d}_rank") for d, r in ranks.items()])
    exact = F.when(F.col("match_level") == "article", F.col("article_rank")).when(F.col("match_level") == "clause", F.col("clause_rank")).otherwise(F.col("point_rank"))
    g = g.withColumn("exact_rank", exact)
    return g.withColumn("exact_depth", F.when(F.col("exact_rank").isNotNull(), F.col("match_level")))


def best_by_level(ranks: DataFrame) -> DataFrame:
    """(query_id, n_targets, n_matched, best_article, best_clause, best_point, best_exact, exact_depth): the best exact rank
    among a query's targets of each level, the best of all and the level that it has (the coarser among equals)."""
    by = {d: F.min(F.when(F.col("match_level") == d, F.col("exact_rank"))).alias(f"best_{d}") for d in DEPTHS}
    depth = F.when(F.col("match_level") == "article", 0).when(F.col("match_level") == "clause", 1).otherwise(2)
    least = F.min(F.when(F.col("exact_rank").isNotNull(), F.struct("exact_rank", depth.alias("d"), "match_level")))
    g = ranks.groupBy("query_id").agg(F.count("*").alias("n_targets"), F.count("exact_rank").alias("n_matched"), *by.values(), least.alias("m"))
    return g.select("query_id", "n_targets", "n_matched", *[f"best_{d}" for d in DEPTHS], F.col("m.exact_rank").alias("best_exact"), F.col("m.match_level").alias("exact_depth"))


def target_chunks(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(target_id, chunk_id) of the chunks that a stored target names: law and article equal as they stand, clause and point
    too at their depths, where a missing one equals a missing one."""
    t = targets.select("target_id", "match_level", "law_id", "article_number", F.col("clause_number").alias("t_clause"), F.col("point_label").alias("t_point"))
    c = chunks.select("chunk_id", "law_id", "article_number", "clause_number", "point_label")
    clause = F.col("t_clause").eqNullSafe(F.col("clause_number"))
    deep = F.when(F.col("match_level") == "article", True).when(F.col("match_level") == "clause", clause).otherwise(clause & F.col("t_point").eqNullSafe(F.col("point_label")))
    return t.join(c, ["law_id", "article_number"]).where(deep).select("target_id", "chunk_id").distinct()


def group_chunks(groups: DataFrame, targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group_id, chunk_id) that satisfy a group: any chunk of any of its targets; the listed ids count only where a group
    has no target. ``groups``: group_id, chunk_ids; ``targets``: group_id and what :func:`target_chunks` takes."""
    of = targets.select("group_id", "target_id").distinct()
    through = target_chunks(targets, chunks).join(of, "target_id").select("group_id", "chunk_id")
    listed = groups.join(of.select("group_id").distinct(), "group_id", "left_anti").select("group_id", F.explode("chunk_ids").alias("chunk_id"))
    return through.unionByName(listed.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")).distinct()


def expected_targets(queries: DataFrame, targets: DataFrame, answered: Column) -> DataFrame:
    """(query_id, targets): ids of a query's targets in order; an empty list for one that is not to be answered (not
    ``answered``), null where nothing is known."""
    t = targets.groupBy("query_id").agg(F.sort_array(F.collect_set("target_id")).alias("t"))
    empty = F.array().cast("array<string>")
    return queries.join(t, "query_id", "left").select("query_id", F.when(~answered, empty).otherwise(F.col("t").cast("array<string>")).alias("targets"))
