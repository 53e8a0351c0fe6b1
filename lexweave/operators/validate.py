"""Validation of chunk tables, length summaries, count reconciliation, set and reference checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text


def issues(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(key, code): one row for each check of a row that is true. One pass, whatever the number of checks."""
    codes = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("key"), F.explode(codes).alias("code"))


def chunk_checks() -> dict[str, Column]:
    """Checks of a chunk row: fields that must be there, hashes, offsets, citation and kind."""
    miss = lambda c: text.blank_to_null(c).isNull()
    level = F.col("level")
    said = lambda lab, v: F.col("citation").contains(F.concat(F.lit(lab + " "), F.col(v)))
    return {
        "CHUNK_ID_MISSING": miss("chunk_id"),
        "LAW_ID_MISSING": miss("law_id"),
        "TEXT_MISSING": miss("text"),
        "KIND_MISSING": miss("chunk_kind"),
        "LAW_NAME_MISSING": miss("law_name"),
        "SOURCE_URL_MISSING": miss("source_url"),
        "LEVEL_UNKNOWN": F.coalesce(~level.isin("article", "clause", "point"), F.lit(True)),
        "TEXT_HASH_WRONG": F.sha2("text", 256) != F.col("text_hash"),
        "PARENT_HASH_WRONG": F.sha2("parent_text", 256) != F.col("parent_text_hash"),
        "OFFSETS_REVERSED": F.col("start_offset") > F.col("end_offset"),
        "OUTSIDE_ARTICLE": (F.col("start_offset") < F.col("article_start_offset")) | (F.col("end_offset") > F.col("article_end_offset")),
        "ARTICLE_NOT_CITED": ~said("Điều", "article_number"),
        "CLAUSE_NOT_CITED": level.isin("clause", "point") & ~said("Khoản", "clause_number"),
        "POINT_NOT_CITED": (level == "point") & ~said("Điểm", "point_label"),
        "NOT_IN_PARENT": ~F.contains(F.col("parent_text"), F.col("text")),
    }


def duplicates(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, n_rows, n_later): keys with several rows; null is no key."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumn("n_later", F.col("n_rows") - 1)


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the latest by ``by``. An aggregation, not a sort of the key's rows; null keys are left out."""
    rest = [c for c in df.columns if c not in (key, by)]
    m = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(by, *rest), F.struct(F.col(by), F.xxhash64(*[F.col(c) for c in rest if not dict(df.dtypes)[c].startswith(("map", "array", "struct"))]))).alias("r"))
    return m.select(key, "r.*")


def length_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, min, max, mean (2 decimals), median and the values at p90, p95 and p99 of the text's lengths. A percentile is
    the element at round((n - 1) q), halves to even, so it is taken from the counts of distinct lengths: bounded, exact
    and without gathering all lengths. Null text is left out."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.length(column).alias("len")).agg(F.count("*").alias("k"))
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(q)), F.col("len")))
    low, high = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("len"))), F.min(F.when(F.col("upto") > F.ceil((F.col("n") - 1) / 2), F.col("len")))
    return r.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.round(F.sum(F.col("len") * F.col("k")) / F.max("n"), 2).alias("mean_len"), ((low + high) / 2).alias("median_len"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def length_buckets(df: DataFrame, column: str, bounds: Sequence[int] = (200, 500, 1000, 2000)) -> DataFrame:
    """(bucket, n): lengths by half-open ranges; every bucket has a row."""
    edges = [0, *bounds]
    name = lambda i: f"{edges[i]}-{edges[i + 1]}" if i + 1 < len(edges) else f"{edges[i]}+"
    n = F.length(column)
    conds = [(n >= edges[i]) & (n < edges[i + 1] if i + 1 < len(edges) else F.lit(True)) for i in range(len(edges))]
    one = df.agg(*[F.count_if(c).alias(name(i)) for i, c in enumerate(conds)])
    return one.unpivot([], [F.col(f"`{name(i)}`") for i in range(len(edges))], "bucket", "n")


def reconcile(observed: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """(key, observed, reported, difference) of keys whose numbers of rows differ; null is a key."""
    a = observed.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("observed"))
    b = reported.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("reported")).withColumnRenamed("key", "k2")
    j = a.join(b, F.expr("key <=> k2"), "full_outer")
    o, r = F.coalesce("observed", F.lit(0)), F.coalesce("reported", F.lit(0))
    return j.select(F.coalesce("key", "k2").alias("key"), o.alias("observed"), r.alias("reported"), (o - r).alias("difference")).where("difference <> 0")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct non-null values of the child's key that no parent row has."""
    return child.select(F.col(child_key).alias("key")).where("key is not null").distinct().join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): values that only one side has."""
    a, b = left.select(F.col(key).alias("key")).where("key is not null").distinct(), right.select(F.col(key).alias("key")).where("key is not null").distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "key", "left_anti").withColumn("side", F.lit("right")))


def contamination(df: DataFrame, key: str, fields: Sequence[str], phrases: Sequence[str]) -> DataFrame:
    """(key, field, phrase): phrases that occur in a field, both with white space collapsed and case folded."""
    hit = [F.when(F.contains(text.fold(text.collapse(f)), F.lit(" ".join(p.lower().split()))), F.struct(F.lit(f).alias("field"), F.lit(p).alias("phrase"))) for f in fields for p in phrases]
    return df.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("x")).select("key", "x.*")


def group_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, n_splits): values of ``group`` that stand in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_value")).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def traceability(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, code): chunks whose source node or parent article no node row has, or whose level, text or offsets differ from
    the node's. Of repeated nodes the first by text counts; a chunk without a source id is NODE_ID_MISSING."""
    n = nodes.where("node_id is not null").groupBy(F.trim("node_id").alias("source_node_id")).agg(F.min(F.struct(F.lower("level").alias("n_level"), F.col("text").alias("n_text"), F.col("start_offset").alias("n_start"), F.col("end_offset").alias("n_end"))).alias("n"))
    arts = n.select(F.col("source_node_id").alias("parent_article_node_id"), F.lit(True).alias("has_article"))
    c = chunks.select(F.col("chunk_id").alias("key"), "source_node_id", "parent_article_node_id", "level", "text", "start_offset", "end_offset").distinct()
    j = c.join(n, "source_node_id", "left").join(arts, "parent_article_node_id", "left")
    there = F.col("n").isNotNull()
    return issues(j, "key", {
        "NODE_ID_MISSING": F.col("source_node_id").isNull(),
        "NODE_UNKNOWN": F.col("source_node_id").isNotNull() & ~there,
        "ARTICLE_UNKNOWN": F.col("parent_article_node_id").isNotNull() & F.col("has_article").isNull(),
        "LEVEL_DIFFERS": there & (F.col("level") != F.col("n.n_level")),
        "TEXT_DIFFERS": there & (F.col("text") != F.col("n.n_text")),
        "OFFSETS_DIFFER": there & ((F.col("start_offset") != F.col("n.n_start")) | (F.col("end_offset") != F.col("n.n_end"))),
    })


def reference_issues(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", children: str = "children") -> DataFrame:
    """(parent_id, child_id, code): links that only one side names: CHILD_NOT_LISTED (the child names a parent whose list
    lacks it), PARENT_NOT_NAMED (a list names a child that names another parent or none)."""
    up = nodes.select(F.trim(parent).alias("p"), F.trim(node).alias("c")).where("p <> '' and c <> ''").distinct()
    down = nodes.select(F.trim(node).alias("p"), F.explode(children).alias("c")).select("p", F.trim("c").alias("c")).where("p <> '' and c <> ''").distinct()
    lists = nodes.where(F.col(children).isNotNull()).select(F.trim(node).alias("p")).distinct()
    a = up.join(down, ["p", "c"], "left_anti").join(lists, "p", "left_semi").withColumn("code", F.lit("CHILD_NOT_LISTED"))
    b = down.join(up, ["p", "c"], "left_anti").withColumn("code", F.lit("PARENT_NOT_NAMED"))
    return a.unionByName(b).select(F.col("p").alias("parent_id"), F.col("c").alias("child_id"), "code")


def stratification(df: DataFrame, split: str, fields: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    """(field, value, split, n): rows by each field's value and split, in one pass; array fields count once per element."""
    tag = lambda f: lambda x: F.struct(F.lit(f).alias("field"), F.coalesce(x, F.lit("unknown")).alias("value"))
    one = [F.array(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value"))) for f in fields]
    many = [F.transform(F.array_distinct(F.coalesce(F.col(f), F.array().cast("array<string>"))), tag(f)) for f in multi]
    r = df.select(F.col(split).alias("split"), F.explode(F.concat(*one, *many)).alias("x")).select("split", "x.*")
    return r.groupBy("field", "value", "split").agg(F.count("*").alias("n"))


def missing_json_keys(df: DataFrame, column: str, required: Sequence[str]) -> Column:
    """Required keys that a JSON object text lacks; text that is no object lacks all."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")))


def known_texts(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose text, but for punctuation, white space and case, is one of the known texts."""
    k = known.select(text.duplicate_key(known_column).alias("_key")).where("_key <> ''").distinct()
    return df.withColumn("_key", text.duplicate_key(column)).join(k, "_key", "left_semi").drop("_key")
