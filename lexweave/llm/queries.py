"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import boilerplate, canonical, conversations, leakage, mixing, neardup, quality, splitting
from lexweave.operators.graph import connected_components
from lexweave.session import materialize, spread, table

TOKENIZER = os.environ.get("LEXWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _chunks(spark, d):
    return table(spark, d, "legal_chunks")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("n_pieces > 1").select(F.col("item_id").alias("chunk_id"), "field_name").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_chunks(spark, d), table(spark, d, "split_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    v = conversations.verdicts(table(spark, d, "conversation_messages"), table(spark, d, "conversations"))
    return v.where("fault is not null").select("conversation_id")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.rebuild(table(spark, d, "conversation_messages"), table(spark, d, "conversations"))
    return turns.select("conversation_id", "turn", "role", "content", F.unix_micros("created_at").alias("created_us"))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _chunks(spark, d)
    scores = canonical.train(c.select("text"))
    members, pairs = neardup.near_duplicates(c, scores, "chunk_id", "text", threshold=0.6, shingle=3, min_words=20, signature="sets")
    return materialize(members), materialize(pairs)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _near(spark, d)
    a = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("ia"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("ib"))
    between = pairs.join(a, "class_a").join(b, "class_b").where("ia <> ib").select(F.least("ia", "ib").alias("chunk_id_a"), F.greatest("ia", "ib").alias("chunk_id_b"))
    # Exact copies are tied to the first of them; they are not expanded into all pairs.
    copies = members.where("id <> class_id").select(F.col("class_id").alias("chunk_id_a"), F.col("id").alias("chunk_id_b"))
    return between.unionByName(copies).distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk: its class of equal texts, the group of near-duplicates, and its class's number of links."""
    members, pairs = _near(spark, d)
    comp = connected_components(pairs, "class_a", "class_b")
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = members.join(comp.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id", "left").join(ends, "class_id", "left")
    return out.select(F.col("id").alias("chunk_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _pages(spark, d):
    a = table(spark, d, "normalized_artifacts")
    return a, canonical.train(a.select("normalized_text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a, scores = _pages(spark, d)
    return boilerplate.page_lines(a, scores, kept=False).select("raw_artifact_path", "line_no").distinct()


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    a, scores = _pages(spark, d)
    return boilerplate.main_text(a, scores).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    c, a = _chunks(spark, d), table(spark, d, "normalized_artifacts")
    scores = canonical.train(c.select("text"), a.select("normalized_text"))
    one = canonical.nonstandard(c, "chunk_id", "text", scores).select(F.lit("legal_chunks").alias("table_name"), "record_key")
    two = canonical.nonstandard(a, "raw_artifact_path", "normalized_text", scores).select(F.lit("normalized_artifacts").alias("table_name"), "record_key")
    return one.unionByName(two)


def p7_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both tables, under the scores that p7_found has."""
    c, a = _chunks(spark, d), table(spark, d, "normalized_artifacts")
    scores = canonical.train(c.select("text"), a.select("normalized_text"))

    def formed(df, name, key, text):
        t = canonical.canonicalize(spread(df.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"))), "text", logp=scores)
        return t.select(F.lit(name).alias("table_name"), "record_key", F.xxhash64("canonical").alias("canonical_hash"), (F.col("text") != F.col("canonical")).alias("changed"))

    return formed(c, "legal_chunks", "chunk_id", "text").unionByName(formed(a, "normalized_artifacts", "raw_artifact_path", "normalized_text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark_queries")
    scores = canonical.train(docs.select("text"))
    return leakage.find_leaks(docs, items, scores)


def p8_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which field leaked, and in how many passages."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark_queries")
    return leakage.find_leak_fields(docs, items, canonical.train(docs.select("text")))


def _mixed(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_picked(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.fit_labels(docs, table(spark, d, "doc_labels"))
    return quality.classify(docs, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p3_found, p3_conversations, p5_found, p5_groups, p6_found, p6_main_text, p7_found, p7_canonical,
        p8_found, p8_fields, p9_found, p9_report, p9_picked, p10_found, p10_statistics,
    )
}

SQL = {
    "p1_found": """
        SELECT DISTINCT c.chunk_id, l.field_name FROM legal_chunks c JOIN split_limits l ON l.chunk_kind = c.chunk_kind
        WHERE (l.field_name = 'text' AND length(c.text) > l.max_chars) OR (l.field_name = 'parent_text' AND length(c.parent_text) > l.max_chars)""",
    "p3_found": r"""
        WITH one AS (SELECT DISTINCT ON (id) * FROM conversation_messages ORDER BY id, created_at),
        m AS (SELECT conversation_id, id, created_at, coalesce(lower(regexp_replace(role, '^\s+|\s+$', '', 'g')), '') AS r FROM one
              WHERE conversation_id IS NOT NULL AND content IS NOT NULL AND regexp_replace(content, '[ \t\r\n]', '', 'g') <> ''),
        k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS p,
                     count(*) OVER (PARTITION BY conversation_id) AS n FROM m WHERE r <> 'system'),
        good AS (SELECT conversation_id FROM k GROUP BY conversation_id
                 HAVING bool_and(r = CASE WHEN p % 2 = 0 THEN 'user' ELSE 'assistant' END) AND max(n) % 2 = 0),
        ids AS (SELECT id FROM conversations WHERE id IS NOT NULL UNION SELECT conversation_id FROM conversation_messages WHERE conversation_id IS NOT NULL)
        SELECT id AS conversation_id FROM ids
        WHERE id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL) OR id NOT IN (SELECT conversation_id FROM good)""",
    "p3_conversations": r"""
        WITH one AS (SELECT DISTINCT ON (id) * FROM conversation_messages ORDER BY id, created_at),
        m AS (SELECT conversation_id, id, created_at, content, coalesce(lower(regexp_replace(role, '^\s+|\s+$', '', 'g')), '') AS r FROM one
              WHERE conversation_id IS NOT NULL AND content IS NOT NULL AND regexp_replace(content, '[ \t\r\n]', '', 'g') <> ''),
        k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS p,
                     count(*) OVER (PARTITION BY conversation_id) AS n FROM m WHERE r <> 'system'),
        good AS (SELECT conversation_id FROM k GROUP BY conversation_id
                 HAVING bool_and(r = CASE WHEN p % 2 = 0 THEN 'user' ELSE 'assistant' END) AND max(n) % 2 = 0)
        SELECT conversation_id, p AS turn, r AS role, content, epoch_us(created_at) AS created_us FROM k
        WHERE conversation_id IN (SELECT conversation_id FROM good) AND conversation_id IN (SELECT id FROM conversations WHERE id IS NOT NULL)""",
    "p9_found": r"""
        WITH t AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS s, coalesce(length(text), 0) AS n FROM documents)
        SELECT m.source FROM mix_targets m
        WHERE m.max_repeats * coalesce((SELECT sum(n) FROM t WHERE t.s = m.source), 0) < m.target_share * (SELECT sum(n) FROM t)""",
}
