"""Ranked hits to prompt evidence: packets, deduplication, caps, rendering, and the check of cited ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text


def packets(hits: DataFrame, chunks: DataFrame, most: int = 2000, most_parent: int = 4000, cap: int = 10) -> DataFrame:
    """Hits (query_id, doc_id, rank, score) with their chunk's text, bounded; of equal texts and of repeated chunks in a
    query the best ranked stays, a parent text stands with the first of its packets only, and ``cap`` packets stay.
    ``chunks``: chunk_id, law_id, article_number, citation, text, parent_text; hits without a chunk text are left out."""
    j = hits.join(chunks.withColumnRenamed("chunk_id", "doc_id"), "doc_id").where(text.blank_to_null("text").isNotNull())
    w = lambda *k: Window.partitionBy("query_id", *k).orderBy("rank", "doc_id")
    j = j.withColumn("key", F.xxhash64(text.duplicate_key("text")))
    j = j.withColumn("nth", F.row_number().over(w("key"))).where("nth = 1")
    j = j.withColumn("packet_no", F.row_number().over(w())).where(F.col("packet_no") <= cap)
    pkey = F.coalesce(F.sha2("parent_text", 256), F.concat_ws("|", "law_id", "article_number", "doc_id"))
    j = j.withColumn("first_of_parent", F.row_number().over(w("pk")) == 1) if "pk" in j.columns else j.withColumn("pk", pkey).withColumn("first_of_parent", F.row_number().over(w("pk")) == 1)
    context = F.when(F.col("first_of_parent") & (text.duplicate_key("text") != text.duplicate_key("parent_text")), text.truncate("parent_text", most_parent))
    return j.select("query_id", "packet_no", "doc_id", "law_id", "article_number", "citation", "rank", text.truncate("text", most).alias("citable_text"), context.alias("context_text"))


def prompts(selected: DataFrame) -> DataFrame:
    """(query_id, n_evidence, prompt): packets numbered E1 .. En in order, as one text; bounded by the packets' cap."""
    block = F.concat_ws("\n", F.concat(F.lit("[E"), F.col("packet_no"), F.lit("]")), "citation", "citable_text", F.concat(F.lit("Context: "), F.col("context_text")))
    s = selected.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("packet_no", block.alias("b")))).alias("x"))
    return s.select("query_id", F.size("x").alias("n_evidence"), F.array_join(F.transform("x", lambda e: e["b"]), "\n\n").alias("prompt"))


def check_citations(answers: DataFrame, n_evidence: str = "n_evidence", answer: str = "answer") -> DataFrame:
    """The frame with cited (ids in order of use), unknown (ids beyond the evidence) and grounded (some id cited, none unknown)."""
    cited = text.citation_ids(answer)
    known = F.transform(F.sequence(F.lit(1), F.greatest(F.col(n_evidence), F.lit(1))), lambda i: F.concat(F.lit("E"), i.cast("string")))
    unknown = F.array_except(cited, F.when(F.col(n_evidence) > 0, known).otherwise(F.array().cast("array<string>")))
    return answers.withColumn("cited", cited).withColumn("unknown", unknown).withColumn("grounded", (F.size(cited) > 0) & (F.size(unknown) == 0))
