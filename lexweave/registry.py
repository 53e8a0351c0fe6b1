"""Queries of the core operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import oracle
from lexweave.functions import text
from lexweave.operators import audit, chunking, cleaning, conversation, dense, diagnostics, evidence, fingerprint, fusion, hierarchy, html, indexing, metrics, readiness, skew, sparse, splits, targets, validate
from lexweave.plans import hybrid
from lexweave.session import materialize, table
from lexweave.streaming import rate


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "hierarchy_nodes"), paths=False).where("fault is not null").select("node_id", "fault")


def p2_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The circles themselves, with the link that closes each."""
    return hierarchy.cycles(hierarchy.hierarchy(table(spark, d, "hierarchy_nodes"), paths=False))


def p2_trees(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy.hierarchy(table(spark, d, "hierarchy_nodes"))
    return t.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "n_descendants", "fault")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Nodes under a root only, as the query's SQL has it."""
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "hierarchy_nodes")).where("fault is null"))


def p2_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Those of the nodes without a root too."""
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "hierarchy_nodes")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "legal_chunks"), "law_id", 0.05, table(spark, d, "normalized_artifacts")).select("law_id")


def p4_per_law(spark: SparkSession, d: str) -> DataFrame:
    out = skew.key_states(table(spark, d, "legal_chunks"), "law_id", "text", ["chunk_id", "article_number"])
    return out.select("law_id", "n_rows", F.col("distinct_chunk_id").alias("n_chunks"), F.col("distinct_article_number").alias("n_articles"), F.col("size_sum").alias("text_size"))


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    return skew.joined_states(table(spark, d, "legal_chunks"), table(spark, d, "normalized_artifacts"), "law_id", "text", "normalized_text")



# --- Sparse retrieval ------------------------------------------------------------------------------------------------


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return sparse.corpus_statistics(table(spark, d, "documents"), "doc_id", "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return sparse.document_frequency(table(spark, d, "documents"), "doc_id", "text")


def bm25_postings_by_doc(spark: SparkSession, d: str) -> DataFrame:
    p = sparse.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse.bm25_topk(table(spark, d, "documents"), table(spark, d, "benchmark_queries"))


# --- Dense retrieval -------------------------------------------------------------------------------------------------


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return dense.dense_topk(v, v.where("vec_id % 100 = 0")).select("query_id", "doc_id", "rank")


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only vectors of one label: the filter goes to the scan."""
    v = table(spark, d, "embeddings")
    return dense.dense_topk(v.where("label = 2"), v.where("vec_id % 100 = 0"), 5).select("query_id", "doc_id", "rank")


def vector_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return dense.vector_diagnostics(table(spark, d, "embeddings"), "embedding")


# --- Hybrid retrieval: queries are the documents whose id is divisible by 100 -----------------------------------------


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, v = table(spark, d, "documents"), table(spark, d, "embeddings")
    asked = docs.where("doc_id % 100 = 0")
    de = dense.dense_topk(v, v.where("vec_id % 100 = 0"), 50)
    sp = sparse.bm25_topk(docs, asked.select("doc_id", "title"), 50, query_id="doc_id", query="title").where("doc_id <> query_id")
    return materialize(de), materialize(sp)


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the query's title are wanted, most those of its law too."""
    docs = table(spark, d, "documents").select("doc_id", "law_id", text.duplicate_key("title").alias("t")).where("t <> ''")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("law_id").alias("q_law"), "t")
    return q.join(docs, "t").where("doc_id <> query_id").select("query_id", "doc_id", F.when(F.col("q_law") == F.col("law_id"), 3).otherwise(2).alias("gain"))


def rrf_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top_fused(fusion.fuse(*_hits(spark, d), sparse_weight=1.5), 10).select("query_id", "doc_id", "rank", "fused")


def quota_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.select_with_quotas(fusion.fuse(*_hits(spark, d), sparse_weight=1.5), 10, 5, 4, 1).select("query_id", "doc_id", "rank", "phase")


def diverse_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    laws = table(spark, d, "documents").select("doc_id", "law_id")
    return fusion.select_diverse(fusion.fuse(*_hits(spark, d), sparse_weight=1.5).join(laws, "doc_id", "left"), 10, "law_id")


def reranked_topk(spark: SparkSession, d: str) -> DataFrame:
    de, sp = _hits(spark, d)
    return fusion.rerank(fusion.top_fused(fusion.fuse(de, sp, sparse_weight=1.5), 20), sp, 10)


def rerank_quota_topk(spark: SparkSession, d: str) -> DataFrame:
    de, sp = _hits(spark, d)
    return fusion.rerank_with_quotas(fusion.top_fused(fusion.fuse(de, sp, sparse_weight=1.5), 20), sp, 10, 6, 5)


def diverse_detail_topk(spark: SparkSession, d: str) -> DataFrame:
    """Laws as groups, sources as their details."""
    own = table(spark, d, "documents").select("doc_id", "law_id", F.lower(F.trim("source")).alias("source"))
    return fusion.select_diverse(fusion.fuse(*_hits(spark, d), sparse_weight=1.5).join(own, "doc_id", "left"), 10, ["law_id"], 0.005, ["source"])


def whole_fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    """Dense hits where there are any, sparse hits for the other queries."""
    de, sp = _hits(spark, d)
    return fusion.with_fallback(de.where("rank <= 10"), sp.where("rank <= 10"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(hybrid.ranking(*_hits(spark, d), hybrid.Config("rrf", 1, 1.5)), _judgments(spark, d))


def retrieval_metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate(_cases(spark, d))


def retrieval_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    dims = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.lower(F.trim("lang")).alias("lang"), F.lower(F.trim("source")).alias("source"))
    return metrics.breakdowns(_cases(spark, d).join(dims, "query_id"), ["lang", "source"])


def fusion_ablation(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.ablation(*_hits(spark, d), materialize(_judgments(spark, d)))


# --- What becomes of required documents, and weak groups --------------------------------------------------------------


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Required are direct judgments, retrieved the ten best fused, selected those of the three best that BM25 found too."""
    fused = materialize(fusion.top_fused(fusion.fuse(*_hits(spark, d), sparse_weight=1.5), 10))
    asked = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.lower(F.trim("lang")).alias("lang"), F.lower(F.trim("source")).alias("source"))
    cases = diagnostics.overlaps(_judgments(spark, d).where("gain >= 2"), fused, fused.where("rank <= 3 and sparse_rank is not null"), asked)
    return cases.join(asked, "query_id")


def evidence_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).drop("lang", "source")


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.outcome_counts(_outcomes(spark, d))


def outcome_mode(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.mode(_outcomes(spark, d), "outcome", ["no_required_evidence_defined"])


def outcome_groups(spark: SparkSession, d: str) -> DataFrame:
    """The five groups of each dimension that lose most."""
    rows = diagnostics.group_summary(_outcomes(spark, d), ["lang", "source"])
    return diagnostics.top_groups(rows, "dimension", [F.desc("missed_rate"), F.desc("n_missed_cases"), F.desc("n_empty"), F.desc("n_cases"), F.asc("value")])


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Ten against three places, by language."""
    de, sp = _hits(spark, d)
    judged = materialize(_judgments(spark, d))
    dims = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.lower(F.trim("lang")).alias("lang"))
    both = [metrics.breakdowns(metrics.per_query(hybrid.ranking(de, sp, hybrid.Config("rrf", 1, 1.5), k), judged).join(dims, "query_id"), ["lang"]) for k in (10, 3)]
    return diagnostics.deltas(*both, ["dimension", "value"], ["recall_at_10", "mrr", "ndcg", "coverage"])


def weakest_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval_breakdowns(spark, d)
    return diagnostics.top_groups(rows, "dimension", [F.asc("coverage"), F.asc("n_queries"), F.asc("value")]).select("dimension", "value", "coverage", "n_queries", "place")


# --- Expected provisions ---------------------------------------------------------------------------------------------


def _provisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every provision of a law as its target, and the law's twenty longest chunks as hits."""
    c = table(spark, d, "legal_chunks")
    level = F.when(F.col("point_label").isNotNull(), "point").when(F.col("clause_number").isNotNull(), "clause").otherwise("article")
    t = c.where("law_id is not null and article_number is not null").select("law_id", "article_number", "clause_number", "point_label", level.alias("match_level")).distinct()
    t = t.withColumn("target_id", F.concat_ws("/", "law_id", "article_number", "clause_number", "point_label")).withColumn("query_id", F.col("law_id"))
    h, _ = _law_hits(spark, d)
    # A chunk may stand for several provisions in repeated rows; each is a hit at the chunk's rank.
    return t, h.join(c.select(F.col("chunk_id").alias("doc_id"), "law_id", "article_number", "clause_number", "point_label").distinct(), "doc_id").where("law_id = query_id")


def target_ranks(spark: SparkSession, d: str) -> DataFrame:
    return targets.match_ranks(*_provisions(spark, d))


def target_levels(spark: SparkSession, d: str) -> DataFrame:
    return targets.best_by_level(targets.match_ranks(*_provisions(spark, d)))


def target_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    t, _ = _provisions(spark, d)
    return targets.target_chunks(t, table(spark, d, "legal_chunks").where("chunk_id is not null")).groupBy("target_id").agg(F.count("*").alias("n_chunks"))


# --- Evidence --------------------------------------------------------------------------------------------------------


def _law_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per law its 20 longest chunks as a ranking, and the chunks."""
    c = validate.latest(table(spark, d, "legal_chunks").select("chunk_id", "law_id", "article_number", "citation", "text", "parent_text", "indexed_at"), "chunk_id", "indexed_at")
    w = Window.partitionBy("law_id").orderBy(F.desc(F.length("text")), "chunk_id")
    h = c.where("law_id is not null and text is not null").select("law_id", "chunk_id", F.row_number().over(w).alias("rank"), F.length("text").cast("double").alias("score")).where("rank <= 20")
    return h.select(F.col("law_id").alias("query_id"), F.col("chunk_id").alias("doc_id"), "rank", "score"), c.drop("indexed_at")


def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    return evidence.packets(*_law_hits(spark, d)).select("query_id", "packet_no", "doc_id", "rank", F.length("citable_text").alias("n_citable"), F.col("context_text").isNotNull().alias("has_context"))


def evidence_prompts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.prompts(evidence.packets(*_law_hits(spark, d))).select("query_id", "n_evidence", F.length("prompt").alias("n_chars"))


def citation_guard(spark: SparkSession, d: str) -> DataFrame:
    m = conversation.distinct_messages(table(spark, d, "conversation_messages")).where("role = 'assistant'").withColumn("n_evidence", F.lit(3))
    c = evidence.check_citations(m, answer="content")
    return c.select("id", F.array_join("cited", ",").alias("cited"), F.array_join("unknown", ",").alias("unknown"), "grounded")


# --- Text functions --------------------------------------------------------------------------------------------------


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "legal_chunks").where("law_name is not null").select("law_name").distinct()
    return t.select("law_name", text.duplicate_key("law_name").alias("duplicate_key"), text.bare_key("law_name").alias("bare_key"), text.preview("law_name", 12).alias("preview"), text.numeric_prefix(F.substring("law_name", -4, 4)).alias("year"))


def near_duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are the same but for marks, case and punctuation."""
    t = table(spark, d, "documents").where(text.blank_to_null("title").isNotNull()).groupBy(text.bare_key("title").alias("key")).agg(F.count("*").alias("n_docs"), F.count_distinct("title").alias("n_forms"))
    return t.where("n_forms > 1")


def article_references(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(text.article_numbers("text")).alias("article"))
    return t.groupBy("article").agg(F.count("*").alias("n_refs"), F.count_distinct("doc_id").alias("n_docs"))


def text_markers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "normalized_artifacts").select("raw_artifact_path", "normalized_text").distinct()
    return a.select("raw_artifact_path", text.markers("normalized_text").alias("m"), text.duplicate_line_ratio("normalized_text").alias("duplicate_line_ratio")).select("raw_artifact_path", "m.*", "duplicate_line_ratio")


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Labels of secret-looking texts; the made-up ones are added to every 500th document."""
    t = F.when(F.col("doc_id") % 500 == 0, F.concat("text", F.lit(" api_key=ABCDEF123456 password: hunter2"))).otherwise(F.col("text"))
    x = table(spark, d, "documents").select("doc_id", t.alias("t")).where("t is not null")
    return x.select("doc_id", F.array_join(text.secret_labels("t"), ",").alias("labels"), F.contains(text.redact("t"), F.lit("[password]")).alias("redacted")).where("labels <> ''")


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.looks_vietnamese("text").alias("vietnamese")).agg(F.count("*").alias("n"))


# --- Validation ------------------------------------------------------------------------------------------------------


def chunk_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts(validate.issues(table(spark, d, "legal_chunks"), "chunk_id", validate.chunk_checks()), "code")


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(table(spark, d, "legal_chunks"), "chunk_id", ["indexed_at"])


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return validate.latest(table(spark, d, "legal_chunks").select("chunk_id", "indexed_at", "law_id"), "chunk_id", "indexed_at").select("chunk_id", F.unix_micros("indexed_at").alias("indexed_us"))


def text_length_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.length_summary(table(spark, d, "legal_chunks"), "text")


def text_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return validate.length_buckets(table(spark, d, "legal_chunks"), "text")


def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return validate.reconcile(table(spark, d, "legal_chunks"), table(spark, d, "hierarchy_nodes"), "law_id")


def orphan_messages(spark: SparkSession, d: str) -> DataFrame:
    return validate.orphans(table(spark, d, "conversation_messages"), table(spark, d, "conversations"), "conversation_id", "id")


def registry_difference(spark: SparkSession, d: str) -> DataFrame:
    return validate.set_difference(table(spark, d, "raw_pages"), table(spark, d, "legal_chunks"), "law_id")


def contamination(spark: SparkSession, d: str) -> DataFrame:
    return validate.contamination(table(spark, d, "normalized_artifacts").select("raw_artifact_path", "normalized_text").distinct(), "raw_artifact_path", ["normalized_text"], ["Đang trực tuyến", "Bản quyền thuộc về", "Giấy phép thiết lập trang"])


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return validate.group_leakage(table(spark, d, "benchmark_queries"), "case_family_id", "split")


def warning_histogram(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts(table(spark, d, "legal_chunks").select(F.explode("warnings").alias("w")).select("w.code", "w.law_id"), "code", "law_id")


def chunk_traceability(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts(validate.traceability(table(spark, d, "legal_chunks"), table(spark, d, "hierarchy_nodes")), "code")


def reference_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.reference_issues(table(spark, d, "hierarchy_nodes"))


def stratification(spark: SparkSession, d: str) -> DataFrame:
    return validate.stratification(table(spark, d, "benchmark_queries"), "split", ["primary_domain", "expected_decision", "review_status"], ["question_types"])


def known_titles(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title is, but for punctuation and case, a conversation's title."""
    return validate.known_texts(table(spark, d, "documents").select("doc_id", "title"), "title", table(spark, d, "conversations").select("title"), "title").select("doc_id")


def message_metadata_gaps(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages")
    return m.groupBy(F.array_join(validate.missing_json_keys(m, "metadata", ["decision", "latency_ms"]), ",").alias("missing")).agg(F.count("*").alias("n"))


DOMAINS = ["mau.example", "thu.example", "giadinh.example"]


def crawl_selection(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages by the rule that leaves them out: tier, source type, and artifacts that are there already."""
    r = table(spark, d, "raw_pages").select("law_id", "tier", "source_type", "raw_artifact_path").distinct()
    s = audit.select_targets(r, {"tier": [1, 2, 3], "source_type": ["html"]}, table(spark, d, "normalized_artifacts"), "raw_artifact_path")
    return validate.counts(s, "skip_reason")


def page_audit(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts(validate.issues(table(spark, d, "raw_pages"), "raw_artifact_path", audit.page_checks(domains=DOMAINS[:2])), "code")


def raw_vs_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return audit.raw_and_cleaned(table(spark, d, "raw_pages"), table(spark, d, "normalized_artifacts"))


def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    return audit.inventory({t: table(spark, d, t) for t in ("documents", "legal_chunks", "hierarchy_nodes", "normalized_artifacts", "raw_pages", "conversations", "conversation_messages", "benchmark_queries")})


def line_noise(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "normalized_artifacts").select("raw_artifact_path", "normalized_text").distinct()
    return a.select("raw_artifact_path", audit.line_noise("normalized_text", ["Đang trực tuyến", "Bản quyền", "Trang chủ", "Tải bản"]).alias("noise"))


# --- Readiness -------------------------------------------------------------------------------------------------------


def vector_issues(spark: SparkSession, d: str) -> DataFrame:
    """How many of all vectors fail each check, zeros included."""
    n = readiness.filter_counts(table(spark, d, "embeddings"), readiness.vector_checks("embedding", 64))
    return n.select(F.col("filter").alias("code"), "n")


def payload_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    c = {"clauses": F.col("level") == "clause", "live": indexing.payload_filter(True), "live_points": indexing.payload_filter(True, level="point"), "parts": indexing.payload_filter(level="part")}
    return readiness.filter_counts(table(spark, d, "legal_chunks"), c)


def hit_completeness(spark: SparkSession, d: str) -> DataFrame:
    return readiness.completeness(table(spark, d, "legal_chunks").where("law_id is not null"), "law_id", ["law_id", "citation", "source_url", "law_name"])


def article_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of every law the articles as groups, and its twenty longest chunks as what was selected."""
    h, _ = _law_hits(spark, d)
    g = table(spark, d, "legal_chunks").where("law_id is not null and chunk_id is not null").select(F.col("law_id").alias("query_id"), F.col("article_number").alias("group_id"), F.col("chunk_id").alias("doc_id"))
    return readiness.group_coverage(g, h)


def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    return readiness.duplicate_texts(table(spark, d, "documents"), "doc_id", "title")


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    return readiness.count_report(table(spark, d, "legal_chunks"), ["level", "chunk_kind"], {"n_chars": F.length("text"), "n_warnings": F.size("warnings")})


def common_laws(spark: SparkSession, d: str) -> DataFrame:
    return readiness.common_keys(table(spark, d, "legal_chunks"), table(spark, d, "normalized_artifacts"), "law_id")


def index_readiness(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_chunks")
    return readiness.readiness(chunk_issues(spark, d), ["CHUNK_ID_MISSING", "TEXT_MISSING"], c.count())


def torn_pages(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "normalized_artifacts").select("raw_artifact_path", "normalized_text").distinct()
    return a.select("raw_artifact_path", readiness.torn_words("normalized_text").cast("int").alias("n_torn"))


def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    m = conversation.distinct_messages(table(spark, d, "conversation_messages")).where("role = 'assistant'")
    return m.select("id", F.size(readiness.claims("content")).alias("n_claims"), F.array_join(readiness.phrases_in("content", ["chắc chắn", "cam kết", "theo Điều"]), ",").alias("phrases"))


# --- Fingerprints ----------------------------------------------------------------------------------------------------


def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.table_fingerprint(table(spark, d, "benchmark_queries").select("id", "query", "reference_answer", "split"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_chunks").where("chunk_id is not null").select("chunk_id").distinct().select("chunk_id", fingerprint.point_id("chunk_id", "lexweave").alias("point_id"))


def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversation_messages").select(fingerprint.canonical_json("metadata").alias("canonical"))
    return m.groupBy(F.json_object_keys("canonical").alias("k")).agg(F.count("*").alias("n")).select(F.array_join("k", ",").alias("keys"), "n")


# --- Parsing ---------------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "normalized_artifacts").where("normalized_text is not null").groupBy(F.col("raw_artifact_path").alias("doc_id")).agg(F.max("normalized_text").alias("text"))
    return materialize(chunking.parse(a))


def parsed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).drop("text")


def parsed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_parsed(spark, d)).drop("text", "parent_text")


def parsed_tree_issues(spark: SparkSession, d: str) -> DataFrame:
    return chunking.tree_issues(_parsed(spark, d))


def stored_tree_issues(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "hierarchy_nodes").select(F.col("source_file").alias("doc_id"), "node_id", F.lower("level").alias("level"), text.blank_to_null("parent_id").alias("parent_id"), "start_offset", "end_offset", "text").distinct()
    return validate.counts(chunking.tree_issues(n), "code")


def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(table(spark, d, "raw_pages"), "raw_artifact_path").select("key", F.length("main_text").alias("n_chars"), "n_lines", "n_articles")


def html_profile(spark: SparkSession, d: str) -> DataFrame:
    return html.profile(table(spark, d, "raw_pages"), "raw_artifact_path")


def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """Page text through the whole cleaning, by lengths and number of lines."""
    a = cleaning.clean(table(spark, d, "normalized_artifacts").select("raw_artifact_path", "normalized_text").distinct(), "normalized_text")
    return a.select("raw_artifact_path", F.length("normalized_text").alias("n_before"), F.length("clean_text").alias("n_after"), F.size(text.lines("clean_text")).alias("n_lines"))


def plain_white_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(cleaning.plain_white_space(cleaning.plain_characters("text"))).alias("text_md5"))


def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_chunks").where(indexing.payload_filter(True, level="clause"))
    return c.select("chunk_id", F.length(indexing.embedding_input("law_citation_text")).alias("n_input"), F.length(indexing.indexable_text()).alias("n_indexable")).distinct()


def vector_payloads(spark: SparkSession, d: str) -> DataFrame:
    p = indexing.vector_payload(table(spark, d, "legal_chunks"), "model-a", "run-1")
    return p.select("chunk_id", "law_name", "citation", "text_hash", "embedding_model", "embedding_revision", "indexing_run_id", "effective_date", F.size("domain_tags").alias("n_tags"), F.size("warnings").alias("n_warnings"))


def payload_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as hits of a vector search whose point id is the source node's."""
    h = indexing.hits_of(table(spark, d, "legal_chunks").withColumn("point", F.col("source_node_id")), "point")
    return h.select("chunk_id", "law_id", "law_name", F.array_join("issues", ",").alias("issues"), F.length("text").alias("n_text"))


def suspicious_pages(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "normalized_artifacts").select("raw_artifact_path", "normalized_text").distinct()
    flags = audit.suspicious_flags("normalized_text", ["Trang chủ", "Đăng nhập"], ["Bản quyền", "Đang trực tuyến"])
    return a.select("raw_artifact_path", F.array_join(flags, ",").alias("flags"), audit.first_position("normalized_text", ["Chương I\\b", "Điều 1\\."]).alias("body_at"))


def article_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "normalized_artifacts").select("law_id", "markers.article_heading_count", "markers.has_heading_article_1")
    return audit.article_checks(table(spark, d, "hierarchy_nodes"), e)


def chunk_source_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks with what was found about their nodes in the stored trees' parent links."""
    c = validate.latest(table(spark, d, "legal_chunks").select("chunk_id", "source_node_id", "parent_article_node_id", "indexed_at"), "chunk_id", "indexed_at")
    i = hierarchy.hierarchy(table(spark, d, "hierarchy_nodes"), paths=False).where("fault is not null").select("node_id", F.upper("fault").alias("code"))
    return chunking.source_warnings(c, i).select("chunk_id", F.array_join("source_warnings", ",").alias("source_warnings"), F.array_join("caveat_references", ",").alias("caveat_references"))


def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_chunks").select("chunk_id", "text").where("chunk_id is not null").distinct()
    return dense.vector_diagnostics(indexing.embed(c, F.col("text"), indexing.hashed_encoder).where("embedding is not null"), "embedding")


# --- Conversations ---------------------------------------------------------------------------------------------------


def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return conversation.conversation_list(table(spark, d, "conversations"), table(spark, d, "conversation_messages")).select("id", F.unix_micros("updated_at").alias("updated_us"), "n_messages")


def last_messages(spark: SparkSession, d: str) -> DataFrame:
    return conversation.last_messages(table(spark, d, "conversation_messages"), 6).select("conversation_id", "id", "role", "age")


def rewritten_questions(spark: SparkSession, d: str) -> DataFrame:
    return conversation.rewritten_questions(table(spark, d, "conversation_messages"))


# --- Splits, streams -------------------------------------------------------------------------------------------------


def split_components(spark: SparkSession, d: str) -> DataFrame:
    return splits.components_by_fields(table(spark, d, "benchmark_queries"), "id", ["case_family_id"])


def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(split_components(spark, d), {"development": 0.7, "held_out": 0.3})


def rate_limited_events(spark: SparkSession, d: str) -> DataFrame:
    return rate.rate_limit(table(spark, d, "events"), 3, 3600.0, "user_id", "event_id", "ts").select("key", "event_id", "allowed", "retry_after")


def paced_events(spark: SparkSession, d: str) -> DataFrame:
    """When each user's requests may start if they lie ten minutes apart."""
    return rate.paced(table(spark, d, "events"), 600.0, "user_id", "event_id", "ts")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = rate.session_counts(table(spark, d, "events"), "user_id", "ts", "2 hours")
    return s.groupBy("key").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("largest"))


FLAGSHIP = "bm25_topk"
QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_cycles, p2_trees, p2_descendants, p2_all_descendants, p4_found, p4_per_law, p4_joined, bm25_corpus_stats, bm25_document_frequency, bm25_postings_by_doc, bm25_topk,
        dense_topk, dense_topk_filtered, vector_diagnostics, rrf_hybrid_topk, quota_hybrid_topk, diverse_hybrid_topk, reranked_topk, rerank_quota_topk, diverse_detail_topk, whole_fallback_topk,
        retrieval_metrics_per_query, retrieval_metrics, retrieval_breakdowns, fusion_ablation, evidence_packets, evidence_prompts, citation_guard, text_keys, evidence_overlaps, outcome_counts, outcome_mode, outcome_groups, metric_deltas, weakest_groups,
        target_ranks, target_levels, target_chunk_counts, vector_payloads, payload_hits, suspicious_pages, article_checks, chunk_source_warnings,
        vector_issues, payload_filter_counts, hit_completeness, article_group_coverage, duplicate_titles, chunk_report, common_laws, index_readiness, torn_pages, answer_claims,
        near_duplicate_titles, article_references, text_markers, secret_scan, language_counts, chunk_issues, duplicate_keys, latest_chunks, text_length_summary,
        text_length_buckets, count_reconciliation, orphan_messages, registry_difference, contamination, split_leakage, warning_histogram, chunk_traceability, reference_issues, stratification, known_titles, message_metadata_gaps, crawl_selection, page_audit, raw_vs_cleaned, corpus_inventory, line_noise, html_profile, table_fingerprint,
        point_ids, metadata_keys, parsed_nodes, parsed_chunks, parsed_tree_issues, stored_tree_issues, html_main_text, cleaned_text, plain_white_space, embedding_inputs, hashed_embeddings, conversation_list, last_messages,
        rewritten_questions, split_components, grouped_split, rate_limited_events, paced_events, event_sessions,
    )
}

_TREE_SQL = r"""
    WITH RECURSIVE n AS (
        SELECT id, min(parent) AS parent FROM (
            SELECT nullif(regexp_replace(node_id, '^\s+|\s+$', '', 'g'), '') AS id, nullif(regexp_replace(parent_id, '^\s+|\s+$', '', 'g'), '') AS parent FROM hierarchy_nodes)
        WHERE id IS NOT NULL GROUP BY id),
    good AS (
        SELECT id, id AS root, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL
        UNION ALL SELECT n.id, g.root, g.depth + 1, list_append(g.path, n.id) FROM good g JOIN n ON n.parent = g.id),
    lost AS (
        SELECT id FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)
        UNION ALL SELECT n.id FROM lost l JOIN n ON n.parent = l.id),
    rest AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM good) AND id NOT IN (SELECT id FROM lost)),
    walk AS (
        SELECT id AS src, parent AS cur FROM rest
        UNION SELECT w.src, n.parent FROM walk w JOIN n ON n.id = w.cur),
    fault AS (
        SELECT id AS node_id, 'lost' AS fault FROM lost
        UNION ALL SELECT id, CASE WHEN EXISTS (SELECT 1 FROM walk WHERE src = id AND cur = id) THEN 'on_cycle' ELSE 'under_cycle' END FROM rest)
"""
SQL = {
    "p2_found": _TREE_SQL + "SELECT node_id, fault FROM fault",
    "p2_cycles": _TREE_SQL
    + """, ring AS (SELECT n.id, n.parent FROM n JOIN fault f ON f.node_id = n.id AND f.fault = 'on_cycle'),
        least AS (SELECT src AS id, min(cur) AS cycle_id, count(*) AS k FROM walk WHERE src IN (SELECT id FROM ring) GROUP BY src),
        along AS (SELECT id AS cycle_id, id AS cur, 0 AS position FROM least WHERE id = cycle_id
                  UNION ALL SELECT a.cycle_id, r.parent, a.position + 1 FROM along a JOIN ring r ON r.id = a.cur WHERE r.parent <> a.cycle_id)
        SELECT a.cycle_id, a.cur AS node_id, a.position::BIGINT AS position, r.parent AS next_id, r.parent = a.cycle_id AS closes FROM along a JOIN ring r ON r.id = a.cur""",
    "p2_trees": _TREE_SQL
    + """, below AS (SELECT a AS id, count(*) AS k FROM (SELECT unnest(path[:-2]) AS a FROM good) GROUP BY a),
        under AS (SELECT id AS anc, id AS cur FROM lost UNION ALL SELECT u.anc, n.id FROM under u JOIN n ON n.parent = u.cur),
        below_lost AS (SELECT anc AS id, count(*) - 1 AS k FROM under GROUP BY anc)
        SELECT g.id AS node_id, g.root AS root_id, g.depth AS depth, array_to_string(g.path, ' > ') AS path, coalesce(b.k, 0) AS n_descendants, NULL::VARCHAR AS fault FROM good g LEFT JOIN below b USING (id)
        UNION ALL SELECT f.node_id, NULL, NULL, NULL, b.k, f.fault FROM fault f LEFT JOIN below_lost b ON b.id = f.node_id""",
    "p2_all_descendants": _TREE_SQL
    + """, up AS (SELECT id AS descendant_id, parent AS node_id, 1 AS distance FROM n WHERE parent IN (SELECT id FROM n) AND parent <> id
                  UNION SELECT u.descendant_id, n.parent, u.distance + 1 FROM up u JOIN n ON n.id = u.node_id WHERE n.parent IN (SELECT id FROM n) AND u.distance < (SELECT count(*) FROM n))
        SELECT node_id, descendant_id, min(distance)::INT AS distance FROM up WHERE node_id <> descendant_id GROUP BY ALL""",
    "p2_descendants": _TREE_SQL + "SELECT path[i] AS node_id, id AS descendant_id, (depth + 1 - i)::INT AS distance FROM (SELECT id, path, depth, unnest(range(1, depth + 1)) AS i FROM good)",
    "chunk_source_warnings": _TREE_SQL
    + """, c AS (SELECT chunk_id, arg_max({'s': source_node_id, 'a': parent_article_node_id}, indexed_at) AS r FROM legal_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
        own AS (SELECT DISTINCT chunk_id, unnest([r.s, r.a]) AS node_id FROM c),
        j AS (SELECT DISTINCT chunk_id, node_id, upper(fault) AS code FROM own JOIN fault USING (node_id))
        SELECT chunk_id, array_to_string(list_sort(list(DISTINCT code)), ',') AS source_warnings, array_to_string(list_sort(list(DISTINCT code || ':' || node_id)), ',') AS caveat_references FROM j GROUP BY chunk_id""",
    "p4_found": "SELECT law_id FROM legal_chunks WHERE law_id IS NOT NULL GROUP BY law_id HAVING count(*) > 0.05 * (SELECT count(*) FROM legal_chunks)",
    "p4_per_law": """SELECT law_id, count(*) AS n_rows, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT article_number) AS n_articles,
        coalesce(sum(length(text)), 0)::BIGINT AS text_size FROM legal_chunks GROUP BY law_id""",
    "p4_joined": """
        SELECT law_id, count(DISTINCT c) AS n_left, count(DISTINCT a) AS n_right, count(*) AS n_joined, coalesce(sum(lc), 0)::BIGINT AS left_size_joined, coalesce(sum(la), 0)::BIGINT AS right_size_joined
        FROM (SELECT law_id, row_number() OVER () AS c, length(text) AS lc FROM legal_chunks) JOIN (SELECT law_id, row_number() OVER () AS a, length(normalized_text) AS la FROM normalized_artifacts) USING (law_id)
        GROUP BY law_id""",
    **oracle.SQL,
}
