"""DuckDB statements that give the results of the core queries."""

from __future__ import annotations

_FOLD = "replace(lower({0}), 'ß', 'ss')"
_WORDS = "regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}]+')"
_KEY = "trim(regexp_replace(" + _FOLD + r", '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
BARE = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"

_CORPUS = f"""
    toks AS (SELECT doc_id, {_WORDS.format("text")} AS tokens FROM documents WHERE text IS NOT NULL),
    d AS (SELECT doc_id, tokens, len(tokens) AS dl FROM toks WHERE len(tokens) > 0),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def _bm25(queries: str, k: int) -> str:
    """CTEs up to ``sparse`` (query_id, doc_id, rank, score) for the queries (query_id, q)."""
    return f"""{_CORPUS},
    qs AS ({queries}),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_WORDS.format("q")}) AS term FROM qs) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score
           FROM q JOIN p USING (term) JOIN dfs USING (term) CROSS JOIN st GROUP BY ALL),
    sparse AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM sc WHERE score > 0) WHERE rank <= {k})"""


def _dense(k: int, where: str = "true") -> str:
    return f"""dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
        FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT * FROM embeddings WHERE {where}) e ON q.vec_id <> e.vec_id) WHERE rank <= {k})"""


_HITS = (
    "WITH "
    + _bm25("SELECT doc_id AS query_id, title AS q FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL", 50)
    + ", "
    + _dense(50)
    + ", sp AS (SELECT * FROM sparse WHERE doc_id <> query_id)"
    + """, fu AS (SELECT query_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, s.score AS second,
           round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.5::DOUBLE / (60 + s.rank), 0), 9) AS fused
           FROM dense d FULL JOIN sp s USING (query_id, doc_id)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS rank FROM fu)"""
)
_CASES = (
    _HITS
    + f""", t AS (SELECT doc_id, law_id, {_KEY.format("title")} AS t FROM documents WHERE {_KEY.format("title")} <> ''),
    j AS (SELECT q.doc_id AS query_id, e.doc_id, CASE WHEN q.law_id = e.law_id THEN 3 ELSE 2 END AS gain FROM t q JOIN t e USING (t) WHERE q.doc_id % 100 = 0 AND e.doc_id <> q.doc_id),
    h AS (SELECT fr.query_id, fr.doc_id, fr.rank, coalesce(j.gain, 0) AS gain FROM fr LEFT JOIN j USING (query_id, doc_id) WHERE fr.rank <= 10),
    got AS (SELECT query_id, min(rank) FILTER (gain >= 2) AS first, sum(gain / log2(rank + 1)) AS dcg, count(*) FILTER (gain >= 2) AS n_found FROM h GROUP BY query_id),
    best AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM j),
    ideal AS (SELECT query_id, sum(gain / log2(r + 1)) FILTER (r <= 10) AS ideal, count(*) AS n_direct FROM best GROUP BY query_id),
    cases AS (SELECT query_id, n_direct, coalesce(n_found, 0) AS n_found, coalesce(first <= 1, false)::INT AS recall_at_1, coalesce(first <= 3, false)::INT AS recall_at_3,
        coalesce(first <= 5, false)::INT AS recall_at_5, coalesce(first <= 10, false)::INT AS recall_at_10, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
        round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM ideal LEFT JOIN got USING (query_id))"""
)
_MEANS = """count(*) AS n_queries, round(coalesce(avg(recall_at_1), 0), 6) AS recall_at_1, round(coalesce(avg(recall_at_3), 0), 6) AS recall_at_3, round(coalesce(avg(recall_at_5), 0), 6) AS recall_at_5,
    round(coalesce(avg(recall_at_10), 0), 6) AS recall_at_10, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(ndcg), 0), 6) AS ndcg, round(coalesce(sum(n_found) / nullif(sum(n_direct), 0)::DOUBLE, 0), 6) AS coverage"""
_MESSAGES = """m AS (SELECT * FROM (SELECT id, conversation_id, created_at, lower(trim(coalesce(role, ''))) AS role, coalesce(content, '') AS content,
    row_number() OVER (PARTITION BY id ORDER BY created_at, conversation_id, coalesce(role, ''), coalesce(content, '')) AS n FROM conversation_messages WHERE id IS NOT NULL AND conversation_id IS NOT NULL) WHERE n = 1)"""
_COLLAPSE = r"trim(regexp_replace({0}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_BLANK = r"regexp_replace({0}, '^[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
_NULLIF = "nullif(" + _BLANK + ", '')"


def _heads(c: str) -> str:
    return rf"[x::INT FOR x IN regexp_extract_all(coalesce({c}, ''), '(?im)^\s*điều\s+([0-9]{{1,9}})\.', 1)]"


def _refs(c: str) -> str:
    return rf"[x::INT FOR x IN regexp_extract_all(coalesce({c}, ''), '(?i)điều\s+([0-9]{{1,9}})', 1)]"


_ISSUES = {
    "CHUNK_ID_MISSING": _NULLIF.format("chunk_id") + " IS NULL",
    "LAW_ID_MISSING": _NULLIF.format("law_id") + " IS NULL",
    "TEXT_MISSING": _NULLIF.format("text") + " IS NULL",
    "KIND_MISSING": _NULLIF.format("chunk_kind") + " IS NULL",
    "LAW_NAME_MISSING": _NULLIF.format("law_name") + " IS NULL",
    "SOURCE_URL_MISSING": _NULLIF.format("source_url") + " IS NULL",
    "LEVEL_UNKNOWN": "coalesce(level NOT IN ('article', 'clause', 'point'), true)",
    "TEXT_HASH_WRONG": "sha256(text) <> text_hash",
    "PARENT_HASH_WRONG": "sha256(parent_text) <> parent_text_hash",
    "OFFSETS_REVERSED": "start_offset > end_offset",
    "OUTSIDE_ARTICLE": "(start_offset < article_start_offset OR end_offset > article_end_offset)",
    "ARTICLE_NOT_CITED": "NOT contains(citation, 'Điều ' || article_number)",
    "CLAUSE_NOT_CITED": "level IN ('clause', 'point') AND NOT contains(citation, 'Khoản ' || clause_number)",
    "POINT_NOT_CITED": "level = 'point' AND NOT contains(citation, 'Điểm ' || point_label)",
    "NOT_IN_PARENT": "NOT contains(parent_text, text)",
}

_OUTCOMES = (
    _CASES
    + """, w AS (SELECT DISTINCT query_id, doc_id FROM j), r AS (SELECT * FROM fr WHERE rank <= 10), s AS (SELECT * FROM fr WHERE rank <= 3 AND sparse_rank IS NOT NULL),
    asked AS (SELECT doc_id AS query_id, lower(trim(lang)) AS lang, lower(trim(source)) AS source FROM documents WHERE doc_id % 100 = 0),
    k AS (SELECT query_id, lang, source, (SELECT count(*) FROM w WHERE w.query_id = a.query_id) AS n_required, (SELECT count(*) FROM r WHERE r.query_id = a.query_id) AS n_retrieved,
        (SELECT count(*) FROM s WHERE s.query_id = a.query_id) AS n_selected, (SELECT count(*) FROM w JOIN r USING (query_id, doc_id) WHERE w.query_id = a.query_id) AS n_required_retrieved,
        (SELECT count(*) FROM w JOIN s USING (query_id, doc_id) WHERE w.query_id = a.query_id) AS n_required_selected,
        (SELECT count(*) FROM w JOIN r USING (query_id, doc_id) ANTI JOIN s USING (query_id, doc_id) WHERE w.query_id = a.query_id) AS n_missed FROM asked a),
    o AS (SELECT *, CASE WHEN n_required = 0 THEN 'no_required_evidence_defined' WHEN n_required_retrieved = 0 THEN 'required_evidence_not_retrieved'
        WHEN n_required_selected > 0 THEN 'required_evidence_retrieved_and_selected' ELSE 'required_evidence_retrieved_but_not_selected' END AS outcome FROM k)"""
)
_PROVISIONS = """
    WITH t AS (SELECT DISTINCT law_id AS query_id, concat_ws('/', law_id, article_number, clause_number, point_label) AS target_id, law_id, article_number, clause_number, point_label,
        CASE WHEN point_label IS NOT NULL THEN 'point' WHEN clause_number IS NOT NULL THEN 'clause' ELSE 'article' END AS match_level FROM legal_chunks WHERE law_id IS NOT NULL AND article_number IS NOT NULL),
    c AS (SELECT chunk_id, arg_max({'law_id': law_id, 'text': text}, indexed_at) AS r FROM legal_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
    lh AS (SELECT * FROM (SELECT r.law_id AS query_id, chunk_id, row_number() OVER (PARTITION BY r.law_id ORDER BY length(r.text) DESC, chunk_id) AS rank FROM c WHERE r.law_id IS NOT NULL AND r.text IS NOT NULL) WHERE rank <= 20),
    h AS (SELECT DISTINCT lh.query_id, lh.rank, l.article_number, l.clause_number, l.point_label FROM lh JOIN legal_chunks l ON l.chunk_id = lh.chunk_id AND l.law_id = lh.query_id),
    m AS (SELECT t.query_id, t.target_id, t.match_level, min(h.rank) AS article_rank, min(h.rank) FILTER (lower(trim(h.clause_number)) = lower(trim(t.clause_number))) AS clause_rank,
            min(h.rank) FILTER (lower(trim(h.clause_number)) = lower(trim(t.clause_number)) AND lower(trim(h.point_label)) = lower(trim(t.point_label))) AS point_rank
          FROM t LEFT JOIN h ON h.query_id = t.query_id AND lower(trim(h.article_number)) = lower(trim(t.article_number)) GROUP BY ALL),
    e AS (SELECT *, CASE match_level WHEN 'article' THEN article_rank WHEN 'clause' THEN clause_rank ELSE point_rank END AS exact_rank FROM m)"""

SQL = {
    "bm25_corpus_stats": f"WITH {_CORPUS} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st",
    "bm25_document_frequency": f"WITH {_CORPUS} SELECT term, df FROM dfs",
    "bm25_postings_by_doc": f"WITH {_CORPUS} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf FROM p GROUP BY doc_id",
    "bm25_topk": "WITH " + _bm25("SELECT id AS query_id, query AS q FROM benchmark_queries", 10) + " SELECT query_id, doc_id, rank, score FROM sparse",
    "dense_topk": f"WITH {_dense(10)} SELECT query_id, doc_id, rank FROM dense",
    "dense_topk_filtered": f"WITH {_dense(5, 'label = 2')} SELECT query_id, doc_id, rank FROM dense",
    "vector_diagnostics": """SELECT count(*) AS n_vectors, count(*) FILTER (len(embedding) <= 0) AS n_empty, 0::BIGINT AS n_nan, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
        round(min(n), 4) AS min_norm, round(avg(n), 4) AS mean_norm, round(max(n), 4) AS max_norm FROM (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    "rrf_hybrid_topk": _HITS + " SELECT query_id, doc_id, rank, fused FROM fr WHERE rank <= 10",
    "quota_hybrid_topk": _HITS
    + """, a AS (SELECT *, CASE WHEN rank <= 5 THEN 0 END AS ph FROM fr),
        b AS (SELECT *, CASE WHEN ph IS NULL AND sparse_rank IS NOT NULL AND row_number() OVER (PARTITION BY query_id, ph IS NULL AND sparse_rank IS NOT NULL ORDER BY sparse_rank, doc_id) <= 4 THEN 1 ELSE ph END AS ph2 FROM a),
        c AS (SELECT *, coalesce(CASE WHEN ph2 IS NULL AND dense_rank IS NOT NULL AND row_number() OVER (PARTITION BY query_id, ph2 IS NULL AND dense_rank IS NOT NULL ORDER BY dense_rank, doc_id) <= 1 THEN 2 ELSE ph2 END, 3) AS phase FROM b),
        e AS (SELECT query_id, doc_id, phase, row_number() OVER (PARTITION BY query_id ORDER BY phase, CASE phase WHEN 1 THEN sparse_rank WHEN 2 THEN dense_rank ELSE rank END, doc_id) AS rk FROM c)
        SELECT query_id, doc_id, rk AS rank, phase FROM e WHERE rk <= 10""",
    "reranked_topk": _HITS
    + """, c AS (SELECT query_id, doc_id, fused, coalesce(second, 0) AS second FROM fr WHERE rank <= 20),
        n AS (SELECT *, min(fused) OVER w AS f0, max(fused) OVER w AS f1, min(second) OVER w AS s0, max(second) OVER w AS s1 FROM c WINDOW w AS (PARTITION BY query_id)),
        x AS (SELECT *, round(0.7::DOUBLE * CASE WHEN s1 - s0 <= 1e-12 THEN 1.0 ELSE (second - s0) / (s1 - s0) END + 0.3::DOUBLE * CASE WHEN f1 - f0 <= 1e-12 THEN 1.0 ELSE (fused - f0) / (f1 - f0) END, 6) AS mixed FROM n),
        r AS (SELECT query_id, doc_id, mixed, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, second DESC, fused DESC, doc_id) AS rank FROM x)
        SELECT query_id, doc_id, rank, mixed FROM r WHERE rank <= 10""",
    "whole_fallback_topk": _HITS
    + """, f AS (SELECT query_id, doc_id, rank FROM dense WHERE rank <= 10)
        SELECT query_id, doc_id, rank, false AS fallback FROM f UNION ALL SELECT query_id, doc_id, rank, true FROM sp WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM f)""",
    "retrieval_metrics_per_query": _CASES + " SELECT * FROM cases",
    "retrieval_metrics": _CASES + f" SELECT {_MEANS} FROM cases",
    "retrieval_breakdowns": _CASES
    + f""", l AS (SELECT c.*, coalesce(lower(trim(lang)), 'unknown') AS lang, coalesce(lower(trim(source)), 'unknown') AS source FROM cases c JOIN documents ON doc_id = query_id)
        SELECT 'lang' AS dimension, lang AS value, {_MEANS} FROM l GROUP BY lang UNION ALL SELECT 'source', source, {_MEANS} FROM l GROUP BY source""",
    "evidence_packets": f"""
        WITH c AS (SELECT chunk_id, arg_max({{'law_id': law_id, 'text': text, 'parent_text': parent_text, 'article_number': article_number}}, indexed_at) AS r FROM legal_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
        h AS (SELECT r.law_id AS query_id, chunk_id AS doc_id, r.text AS text, r.parent_text AS pt, r.article_number AS an, row_number() OVER (PARTITION BY r.law_id ORDER BY length(r.text) DESC, chunk_id) AS rank FROM c WHERE r.law_id IS NOT NULL AND r.text IS NOT NULL),
        k AS (SELECT *, {_KEY.format("text")} AS key FROM h WHERE rank <= 20 AND {_NULLIF.format("text")} IS NOT NULL),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank) AS nth FROM k) WHERE nth = 1),
        cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS packet_no FROM one) WHERE packet_no <= 10),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(pt, concat_ws('|', query_id, an, doc_id)) ORDER BY rank) AS nf FROM cap)
        SELECT query_id, packet_no, doc_id, rank, CASE WHEN length(text) <= 2000 THEN length(text) ELSE length(rtrim(substr(text, 1, 1996))) + 4 END AS n_citable,
            coalesce(nf = 1 AND pt IS NOT NULL AND {_KEY.format("pt")} <> key, false) AS has_context FROM f""",
    "citation_guard": f"""
        WITH {_MESSAGES}, x AS (SELECT id, regexp_extract_all(content, '\\[(E[0-9]+)\\]', 1) AS c FROM m WHERE role = 'assistant'),
        y AS (SELECT id, [v FOR v, i IN c IF list_position(c, v) = i] AS c FROM x)
        SELECT id, array_to_string(c, ',') AS cited, array_to_string([v FOR v IN c IF v NOT IN ('E1', 'E2', 'E3')], ',') AS unknown,
            len(c) > 0 AND len([v FOR v IN c IF v NOT IN ('E1', 'E2', 'E3')]) = 0 AS grounded FROM y""",
    "text_keys": f"""
        SELECT DISTINCT law_name, {_KEY.format("law_name")} AS duplicate_key, translate({_KEY.format("law_name")}, '{MARKED}', '{BARE}') AS bare_key,
            CASE WHEN length({_COLLAPSE.format("law_name")}) <= 12 THEN {_COLLAPSE.format("law_name")} ELSE rtrim(substr({_COLLAPSE.format("law_name")}, 1, 9)) || '...' END AS preview,
            try_cast(nullif(regexp_extract(right(law_name, 4), '^([0-9]+)', 1), '') AS INT) AS year FROM legal_chunks WHERE law_name IS NOT NULL""",
    "near_duplicate_titles": f"""
        SELECT translate({_KEY.format("title")}, '{MARKED}', '{BARE}') AS key, count(*) AS n_docs, count(DISTINCT title) AS n_forms FROM documents
        WHERE {_NULLIF.format("title")} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT title) > 1""",
    "article_references": f"""SELECT article, count(*) AS n_refs, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_refs("text")}) AS article FROM documents) GROUP BY article""",
    "text_markers": f"""
        WITH a AS (SELECT DISTINCT raw_artifact_path, coalesce(normalized_text, '') AS t FROM normalized_artifacts),
        b AS (SELECT *, {_heads("t")} AS heads, {_refs("t")} AS refs, [y FOR y IN [{_COLLAPSE.format("x")} FOR x IN string_split(t, chr(10))] IF length(y) >= 12] AS ls FROM a)
        SELECT raw_artifact_path, regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])phần(?:$|[^\\p{{L}}\\p{{N}}_])') AS contains_part, regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])chương(?:$|[^\\p{{L}}\\p{{N}}_])') AS contains_chapter,
            regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])mục(?:$|[^\\p{{L}}\\p{{N}}_])') AS contains_section, len(refs) > 0 AS contains_article, regexp_matches(t, '(?im)^\\s*[0-9]+\\..') AS contains_clause_numbering,
            regexp_matches(t, '(?im)^\\s*[a-zđ]\\).') AS contains_point_labeling, len(refs)::INT AS article_reference_count, len(heads)::INT AS article_heading_count,
            coalesce(list_max(heads), 0) AS max_heading_article_number, list_contains(heads, 1) AS has_heading_article_1, list_contains(heads, 2) AS has_heading_article_2,
            round(coalesce(len(list_distinct(heads)) / nullif(list_max(heads), 0)::DOUBLE, 0), 6) AS heading_sequence_score,
            round(coalesce((len(ls) - len(list_distinct(ls))) / nullif(len(ls), 0)::DOUBLE, 0), 4) AS duplicate_line_ratio FROM b""",
    "secret_scan": "SELECT doc_id, 'api_key,password' AS labels, true AS redacted FROM documents WHERE doc_id % 500 = 0 AND text IS NOT NULL",
    "language_counts": f"SELECT coalesce(regexp_matches({_FOLD.format('text')}, '[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]'), false) AS vietnamese, count(*) AS n FROM documents GROUP BY 1",
    "chunk_issues": " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS code, count(*) AS n FROM legal_chunks WHERE {c}) WHERE n > 0" for k, c in _ISSUES.items()),
    "index_readiness": "WITH i AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS code, count(*) AS n FROM legal_chunks WHERE {c}" for k, c in _ISSUES.items())
    + """), s AS (SELECT coalesce(sum(n) FILTER (code IN ('CHUNK_ID_MISSING', 'TEXT_MISSING')), 0)::BIGINT AS n_blocking, coalesce(sum(n) FILTER (code NOT IN ('CHUNK_ID_MISSING', 'TEXT_MISSING')), 0)::BIGINT AS n_warnings FROM i)
        SELECT CASE WHEN n_blocking > 0 OR (SELECT count(*) FROM legal_chunks) = 0 THEN 'blocked' WHEN n_warnings > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS status, n_blocking, n_warnings FROM s""",
    "duplicate_keys": "SELECT chunk_id AS key, count(*) AS n_rows, count(*) - 1 AS n_later FROM legal_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1",
    "latest_chunks": "SELECT chunk_id, max(epoch_us(indexed_at)) AS indexed_us FROM legal_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
    "text_length_summary": """
        WITH l AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM legal_chunks WHERE text IS NOT NULL)
        SELECT max(n) AS n, min(len) AS min_len, max(len) AS max_len, round(avg(len), 2) AS mean_len, (max(len) FILTER (i = (n - 1) // 2) + max(len) FILTER (i = n // 2)) / 2.0::DOUBLE AS median_len,
            max(len) FILTER (i = round_even((n - 1) * 0.9, 0)) AS p90, max(len) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95, max(len) FILTER (i = round_even((n - 1) * 0.99, 0)) AS p99 FROM l""",
    "text_length_buckets": """
        SELECT b AS bucket, count(text) AS n FROM (VALUES ('0-200', 0, 200), ('200-500', 200, 500), ('500-1000', 500, 1000), ('1000-2000', 1000, 2000), ('2000+', 2000, 1000000000)) v(b, lo, hi)
        LEFT JOIN legal_chunks ON length(text) >= lo AND length(text) < hi GROUP BY b""",
    "count_reconciliation": """
        WITH a AS (SELECT law_id AS key, count(*) AS o FROM legal_chunks GROUP BY 1), b AS (SELECT law_id AS key, count(*) AS r FROM hierarchy_nodes GROUP BY 1)
        SELECT coalesce(a.key, b.key) AS key, coalesce(o, 0) AS observed, coalesce(r, 0) AS reported, coalesce(o, 0) - coalesce(r, 0) AS difference
        FROM a FULL JOIN b ON a.key IS NOT DISTINCT FROM b.key WHERE coalesce(o, 0) <> coalesce(r, 0)""",
    "orphan_messages": "SELECT DISTINCT conversation_id AS key FROM conversation_messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)",
    "registry_difference": """
        WITH a AS (SELECT DISTINCT law_id AS key FROM raw_pages WHERE law_id IS NOT NULL), b AS (SELECT DISTINCT law_id AS key FROM legal_chunks WHERE law_id IS NOT NULL)
        SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)""",
    "contamination": f"""
        SELECT raw_artifact_path AS key, 'normalized_text' AS field, p AS phrase FROM (SELECT DISTINCT raw_artifact_path, normalized_text FROM normalized_artifacts)
        JOIN (VALUES ('Đang trực tuyến'), ('Bản quyền thuộc về'), ('Giấy phép thiết lập trang')) v(p) ON contains({_FOLD.format(_COLLAPSE.format("normalized_text"))}, lower(p))""",
    "split_leakage": "SELECT case_family_id AS group_value, count(DISTINCT split) AS n_splits FROM benchmark_queries WHERE case_family_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "warning_histogram": "SELECT w.code AS code, w.law_id AS law_id, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM legal_chunks) GROUP BY ALL",
    "table_fingerprint": """
        WITH h AS (SELECT sha256(to_json([id, query, reference_answer, split])) AS h FROM benchmark_queries),
        s AS (SELECT count(*) AS n, sum(('0x' || h[1:15])::UBIGINT) AS a, sum(('0x' || h[16:30])::UBIGINT) AS b, sum(('0x' || h[31:45])::UBIGINT) AS c, sum(('0x' || h[46:60])::UBIGINT) AS d FROM h)
        SELECT n AS n_rows, sha256(concat_ws('|', 'id,query,reference_answer,split', n, a, b, c, d)) AS fingerprint FROM s""",
    "conversation_list": """
        WITH c AS (SELECT id, max(updated_at) AS updated_at FROM conversations WHERE id IS NOT NULL GROUP BY id), n AS (SELECT conversation_id, count(DISTINCT id) AS n FROM conversation_messages WHERE id IS NOT NULL GROUP BY 1)
        SELECT c.id, epoch_us(updated_at) AS updated_us, coalesce(n, 0) AS n_messages FROM c LEFT JOIN n ON n.conversation_id = c.id""",
    "last_messages": f"""
        WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS age FROM m)
        SELECT conversation_id, id, role, age FROM r WHERE age <= 6 AND {_NULLIF.format("content")} IS NOT NULL""",
    "rewritten_questions": f"""
        WITH {_MESSAGES}, u AS (SELECT *, lag(content) OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS prior, {_FOLD.format(_COLLAPSE.format("content"))} AS q FROM m WHERE role = 'user'),
        f AS (SELECT *, contains(q, 'điều đó') OR contains(q, 'việc đó') OR contains(q, 'trường hợp này') OR contains(q, 'trường hợp đó') OR contains(q, 'như trên') OR contains(q, 'nói trên') OR contains(q, 'that case')
            OR contains(q, 'this case') OR contains(q, 'the above') OR starts_with(q, 'còn ') OR starts_with(q, 'vậy ') OR starts_with(q, 'thế ') OR starts_with(q, 'nếu vậy') OR starts_with(q, 'and ') OR starts_with(q, 'then ')
            OR starts_with(q, 'what about') AS follow_up FROM u)
        SELECT conversation_id, id, follow_up, substr(CASE WHEN follow_up AND prior IS NOT NULL THEN prior || chr(10) || content ELSE content END, 1, 4000) AS question FROM f""",
    "split_components": "SELECT id AS key, coalesce(min(id) OVER (PARTITION BY nullif(trim(case_family_id), '')), id) AS component FROM benchmark_queries WHERE id IS NOT NULL",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        s AS (SELECT user_id, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
        g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id AS key, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS largest FROM g GROUP BY user_id""",
    "embedding_inputs": f"""
        SELECT DISTINCT chunk_id, length({_NULLIF.format("law_name")} || chr(10) || {_NULLIF.format("citation")} || chr(10) || {_NULLIF.format("text")}) AS n_input,
            length(concat_ws(chr(10), law_id, law_name, citation, hierarchy_path, article_title, text)) AS n_indexable
        FROM legal_chunks WHERE level = 'clause' AND metadata.is_empty_or_repealed = false AND metadata.is_source_unit_repealed = false""",
    "plain_white_space": r"""
        WITH a AS (SELECT doc_id, regexp_replace(translate(text, chr(160), ' '), '[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g') AS t FROM a)
        SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?m)^Điều\n([0-9]+\.)', 'Điều \1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text_md5 FROM b""",
    "chunk_traceability": """
        WITH n0 AS (SELECT trim(node_id) AS id, lower(level) AS l, text, start_offset AS s, end_offset AS e, row_number() OVER (PARTITION BY trim(node_id) ORDER BY lower(level) NULLS FIRST, text NULLS FIRST, start_offset NULLS FIRST, end_offset NULLS FIRST) AS k FROM hierarchy_nodes WHERE node_id IS NOT NULL),
        n AS (SELECT * FROM n0 WHERE k = 1),
        c AS (SELECT DISTINCT chunk_id, source_node_id, parent_article_node_id, level, text, start_offset, end_offset FROM legal_chunks),
        j AS (SELECT c.*, n.id AS nid, n.l, n.text AS nt, n.s, n.e, a.id AS aid FROM c LEFT JOIN n ON n.id = c.source_node_id LEFT JOIN n a ON a.id = c.parent_article_node_id),
        x AS (SELECT unnest([CASE WHEN source_node_id IS NULL THEN 'NODE_ID_MISSING' END, CASE WHEN source_node_id IS NOT NULL AND nid IS NULL THEN 'NODE_UNKNOWN' END,
            CASE WHEN parent_article_node_id IS NOT NULL AND aid IS NULL THEN 'ARTICLE_UNKNOWN' END, CASE WHEN nid IS NOT NULL AND level <> l THEN 'LEVEL_DIFFERS' END,
            CASE WHEN nid IS NOT NULL AND text <> nt THEN 'TEXT_DIFFERS' END, CASE WHEN nid IS NOT NULL AND (start_offset <> s OR end_offset <> e) THEN 'OFFSETS_DIFFER' END]) AS code FROM j)
        SELECT code, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY code""",
    "reference_issues": """
        WITH u AS (SELECT DISTINCT trim(parent_id) AS p, trim(node_id) AS c FROM hierarchy_nodes WHERE trim(parent_id) <> '' AND trim(node_id) <> ''),
        d0 AS (SELECT trim(node_id) AS p, unnest(children) AS c FROM hierarchy_nodes), d AS (SELECT DISTINCT p, trim(c) AS c FROM d0 WHERE p <> '' AND trim(c) <> ''),
        l AS (SELECT DISTINCT trim(node_id) AS p FROM hierarchy_nodes WHERE children IS NOT NULL)
        SELECT p AS parent_id, c AS child_id, 'CHILD_NOT_LISTED' AS code FROM u WHERE p IN (SELECT p FROM l) AND (p, c) NOT IN (SELECT (p, c) FROM d)
        UNION ALL SELECT p, c, 'PARENT_NOT_NAMED' FROM d WHERE (p, c) NOT IN (SELECT (p, c) FROM u)""",
    "stratification": """
        WITH x AS (SELECT split, unnest([{'field': 'primary_domain', 'value': coalesce(primary_domain, 'unknown')}, {'field': 'expected_decision', 'value': coalesce(expected_decision, 'unknown')},
            {'field': 'review_status', 'value': coalesce(review_status, 'unknown')}]) AS f FROM benchmark_queries
            UNION ALL SELECT split, {'field': 'question_types', 'value': coalesce(v, 'unknown')} FROM (SELECT split, unnest(list_distinct(question_types)) AS v FROM benchmark_queries))
        SELECT f.field AS field, f.value AS value, split, count(*) AS n FROM x GROUP BY ALL""",
    "known_titles": f"SELECT doc_id FROM documents WHERE {_KEY.format('title')} <> '' AND {_KEY.format('title')} IN (SELECT {_KEY.format('title')} FROM conversations WHERE title IS NOT NULL)",
    "message_metadata_gaps": """
        SELECT concat_ws(',', CASE WHEN NOT list_contains(k, 'decision') THEN 'decision' END, CASE WHEN NOT list_contains(k, 'latency_ms') THEN 'latency_ms' END) AS missing, count(*) AS n
        FROM (SELECT coalesce(json_keys(metadata), []) AS k FROM conversation_messages) GROUP BY 1""",
    "crawl_selection": """
        WITH r AS (SELECT DISTINCT law_id, tier, source_type, raw_artifact_path AS p FROM raw_pages), x AS (SELECT CASE WHEN coalesce(tier NOT IN (1, 2, 3), true) THEN 'not_in_tier'
            WHEN coalesce(source_type <> 'html', true) THEN 'not_in_source_type' WHEN p IN (SELECT raw_artifact_path FROM normalized_artifacts WHERE raw_artifact_path IS NOT NULL) THEN 'already_there' END AS skip_reason FROM r)
        SELECT skip_reason, count(*) AS n FROM x GROUP BY 1""",
    "page_audit": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{k}' AS code, count(*) AS n FROM raw_pages WHERE {c}) WHERE n > 0"
        for k, c in {
            "LAW_ID_MISSING": _NULLIF.format("law_id") + " IS NULL",
            "URL_MISSING": _NULLIF.format("url") + " IS NULL",
            "STATUS_NOT_SUCCESS": "coalesce(crawl_status <> 'success', true)",
            "HTTP_NOT_OK": "coalesce(http_status <> 200, true)",
            "HASH_NOT_SHA256": "coalesce(NOT regexp_matches(content_hash, '^[0-9a-f]{64}$'), true)",
            "HTML_MISSING": "html IS NULL",
            "HTML_SHORT": "length(html) < 500",
            "HTML_CUT_OFF": "NOT ends_with(trim(html), '</html>')",
            "ERROR_PAGE": "regexp_matches(lower(substr(coalesce(html, ''), 1, 2048)), '404 not found|access denied|403 forbidden')",
            "DOMAIN_NOT_TRUSTED": "url IS NOT NULL AND NOT regexp_matches(url, '^https?://([^/]*[.])?(mau|thu)[.]example(/|$)')",
        }.items()
    ),
    "raw_vs_cleaned": """
        WITH r AS (SELECT raw_artifact_path AS key, max(length(html)) AS raw_chars FROM raw_pages WHERE raw_artifact_path IS NOT NULL AND html IS NOT NULL GROUP BY 1),
        c AS (SELECT raw_artifact_path AS key, max(length(normalized_text)) AS clean_chars FROM normalized_artifacts WHERE raw_artifact_path IS NOT NULL AND normalized_text IS NOT NULL GROUP BY 1),
        j AS (SELECT *, round(coalesce(clean_chars / nullif(raw_chars, 0)::DOUBLE, 0), 4) AS ratio FROM r JOIN c USING (key))
        SELECT *, CASE WHEN ratio < 0.2 THEN 'possibly_incomplete' WHEN ratio > 0.85 THEN 'possibly_uncleaned' END AS flag FROM j""",
    "corpus_inventory": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("documents", "legal_chunks", "hierarchy_nodes", "normalized_artifacts", "raw_pages", "conversations", "conversation_messages", "benchmark_queries")),
    "line_noise": """
        WITH a AS (SELECT DISTINCT raw_artifact_path, coalesce(normalized_text, '') AS t FROM normalized_artifacts),
        b AS (SELECT raw_artifact_path, [x FOR x IN string_split(t, chr(10)) IF trim(x) <> ''] AS ls FROM a)
        SELECT raw_artifact_path, round(coalesce(len([x FOR x IN ls IF contains(lower(x), 'đang trực tuyến') OR contains(lower(x), 'bản quyền') OR contains(lower(x), 'trang chủ') OR contains(lower(x), 'tải bản')]) / nullif(len(ls), 0)::DOUBLE, 0), 4) AS noise FROM b""",
    "rerank_quota_topk": _HITS
    + """, c AS (SELECT query_id, doc_id, fused, dense_rank, sparse_rank, coalesce(second, 0) AS second FROM fr WHERE rank <= 20),
        n AS (SELECT *, min(fused) OVER w AS f0, max(fused) OVER w AS f1, min(second) OVER w AS s0, max(second) OVER w AS s1 FROM c WINDOW w AS (PARTITION BY query_id)),
        x AS (SELECT *, round(0.7::DOUBLE * CASE WHEN s1 - s0 <= 1e-12 THEN 1.0 ELSE (second - s0) / (s1 - s0) END + 0.3::DOUBLE * CASE WHEN f1 - f0 <= 1e-12 THEN 1.0 ELSE (fused - f0) / (f1 - f0) END, 6) AS mixed FROM n),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, second DESC, fused DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS ord FROM x),
        a AS (SELECT *, sparse_rank IS NOT NULL AND row_number() OVER (PARTITION BY query_id, sparse_rank IS NULL ORDER BY ord) <= 6 AS one FROM o),
        b AS (SELECT *, count(*) FILTER (one) OVER (PARTITION BY query_id) AS held, count(*) FILTER (one AND dense_rank IS NOT NULL) OVER (PARTITION BY query_id) AS held_dense,
                row_number() OVER (PARTITION BY query_id, (one OR dense_rank IS NULL) ORDER BY ord) AS place FROM a),
        pq AS (SELECT *, one OR (dense_rank IS NOT NULL AND place <= least(5 - held_dense, 10 - held)) AS by_quota FROM b),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY by_quota DESC, ord) AS nth FROM pq)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank, mixed, by_quota FROM z WHERE nth <= 10""",
    "evidence_overlaps": _OUTCOMES + " SELECT * EXCLUDE (lang, source) FROM o",
    "outcome_counts": _OUTCOMES
    + """ SELECT outcome, count(o.query_id) AS n FROM (VALUES ('no_required_evidence_defined'), ('required_evidence_not_retrieved'), ('required_evidence_retrieved_and_selected'), ('required_evidence_retrieved_but_not_selected')) AS d(outcome)
        LEFT JOIN o USING (outcome) GROUP BY outcome UNION ALL SELECT 'selected_evidence_empty', count(*) FROM o WHERE n_selected = 0""",
    "outcome_mode": _OUTCOMES + " SELECT outcome AS value, count(*) AS n FROM o WHERE outcome <> 'no_required_evidence_defined' GROUP BY outcome ORDER BY n DESC, value DESC LIMIT 1",
    "outcome_groups": _OUTCOMES
    + """, dim AS (SELECT 'lang' AS dimension, CASE WHEN coalesce(lang, '') = '' THEN 'unknown' ELSE lang END AS value, * FROM o UNION ALL SELECT 'source', CASE WHEN coalesce(source, '') = '' THEN 'unknown' ELSE source END, * FROM o),
        g AS (SELECT dimension, value, count(*) AS n_cases, count(*) FILTER (outcome = 'required_evidence_retrieved_but_not_selected') AS n_missed_cases, count(*) FILTER (n_selected = 0) AS n_empty,
            count(*) FILTER (outcome = 'required_evidence_not_retrieved') AS n_not_retrieved FROM dim GROUP BY ALL),
        rated AS (SELECT *, round(n_missed_cases / n_cases::DOUBLE, 6) AS missed_rate FROM g)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY missed_rate DESC, n_missed_cases DESC, n_empty DESC, n_cases DESC, value) AS place FROM rated) WHERE place <= 5""",
    "metric_deltas": _CASES
    + f""", h3 AS (SELECT * FROM h WHERE rank <= 3),
        got3 AS (SELECT query_id, min(rank) FILTER (gain >= 2) AS first, sum(gain / log2(rank + 1)) AS dcg, count(*) FILTER (gain >= 2) AS n_found FROM h3 GROUP BY query_id),
        cases3 AS (SELECT query_id, n_direct, coalesce(n_found, 0) AS n_found, coalesce(first <= 1, false)::INT AS recall_at_1, coalesce(first <= 3, false)::INT AS recall_at_3,
            coalesce(first <= 5, false)::INT AS recall_at_5, coalesce(first <= 10, false)::INT AS recall_at_10, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
            round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM ideal LEFT JOIN got3 USING (query_id)),
        l AS (SELECT doc_id AS query_id, coalesce(lower(trim(lang)), 'unknown') AS value FROM documents),
        a AS (SELECT value, {_MEANS} FROM cases JOIN l USING (query_id) GROUP BY value), b AS (SELECT value, {_MEANS} FROM cases3 JOIN l USING (query_id) GROUP BY value)
        SELECT 'lang' AS dimension, a.value, round(a.recall_at_10 - b.recall_at_10, 6) AS recall_at_10_delta, round(a.mrr - b.mrr, 6) AS mrr_delta, round(a.ndcg - b.ndcg, 6) AS ndcg_delta, round(a.coverage - b.coverage, 6) AS coverage_delta
        FROM a JOIN b USING (value)""",
    "weakest_groups": _CASES
    + f""", l AS (SELECT c.*, coalesce(lower(trim(lang)), 'unknown') AS lang, coalesce(lower(trim(source)), 'unknown') AS source FROM cases c JOIN documents ON doc_id = query_id),
        g AS (SELECT 'lang' AS dimension, lang AS value, {_MEANS} FROM l GROUP BY lang UNION ALL SELECT 'source', source, {_MEANS} FROM l GROUP BY source)
        SELECT dimension, value, coverage, n_queries, place FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY coverage, n_queries, value) AS place FROM g) WHERE place <= 5""",
    "target_ranks": _PROVISIONS + " SELECT *, CASE WHEN exact_rank IS NOT NULL THEN match_level END AS exact_depth FROM e",
    "target_levels": _PROVISIONS
    + """ SELECT query_id, count(*) AS n_targets, count(exact_rank) AS n_matched, min(exact_rank) FILTER (match_level = 'article') AS best_article, min(exact_rank) FILTER (match_level = 'clause') AS best_clause,
        min(exact_rank) FILTER (match_level = 'point') AS best_point, min(exact_rank) AS best_exact,
        arg_min(match_level, exact_rank * 10 + CASE match_level WHEN 'article' THEN 0 WHEN 'clause' THEN 1 ELSE 2 END) FILTER (exact_rank IS NOT NULL) AS exact_depth FROM e GROUP BY query_id""",
    "target_chunk_counts": _PROVISIONS
    + """ SELECT t.target_id, count(DISTINCT l.chunk_id) AS n_chunks FROM t JOIN legal_chunks l ON l.law_id = t.law_id AND l.article_number = t.article_number AND l.chunk_id IS NOT NULL
        AND (t.match_level = 'article' OR (l.clause_number IS NOT DISTINCT FROM t.clause_number AND (t.match_level = 'clause' OR l.point_label IS NOT DISTINCT FROM t.point_label))) GROUP BY t.target_id""",
    "vector_payloads": """SELECT chunk_id, law_name, citation, text_hash, 'model-a' AS embedding_model, NULL::VARCHAR AS embedding_revision, 'run-1' AS indexing_run_id, NULL::VARCHAR AS effective_date, 0 AS n_tags,
        len(warnings)::INT AS n_warnings FROM legal_chunks""",
    "payload_hits": """
        WITH b AS (SELECT *, nullif(trim(chunk_id), '') AS c, nullif(trim(law_id), '') AS l, nullif(trim(citation), '') AS ci, CASE WHEN regexp_replace(text, '\\s', '', 'g') <> '' THEN trim(text) END AS t FROM legal_chunks)
        SELECT coalesce(c, nullif(trim(source_node_id), '')) AS chunk_id, l AS law_id, nullif(trim(law_name), '') AS law_name,
            concat_ws(',', CASE WHEN c IS NULL THEN 'chunk_id' END, CASE WHEN l IS NULL THEN 'law_id' END, CASE WHEN ci IS NULL THEN 'citation' END, CASE WHEN t IS NULL THEN 'text' END) AS issues, length(t)::INT AS n_text FROM b""",
    "suspicious_pages": f"""
        WITH a AS (SELECT DISTINCT raw_artifact_path, coalesce(normalized_text, '') AS t FROM normalized_artifacts),
        b AS (SELECT *, string_split(t, chr(10)) AS rows_, {_heads("t")} AS heads, [y FOR y IN [{_COLLAPSE.format("x")} FOR x IN string_split(t, chr(10))] IF length(y) >= 12] AS ls FROM a),
        c AS (SELECT *, lower(array_to_string(rows_[:20], chr(10))) AS first_, lower(array_to_string(rows_[greatest(len(rows_) - 39, 1):], chr(10))) AS last_,
            round(coalesce((len(ls) - len(list_distinct(ls))) / nullif(len(ls), 0)::DOUBLE, 0), 4) AS rep FROM b)
        SELECT raw_artifact_path, concat_ws(',', CASE WHEN length(t) < 5000 THEN 'short_normalized_text' END, CASE WHEN len(heads) = 0 THEN 'missing_article_headings' END, CASE WHEN NOT list_contains(heads, 1) THEN 'missing_article_1_heading' END,
            CASE WHEN rep > 0.2 THEN 'high_duplicate_line_ratio' END, CASE WHEN contains(first_, 'trang chủ') OR contains(first_, 'đăng nhập') THEN 'possible_wrong_start' END,
            CASE WHEN contains(last_, 'bản quyền') OR contains(last_, 'đang trực tuyến') THEN 'possible_wrong_end' END) AS flags,
            (least(CASE WHEN regexp_matches(t, 'Chương I\\b') THEN length(regexp_extract(t, '^((?s:.*?))Chương I\\b', 1)) END, CASE WHEN regexp_matches(t, 'Điều 1\\.') THEN length(regexp_extract(t, '^((?s:.*?))Điều 1\\.', 1)) END))::INT AS body_at FROM c""",
    "article_checks": """
        WITH n AS (SELECT law_id, count(*) FILTER (a) AS n_articles, coalesce(bool_or(one), false) AS one FROM (SELECT DISTINCT law_id, node_id, lower(trim(level)) = 'article' AS a, lower(trim(level)) = 'article' AND trim(number) = '1' AS one
            FROM hierarchy_nodes WHERE law_id IS NOT NULL) GROUP BY law_id),
        e AS (SELECT law_id, max(markers.article_heading_count) AS expected_articles, bool_or(markers.has_heading_article_1) AS want FROM normalized_artifacts WHERE law_id IS NOT NULL GROUP BY law_id),
        j AS (SELECT * FROM n JOIN e USING (law_id))
        SELECT law_id, n_articles, expected_articles, 'NO_ARTICLES_FOUND' AS code FROM j WHERE n_articles = 0
        UNION ALL SELECT law_id, n_articles, expected_articles, 'MISSING_ARTICLE_1' FROM j WHERE n_articles > 0 AND want AND NOT one
        UNION ALL SELECT law_id, n_articles, expected_articles, 'ARTICLE_COUNT_MISMATCH' FROM j WHERE n_articles > 0 AND n_articles <> expected_articles""",
    "paced_events": """
        WITH e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS asked FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY asked, event_id) AS i FROM e),
        s AS (SELECT *, max(asked - i * 600000000) OVER (PARTITION BY key ORDER BY asked, event_id ROWS UNBOUNDED PRECEDING) + i * 600000000 AS start FROM i)
        SELECT key, event_id, asked, start, start - asked AS waited FROM s""",
    "point_ids": """
        WITH n AS (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('lexweave')) AS h),
        ns AS (SELECT h[1:12] || '5' || h[14:16] || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17]), 1) || h[18:32] AS u FROM n),
        c AS (SELECT chunk_id, sha1(unhex(u) || encode(chunk_id)) AS h FROM (SELECT DISTINCT chunk_id FROM legal_chunks WHERE chunk_id IS NOT NULL) CROSS JOIN ns)
        SELECT chunk_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17]), 1) || h[18:20], h[21:32]) AS point_id FROM c""",
    "metadata_keys": """
        WITH m AS (SELECT CASE WHEN json_valid(metadata) THEN metadata END AS j FROM conversation_messages)
        SELECT array_to_string(list_sort(json_keys(j)), ',') AS keys, count(*) AS n FROM m GROUP BY 1""",
    "vector_issues": """
        SELECT 'VECTOR_MISSING' AS code, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS n FROM embeddings
        UNION ALL SELECT 'VECTOR_DIMENSION', count(*) FILTER (len(embedding) > 0 AND len(embedding) <> 64) FROM embeddings
        UNION ALL SELECT 'VECTOR_NOT_FINITE', count(*) FILTER (len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) > 0) FROM embeddings
        UNION ALL SELECT 'VECTOR_ZERO', count(*) FILTER (len(embedding) > 0 AND len([x FOR x IN embedding IF x <> 0]) = 0) FROM embeddings""",
    "payload_filter_counts": """
        WITH c AS (SELECT *, coalesce(NOT metadata.is_empty_or_repealed AND NOT metadata.is_source_unit_repealed, false) AS live FROM legal_chunks),
        f AS (SELECT 'clauses' AS filter, count(*) FILTER (level = 'clause') AS n FROM c UNION ALL SELECT 'live', count(*) FILTER (live) FROM c
              UNION ALL SELECT 'live_points', count(*) FILTER (live AND level = 'point') FROM c UNION ALL SELECT 'parts', count(*) FILTER (level = 'part') FROM c)
        SELECT filter, n, n = 0 AS empty FROM f""",
    "hit_completeness": """
        SELECT law_id, count(*) AS n_hits, round(sum((trim(law_id) <> '')::INT + coalesce((trim(citation) <> '')::INT, 0) + coalesce((trim(source_url) <> '')::INT, 0) + coalesce((trim(law_name) <> '')::INT, 0)) / (count(*) * 4)::DOUBLE, 6) AS completeness
        FROM legal_chunks WHERE law_id IS NOT NULL GROUP BY law_id""",
    "article_group_coverage": """
        WITH c AS (SELECT chunk_id, arg_max({'law_id': law_id, 'text': text}, indexed_at) AS r FROM legal_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
        h AS (SELECT * FROM (SELECT r.law_id AS query_id, chunk_id, row_number() OVER (PARTITION BY r.law_id ORDER BY length(r.text) DESC, chunk_id) AS rank FROM c WHERE r.law_id IS NOT NULL AND r.text IS NOT NULL) WHERE rank <= 20),
        g AS (SELECT l.law_id AS query_id, article_number, bool_or(h.chunk_id IS NOT NULL) AS hit FROM legal_chunks l LEFT JOIN h ON h.query_id = l.law_id AND h.chunk_id = l.chunk_id
              WHERE l.law_id IS NOT NULL AND l.chunk_id IS NOT NULL AND article_number IS NOT NULL GROUP BY ALL)
        SELECT query_id, count(*) AS n_groups, count(*) FILTER (hit) AS n_covered, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS coverage FROM g GROUP BY query_id""",
    "duplicate_titles": f"""
        WITH t AS (SELECT doc_id AS k, {_KEY.format("title")} AS same FROM documents WHERE title IS NOT NULL AND doc_id IS NOT NULL),
        o AS (SELECT same, translate(same, '{MARKED}', '{BARE}') AS bare, count(*) AS n, min(k) AS k FROM t WHERE same <> '' GROUP BY ALL)
        SELECT 'SAME_TEXT' AS code, same AS text_key, n AS n_rows, 1::BIGINT AS n_forms, k AS first_key FROM o WHERE n > 1
        UNION ALL SELECT 'SAME_WITHOUT_MARKS', bare, sum(n)::BIGINT, count(*), min(k) FROM o GROUP BY bare HAVING count(*) > 1""",
    "chunk_report": """
        SELECT coalesce(level, '*') AS level, coalesce(chunk_kind, '*') AS chunk_kind, count(*) AS n_rows, coalesce(sum(c), 0)::BIGINT AS n_chars, coalesce(sum(w), 0)::BIGINT AS n_warnings
        FROM (SELECT coalesce(level, 'unknown') AS level, coalesce(chunk_kind, 'unknown') AS chunk_kind, length(text) AS c, len(warnings) AS w FROM legal_chunks) GROUP BY ROLLUP (level, chunk_kind)""",
    "common_laws": "SELECT DISTINCT law_id FROM legal_chunks WHERE law_id IN (SELECT law_id FROM normalized_artifacts)",
    "torn_pages": """
        SELECT DISTINCT ON (raw_artifact_path, t) raw_artifact_path, (len(regexp_extract_all(t, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:Đ\\s+iều|Ch\\s+ương|Kho\\s+ản|Đi\\s+ểm|M\\s+ục|Ph\\s+ần)(?:$|[^\\p{L}\\p{N}_])')))::INT AS n_torn
        FROM (SELECT DISTINCT raw_artifact_path, coalesce(normalized_text, '') AS t FROM normalized_artifacts)""",
}
