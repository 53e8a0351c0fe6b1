"""BM25 retrieval of a stated query set over a whole corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexweave.functions import text
from lexweave.functions.words import hash_words
from lexweave.session import in_sets, spread

K1, B = 1.5, 0.75
#: Queries scored at once; query words (with their queries) that one scan of the corpus is held against, about 24 bytes
#: each; dense weights that a worker keeps instead of making them anew for each block.
QUERIES_PER_PASS, SCAN_WORDS, KEPT_WEIGHTS = 1000, 5_000_000, 8_000_000


def tokenized(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """(doc_id, tokens, dl) of the documents with a token."""
    return docs.select(F.col(doc_id).alias("doc_id"), text.tokens(content).alias("tokens")).withColumn("dl", F.size("tokens")).where("dl > 0 and doc_id is not null")


def corpus_statistics(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """One row: n_docs and avgdl over the documents with a token."""
    return tokenized(docs, doc_id, content).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """(term, doc_id, tf)."""
    return tokenized(docs, doc_id, content).select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """(term, df)."""
    return tokenized(docs, doc_id, content).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _numbers(texts: list, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number and term number of each word that is a term, number of words of each text)."""
    h, n = hash_words(texts)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    return np.repeat(np.arange(len(n)), n)[hit], at[hit], n


def _statistics(batches: Iterable[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of each term; at -1 the number of documents with a word, at -2 the number of words."""
    df, docs, words = np.zeros(len(terms), np.int64), 0, 0
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            doc, term, n = _numbers(b.column(1).slice(lo, 1024).to_pylist(), terms)
            df += np.bincount(np.unique(doc * len(terms) + term) % len(terms), minlength=len(terms))
            docs += int((n > 0).sum())
            words += int(n.sum())
    at = np.nonzero(df)[0]
    yield pa.record_batch([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*df[at].tolist(), docs, words], pa.int64())], names=["term", "n"])


class QuerySet:
    """Up to QUERIES_PER_PASS queries: their ids, and for each of their words the term, the query and its weight."""

    def __init__(self, ids: list, hashes: np.ndarray, sizes: np.ndarray):
        self.ids, self.hashes = ids, hashes
        self.query = np.repeat(np.arange(len(sizes)), sizes)

    def weigh(self, terms: np.ndarray, idf: np.ndarray) -> None:
        """Give weights by the terms of all sets; the terms of this one are numbered by themselves."""
        at = np.searchsorted(terms, self.hashes)
        self.own, self.term = np.unique(at, return_inverse=True)
        self.weight = idf[at]

    def dense(self) -> np.ndarray:
        """idf times query frequency, terms x queries."""
        out = np.zeros((len(self.own), len(self.ids)))
        np.add.at(out, (self.term, self.query), self.weight)
        return out


def _best(sets: list[QuerySet], k: int, batches: Iterable[pa.RecordBatch], terms: np.ndarray, avgdl: float, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The k best documents of every query in this partition, ties by id. A block's words are hashed once for all sets."""
    doc_type = None
    best: list[list[list[tuple[float, object]]]] = [[[] for _ in s.ids] for s in sets]
    kept = [s.dense() for s in sets] if sum(len(s.own) * len(s.ids) for s in sets) <= KEPT_WEIGHTS else None
    for b in batches:
        doc_type = b.column(0).type
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            doc, term, n = _numbers(part.column(1).to_pylist(), terms)
            docs = part.column(0).to_pylist()
            norm = K1 * (1 - B + B * n / max(avgdl, 1.0))
            for j, one in enumerate(sets):
                at = np.minimum(np.searchsorted(one.own, term), len(one.own) - 1)
                hit = one.own[at] == term
                tf = np.bincount(doc[hit] * len(one.own) + at[hit], minlength=len(n) * len(one.own)).reshape(len(n), -1).astype(np.float64)
                s = np.round((tf * (K1 + 1) / (tf + norm[:, None])) @ (kept[j] if kept else one.dense()), 6)
                # Only scores that reach the k-th best of the block and of what is held can matter.
                floor = -np.partition(np.ascontiguousarray(-s.T), k - 1, axis=1)[:, k - 1] if len(n) > k else np.zeros(len(one.ids))
                floor = np.maximum(floor, [x[-1][0] if len(x) >= k else 0.0 for x in best[j]])
                rows, cols = np.nonzero((s >= floor) & (s > 0))
                fresh: dict[int, list] = {}
                for i, q, x in zip(rows.tolist(), cols.tolist(), s[rows, cols].tolist()):
                    fresh.setdefault(q, []).append((x, docs[i]))
                for q, found in fresh.items():
                    best[j][q] = sorted(best[j][q] + found, key=lambda t: (-t[0], t[1]))[:k]
    if doc_type is None:
        return
    for j, one in enumerate(sets):
        flat = [(one.ids[q], d, x) for q, found in enumerate(best[j]) for x, d in found]
        q_ids, d_ids, scores = zip(*flat) if flat else ((), (), ())
        yield pa.record_batch([pa.array(q_ids, id_type), pa.array(d_ids, doc_type), pa.array(scores, pa.float64())], names=["query_id", "doc_id", "score"])


def _grouped(sets: Iterator[QuerySet]) -> Iterator[list[QuerySet]]:
    held: list[QuerySet] = []
    for one in sets:
        if held and sum(len(x.hashes) for x in held) + len(one.hashes) > SCAN_WORDS:
            yield held
            held = []
        held.append(one)
    if held:
        yield held


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", content: str = "text", query_id: str = "id", query: str = "query") -> DataFrame:
    """(query_id, doc_id, rank, score): the k best documents of every query by (score desc, doc_id); scores have six
    decimals. Documents without a query term, blank texts and blank queries give no row.

    Words are compared by 64-bit hashes. Every partition scores its documents against all queries and keeps its k best of
    each, so that the shuffle carries k rows per query and partition instead of one per query and document. One scan gives
    the statistics and one the scores of all query sets that fit into SCAN_WORDS.
    """
    spark = docs.sparkSession
    base = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    q_type, d_type = dict(queries.dtypes)[query_id], dict(docs.dtypes)[doc_id]
    schema = f"query_id {q_type}, doc_id {d_type}, score double"
    id_type = to_arrow_type(queries.schema[query_id].dataType)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("q")).where(F.col("query_id").isNotNull() & F.col("q").isNotNull()).dropDuplicates(["query_id"])
    found = None
    sets = (QuerySet([r["query_id"] for r in part], *hash_words([r["q"] for r in part])) for part in in_sets(asked, "query_id", QUERIES_PER_PASS))
    for group in _grouped(s for s in sets if len(s.hashes)):
        terms = np.unique(np.concatenate([s.hashes for s in group]))
        seen = base.mapInArrow(lambda it, t=terms: _statistics(it, t), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        df = {r["term"]: r["n"] for r in seen}
        n_docs = df.get(-1, 0)
        held = np.array([df.get(i, 0) for i in range(len(terms))], np.float64)
        for s in group:
            s.weigh(terms, np.log(1 + (n_docs - held + 0.5) / (held + 0.5)))
        avgdl = df.get(-2, 0) / max(1, n_docs)
        shared = spark.sparkContext.broadcast((group, terms))
        hits = base.mapInArrow(lambda it, own=shared, a=avgdl: _best(own.value[0], k, it, own.value[1], a, id_type), schema)
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")
