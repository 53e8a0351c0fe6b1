"""Exact dense retrieval and vector diagnostics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import in_sets

#: Queries scored at once, and bytes of query vectors that one scan is held against.
QUERIES_PER_PASS, SCAN_BYTES = 4096, 64_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    f = lambda c: F.col(c) if isinstance(c, str) else c
    return F.aggregate(F.zip_with(f(a), f(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(c: str) -> Column:
    """The vector by its length; zero and non-finite vectors stay as they are."""
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fine = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / norm)).otherwise(v)


def vector_diagnostics(df: DataFrame, vector: str) -> DataFrame:
    """One row: vectors, empty ones, ones with NaN, smallest and largest dimension, least, mean and largest norm."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.select(F.size(v).alias("d"), norm.alias("n"), F.exists(v, lambda x: F.isnan(x)).alias("bad")).agg(
        F.count("*").alias("n_vectors"), F.count_if(F.col("d") <= 0).alias("n_empty"), F.count_if("bad").alias("n_nan"), F.min("d").alias("min_dim"), F.max("d").alias("max_dim"),
        F.round(F.min("n"), 4).alias("min_norm"), F.round(F.avg("n"), 4).alias("mean_norm"), F.round(F.max("n"), 4).alias("max_norm"),
    )


class _Best:
    """The k best of each query so far, by (score desc, doc)."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.q, self.d, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, docs: np.ndarray, vecs: np.ndarray, exclude_self: bool) -> None:
        s = np.round(self.queries @ vecs.T, 6)
        if exclude_self:
            s[self.ids[:, None] == docs[None, :]] = -np.inf
        floor = self.floor
        if s.shape[1] > self.k:  # nothing below the block's k-th score can matter
            floor = np.maximum(floor, -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1])
        q, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        q, d, s = np.concatenate([self.q, q]), np.concatenate([self.d, docs[j]]), np.concatenate([self.s, s[q, j]])
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        self.q, self.d, self.s = q[keep], d[keep], s[keep]
        last = place[keep] == self.k - 1
        self.floor[self.q[last]] = self.s[last]


def _search(batches: Iterable[pa.RecordBatch], sets: list[tuple[np.ndarray, np.ndarray]], k: int, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    best = [_Best(ids, queries, k) for ids, queries in sets]
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            docs = part.column(0).to_numpy(zero_copy_only=False)
            vecs = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            for one in best:
                one.add(docs, vecs, exclude_self)
    for one in best:
        yield pa.record_batch([pa.array(one.ids[one.q]), pa.array(one.d), pa.array(one.s)], names=["query_id", "doc_id", "score"])


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, doc_id, rank, score): the k nearest by cosine of every query vector, exact, ties by id. Vectors are
    normalized; those with NaN, of another dimension than the first query or null take no part. Keys are integers.

    Each partition keeps k rows per query. All query sets that fit into SCAN_BYTES are held against one scan."""
    rows = queries.select(F.col(key).cast("bigint").alias("id"), l2_normalize(vector).alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: F.isnan(x))).dropDuplicates(["id"])
    spark = vectors.sparkSession
    groups: list[list[tuple[np.ndarray, np.ndarray]]] = []
    dim = filled = 0
    for part in in_sets(rows, "id", QUERIES_PER_PASS):
        dim = dim or len(part[0]["v"])
        part = [r for r in part if len(r["v"]) == dim]
        if not part:
            continue
        one = np.array([r["id"] for r in part], np.int64), np.array([r["v"] for r in part], np.float64)
        if not groups or filled + one[1].nbytes > SCAN_BYTES:
            groups.append([])
            filled = 0
        groups[-1].append(one)
        filled += one[1].nbytes
    found = None
    base = vectors.select(F.col(key).cast("bigint").alias("doc_id"), l2_normalize(vector).alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: F.isnan(x)) & F.col("doc_id").isNotNull())
    for group in groups:
        shared = spark.sparkContext.broadcast(group)
        hits = base.mapInArrow(lambda it, own=shared: _search(it, own.value, k, exclude_self), "query_id bigint, doc_id bigint, score double")
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")
