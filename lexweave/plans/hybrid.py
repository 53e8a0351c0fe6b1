"""Hybrid retrieval: both rankings once, every fusion from the same candidates, and the best configuration by metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import fusion, metrics


@dataclass(frozen=True)
class Config:
    name: str
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    quotas: tuple[int, int, int] | None = None


#: The grid that :func:`ablation` compares.
GRID = tuple(Config(f"rrf_{d:g}_{s:g}", d, s) for d, s in ((1, 1), (1, 1.5), (1.5, 1), (1, 0), (0, 1))) + tuple(Config(f"quota_{a}_{b}_{c}", 1, 1.5, (a, b, c)) for a, b, c in ((5, 4, 1), (6, 2, 2), (4, 3, 3)))


def ranking(dense: DataFrame, sparse: DataFrame, c: Config, k: int = 10) -> DataFrame:
    f = fusion.fuse(dense, sparse, dense_weight=c.dense_weight, sparse_weight=c.sparse_weight)
    r = fusion.select_with_quotas(f, k, *c.quotas) if c.quotas else fusion.top_fused(f, k)
    return r.select("query_id", "doc_id", "rank", "fused")


def ablation(dense: DataFrame, sparse: DataFrame, judgments: DataFrame, grid: tuple[Config, ...] = GRID) -> DataFrame:
    """(config, metrics ...) of every configuration, over the same written candidates."""
    out = None
    for c in grid:
        m = metrics.aggregate(metrics.per_query(ranking(dense, sparse, c), judgments)).select(F.lit(c.name).alias("config"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def best(results: DataFrame) -> DataFrame:
    """The configuration with the best (ndcg, mrr, coverage, recall), by name among equals."""
    return results.orderBy(F.desc("ndcg"), F.desc("mrr"), F.desc("coverage"), F.desc("recall_at_10"), "config").limit(1)
