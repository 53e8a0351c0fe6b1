import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexweave.operators import dense, fusion, metrics, sparse
from lexweave.plans import hybrid

WORD = re.compile(r"[^\W_]+")


def test_bm25_against_plain_scores(spark):
    r = random.Random(5)
    vocab = [f"từ{i}" for i in range(30)] + ["Straße", "và"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 40)))) for i in range(60)] + [(100, None), (101, "  "), (102, "!!! ..."), (103, "STRASSE và và")]
    queries = [("q1", "từ1 từ2 từ2"), ("q2", "strasse"), ("q3", "... "), ("q4", None), ("q5", "không có"), (None, "từ1")]
    tok = lambda t: WORD.findall((t or "").lower().replace("ß", "ss"))
    d = {i: tok(t) for i, t in docs if tok(t)}
    n, avg = len(d), sum(map(len, d.values())) / len(d)
    df = Counter(w for t in d.values() for w in set(t))
    want = set()
    for q, text in queries:
        s = []
        for i, t in d.items():
            x = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, f in Counter(tok(text)).items() if w in t)
            if x > 0:
                s.append((-round(x, 6), i))
        want |= {(q, i, k, -x) for k, (x, i) in enumerate(sorted(s)[:5], 1) if q}
    df_ = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).withColumn("rank", F.lit(1)).withColumn("tokens", F.lit(2))
    got = sparse.bm25_topk(df_, spark.createDataFrame(queries, "id string, query string"), 5)
    assert {(x["query_id"], x["doc_id"], x["rank"], x["score"]) for x in got.collect()} == want
    assert sparse.bm25_topk(df_.limit(0), spark.createDataFrame(queries, "id string, query string")).count() == 0


def test_dense_is_exact(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(80)] + [(200, None), (201, [float("nan")] * 8), (202, [1.0])] + [(300, [1.0] * 8), (301, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = dense.dense_topk(df, df.where("vec_id in (3, 300)"), 4).collect()
    norm = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    ok = {i: norm(v) for i, v in rows if v and len(v) == 8 and i != 201}
    for q in (3, 300):
        best = sorted((-round(sum(a * b for a, b in zip(ok[q], v)), 6), i) for i, v in ok.items() if i != q)[:4]
        assert [(x["doc_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == [(i, -s) for s, i in best]
    assert dense.dense_topk(df.limit(0), df, 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id int, rank int, score double")


def test_fusion_and_quotas(spark):
    d = hits(spark, [(1, i, i, 1.0 / i) for i in range(1, 9)] + [(1, 3, 9, 0.1), (1, None, 1, 2.0)])
    s = hits(spark, [(1, 20 - i, i, 10.0 - i) for i in range(1, 9)] + [(1, 2, 9, 0.5), (2, 7, 1, 1.0)])
    f = fusion.fuse(d, s, sparse_weight=1.5)
    top = {x["doc_id"]: x for x in f.where("query_id = 1").collect()}
    assert top[2]["fused"] == round(1 / 62 + 1.5 / 69, 9) and top[3]["dense_rank"] == 3
    got = [x["doc_id"] for x in fusion.select_with_quotas(f.where("query_id = 1"), 6, 2, 2, 1).orderBy("rank").collect()]
    order = [x["doc_id"] for x in fusion.top_fused(f.where("query_id = 1"), 99).orderBy("rank").collect()]
    want = order[:2]
    want += [x for x in [19, 18, 17, 16, 15, 14, 13, 12, 2] if x not in want][:2]
    want += [x for x in range(1, 9) if x not in want][:1]
    want += [x for x in order if x not in want][: 6 - len(want)]
    assert got == want
    fb = fusion.with_fallback(d.where("rank <= 2"), s.where("rank <= 2")).collect()
    assert {(x["query_id"], x["fallback"]) for x in fb} == {(1, False), (2, True)}


def test_diversity_and_rerank(spark):
    f = spark.createDataFrame([(1, i, i, None, 1 - i / 1000, "a" if i < 5 else None) for i in range(1, 8)], "query_id int, doc_id int, dense_rank int, sparse_rank int, fused double, law string")
    got = [x["doc_id"] for x in fusion.select_diverse(f, 4, "law", penalty=0.5).orderBy("rank").collect()]
    assert got == [1, 5, 6, 7]
    r = fusion.rerank(f, hits(spark, [(1, 7, 1, 5.0), (1, 6, 2, 1.0)]), 2).orderBy("rank").collect()
    assert r[0]["doc_id"] == 7 and r[0]["mixed"] == 0.7


def test_metrics(spark):
    rank = hits(spark, [(1, 10, 1, 0.0), (1, 11, 2, 0.0), (1, 12, 3, 0.0), (2, 10, 1, 0.0)]).select("query_id", "doc_id", "rank")
    j = spark.createDataFrame([(1, 11, 3), (1, 12, 1), (1, 99, 2), (3, 1, 3), (1, 11, 2)], "query_id int, doc_id int, gain int")
    c = {x["query_id"]: x for x in metrics.per_query(rank, j).collect()}
    dcg, ideal = 3 / math.log2(3) + 1 / math.log2(4), 3 + 2 / math.log2(3) + 1 / 2
    assert set(c) == {1, 3} and c[1]["rr"] == 0.5 and c[1]["recall_at_1"] == 0 and c[1]["recall_at_3"] == 1 and c[1]["ndcg"] == round(dcg / ideal, 6) and c[3]["ndcg"] == 0
    a = metrics.aggregate(metrics.per_query(rank, j)).first()
    assert a["n_queries"] == 2 and a["mrr"] == 0.25 and a["coverage"] == round(1 / 3, 6)
    b = metrics.breakdowns(metrics.per_query(rank, j).withColumn("kind", F.lit(None).cast("string")).withColumn("tags", F.expr("if(query_id = 1, array('x', 'y'), array())")), ["kind"], ["tags"]).collect()
    assert {(x["dimension"], x["value"], x["n_queries"]) for x in b} == {("kind", "unknown", 2), ("tags", "x", 1), ("tags", "y", 1), ("tags", "unknown", 1)}


def test_best_configuration(spark):
    j = spark.createDataFrame([(1, 11, 3)], "query_id int, doc_id int, gain int")
    d, s = hits(spark, [(1, 10, 1, 1.0)]), hits(spark, [(1, 11, 1, 1.0)])
    assert hybrid.best(hybrid.ablation(d, s, j)).first()["config"] in {"rrf_0_1", "quota_4_3_3", "quota_5_4_1", "quota_6_2_2", "rrf_1_1.5"}


def test_many_query_sets_in_one_scan(spark, monkeypatch):
    import random

    from lexweave.operators import dense, sparse

    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([1, 5, 30])))) for i in range(300)], "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(f"w{r.randrange(50)}" for _ in range(4))) for i in range(57)], "id int, query string")
    vecs = spark.createDataFrame([(i, [float(r.choice([0, 1, 2])) + 0.1 for _ in range(3)]) for i in range(200)] + [(900, None), (901, [float("nan")] * 3), (902, [1.0])], "vec_id int, embedding array<double>").repartition(3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(sparse.bm25_topk(docs, asked)), rows(dense.dense_topk(vecs, vecs.where("vec_id < 60"), 7))
    for kept, size in ((0, 5_000_000), (8_000_000, 60)):
        monkeypatch.setattr(sparse, "KEPT_WEIGHTS", kept)
        monkeypatch.setattr(sparse, "SCAN_WORDS", size)
        monkeypatch.setattr(sparse, "QUERIES_PER_PASS", 10)
        monkeypatch.setattr(dense, "QUERIES_PER_PASS", 10)
        assert (rows(sparse.bm25_topk(docs, asked)), rows(dense.dense_topk(vecs, vecs.where("vec_id < 60"), 7))) == whole
    plan = dense.dense_topk(vecs, vecs.where("vec_id < 60"), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
