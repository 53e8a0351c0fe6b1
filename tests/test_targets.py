import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import audit, chunking, diagnostics, fingerprint, fusion, indexing, targets
from lexweave.streaming import rate

PROVISION = "law_id string, article_number string, clause_number string, point_label string"


def greedy(rows, k, penalty):
    """The choice by its definition, over all candidates."""
    left, chosen = list(rows), []
    while left and len(chosen) < k:

        def key(r):
            n = sum(1 for c in chosen if c["g"] == r["g"]) if r["g"] is not None else 0
            off = penalty * n
            if n and r["d"] is not None and all((c["g"], c["d"]) != (r["g"], r["d"]) for c in chosen):
                off = max(0.0, off - penalty / 2)
            inf = float("inf")
            return (-(r["fused"] - off), inf if r["dense"] is None else r["dense"], inf if r["sparse"] is None else r["sparse"], r["doc"])

        best = min(left, key=key)
        left.remove(best)
        chosen.append(best)
    return [r["doc"] for r in chosen]


def test_diversity_over_all_candidates(spark):
    r = random.Random(5)
    rows, want = [], {}
    for q in range(6):
        n = r.choice([1, 12, 300])
        own = [{"doc": i, "dense": r.choice([None, i]), "sparse": r.choice([None, n - i]), "fused": round(r.choice([0.01, 0.02, 0.03]) + r.random() / 200, 4), "g": r.choice(["a", "b", "c", None]), "d": r.choice(["1", "2", None])} for i in range(n)]
        want[q] = greedy(own, 10, 0.01)
        rows += [(q, x["doc"], x["dense"], x["sparse"], x["fused"], x["g"], x["d"]) for x in own]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, dense_rank int, sparse_rank int, fused double, g string, d string")
    got = {}
    for x in fusion.select_diverse(df, 10, ["g"], 0.01, ["d"]).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["doc_id"])
    assert got == want
    # The 250th candidate wins once the rest of the list is of one group.
    many = spark.createDataFrame([(1, i, i, None, 1 - i / 10_000, "a" if i < 250 else "b") for i in range(1, 260)], df.select("query_id", "doc_id", "dense_rank", "sparse_rank", "fused", "g").schema)
    assert [x["doc_id"] for x in fusion.select_diverse(many, 2, "g", 0.5).orderBy("rank").collect()] == [1, 250]
    assert fusion.select_diverse(many.limit(0), 2, "g").count() == 0
    with pytest.raises(ValueError):
        fusion.select_diverse(many, 0, "g")


def test_rerank_quotas(spark):
    rows = [(1, i, i if i % 2 else None, i if i < 3 else None, 1 - i / 100) for i in range(1, 9)]
    c = spark.createDataFrame(rows, "query_id int, doc_id int, dense_rank int, sparse_rank int, fused double")
    s = spark.createDataFrame([(1, i, float(i)) for i in range(1, 9)], "query_id int, doc_id int, score double")
    got = {x["doc_id"]: x["by_quota"] for x in fusion.rerank_with_quotas(c, s, 4, 2, 3).collect()}
    assert got == {1: True, 2: True, 7: True, 5: True}
    assert [x["doc_id"] for x in fusion.rerank_with_quotas(c, s, 3, 0, 0).orderBy("rank").collect()] == [8, 7, 6]
    assert fusion.rerank_with_quotas(c.limit(0), s, 3, 1, 1).count() == 0


def test_target_ranks(spark):
    t = spark.createDataFrame([("q", "t1", "article", " L1 ", "5", None, None), ("q", "t2", "clause", "l1", "5", "2", None), ("q", "t3", "point", "L1", "5", "2", "a"), ("q", "t4", "point", "L1", "9", None, None), ("r", "t5", "article", None, "5", None, None)], f"query_id string, target_id string, match_level string, {PROVISION}")
    h = spark.createDataFrame([("q", 1, "L1", "5", "1", None), ("q", 2, "L1", "5", "2", "B"), ("q", 3, "L1", "5", "2", "A"), ("r", 1, None, "5", None, None)], f"query_id string, rank int, {PROVISION}")
    got = {x["target_id"]: tuple(x)[3:] for x in targets.match_ranks(t, h).collect()}
    assert got == {"t1": (1, None, None, 1, "article"), "t2": (1, 2, None, 2, "clause"), "t3": (1, 2, 3, 3, "point"), "t4": (None,) * 5, "t5": (None,) * 5}
    best = {x["query_id"]: tuple(x)[1:] for x in targets.best_by_level(targets.match_ranks(t, h)).collect()}
    assert best == {"q": (4, 3, 1, 2, 3, 1, "article"), "r": (1, 0, None, None, None, None, None)}
    assert targets.match_ranks(t.limit(0), h).count() == 0


def test_target_and_group_chunks(spark):
    t = spark.createDataFrame([("g1", "t1", "clause", "L", "5", None, None), ("g1", "t2", "point", "L", "5", "2", "a")], f"group_id string, target_id string, match_level string, {PROVISION}")
    c = spark.createDataFrame([("c1", "L", "5", None, None), ("c2", "L", "5", "2", "a"), ("c3", "L", "5", "2", None), ("c4", "M", "5", None, None)], f"chunk_id string, {PROVISION}")
    assert {tuple(x) for x in targets.target_chunks(t, c).collect()} == {("t1", "c1"), ("t2", "c2")}
    g = spark.createDataFrame([("g1", ["c4"]), ("g2", ["c4", "c9"]), ("g3", None)], "group_id string, chunk_ids array<string>")
    assert {tuple(x) for x in targets.group_chunks(g, t, c).collect()} == {("g1", "c1"), ("g1", "c2"), ("g2", "c4")}
    q = spark.createDataFrame([("q", True), ("r", True), ("s", False)], "query_id string, ok boolean")
    own = spark.createDataFrame([("q", "t2"), ("q", "t1"), ("q", "t1"), ("s", "t1")], "query_id string, target_id string")
    assert {x["query_id"]: x["targets"] for x in targets.expected_targets(q, own, F.col("ok")).collect()} == {"q": ["t1", "t2"], "r": None, "s": []}


def test_overlaps_and_groups(spark):
    pairs = lambda *rows: spark.createDataFrame(list(rows), "query_id int, doc_id int")
    q = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 5)], "query_id int")
    cases = diagnostics.overlaps(pairs((1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (4, None)), pairs((1, 1), (2, 2), (3, 1), (5, 1)), pairs((1, 1), (3, 2), (4, 1), (4, 1)), q)
    got = {x["query_id"]: (x["n_missed"], x["outcome"]) for x in cases.collect()}
    o = diagnostics.OUTCOMES
    assert got == {1: (0, o[2]), 2: (0, o[1]), 3: (1, o[3]), 4: (0, o[1]), 5: (0, o[0])}
    assert {x["outcome"]: x["n"] for x in diagnostics.outcome_counts(cases).collect()} == {o[0]: 1, o[1]: 2, o[2]: 1, o[3]: 1, diagnostics.EMPTY: 2}
    assert tuple(diagnostics.mode(cases, "outcome", [o[1]]).first()) == (o[3], 1)
    assert diagnostics.mode(cases.limit(0), "outcome").count() == 0
    tagged = cases.withColumn("kind", F.when(F.col("query_id") < 3, "x")).withColumn("tags", F.expr("if(query_id = 3, array('a', 'b', 'a'), array())"))
    rows = diagnostics.group_summary(tagged, ["kind"], ["tags"])
    assert {(x["dimension"], x["value"], x["n_cases"], x["n_missed_cases"]) for x in rows.collect()} == {("kind", "x", 2, 0), ("kind", "unknown", 3, 1), ("tags", "a", 1, 1), ("tags", "b", 1, 1), ("tags", "unknown", 4, 0)}
    assert [x["value"] for x in diagnostics.top_groups(rows, "dimension", [F.desc("missed_rate"), F.asc("value")], 1).orderBy("dimension").collect()] == ["unknown", "a"]


def test_payloads(spark):
    cols = ", ".join(f"{c} string" for c in indexing.PAYLOAD)
    blank = {c: f" {c} " for c in indexing.PAYLOAD} | {"chunk_id": " ", "citation": None, "text": "\n \t"}
    df = spark.createDataFrame([tuple(blank[c] for c in indexing.PAYLOAD)], cols).selectExpr("*", "map('a', 'b') AS metadata", "array('w') AS warnings", "'p1' AS point", "7 AS rank")
    r = indexing.hits_of(df, "point").first()
    assert (r["chunk_id"], r["law_id"], r["text"], r["issues"], r["rank"]) == ("p1", "law_id", None, ["chunk_id", "citation", "text"], 7)
    assert indexing.hits_of(df).first()["chunk_id"] is None
    p = indexing.vector_payload(df, "m", "run").first()
    assert (p["law_id"], p["status"], p["domain_tags"], p["embedding_revision"]) == (" law_id ", None, [], None)
    for bad in ({"model": " ", "run_id": "r"}, {"model": "m", "run_id": ""}, {"model": "m", "run_id": "r", "revision": " "}):
        with pytest.raises(ValueError):
            indexing.vector_payload(df, **bad)
    assert indexing.schema_differences(df, {"text": "string", "rank": "bigint", "gone": "int"}) == [("rank", "bigint", "int"), ("gone", "int", "")]


def test_fingerprints_in_order(spark):
    rows = [("a", 1), ("b", 2), (None, 3)]
    one = lambda rs: fingerprint.ordered_fingerprint(spark.createDataFrame(rs, "x string, n int"), "n").first()["fingerprint"]
    assert one(rows) == one(rows[::-1]) and len({one([(x, n) for x, n in zip(p, (1, 2, 3))]) for p in itertools.permutations(["a", "b", None])}) == 6
    m = {"b": [1, "đ"], "a": None, "own": "x"}
    assert fingerprint.manifest_hash(m, "own") == fingerprint.manifest_hash({**m, "own": "y"}, "own") != fingerprint.manifest_hash({**m, "a": 1}, "own")


def test_paced_starts(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b"]), i, r.randrange(30)) for i in range(60)] + [(None, 99, 1)]
    df = spark.createDataFrame(rows, "host string, id int, s int").selectExpr("*", "timestamp_seconds(s) AS at", "1 AS key", "2 AS i")
    want, last = {}, {}
    for h, i, s in sorted((x for x in rows if x[0]), key=lambda x: (x[0], x[2], x[1])):
        start = max(s * 1_000_000, last.get(h, -(1 << 60)) + 1_500_000)
        want[i] = last[h] = start
    assert {x["event_id"]: x["start"] for x in rate.paced(df, 1.5, "host", "id", "at").collect()} == want


def test_suspicious_text_and_positions(spark):
    good = "Chương I\n" + "\n".join(f"Điều {i}. Một điều có tên dài vừa đủ số {i}" for i in range(1, 200))
    df = spark.createDataFrame([(1, good), (2, "Trang chủ\n" + "dòng lặp lại nhiều lần\n" * 50 + "Bản quyền"), (3, None), (4, "")], "k int, t string")
    got = {x["k"]: (x["f"], x["p"]) for x in df.select("k", audit.suspicious_flags("t", ["trang CHỦ"], ["bản quyền"]).alias("f"), audit.first_position("t", ["Điều 1\\.", "Chương"]).alias("p")).collect()}
    bare = ["short_normalized_text", "missing_article_headings", "missing_article_1_heading"]
    assert got == {1: ([], 0), 2: ([*bare, "high_duplicate_line_ratio", "possible_wrong_start", "possible_wrong_end"], None), 3: (bare, None), 4: (bare, None)}


def test_warnings_of_chunks(spark):
    c = spark.createDataFrame([("c1", "n1", "a1", "clause", False), ("c2", "a1", "a1", "article", True), ("c3", None, None, "article", None)], "chunk_id string, source_node_id string, parent_article_node_id string, level string, is_empty_or_repealed boolean")
    i = spark.createDataFrame([("n1", "X"), ("a1", "Y"), ("a1", "Y"), (None, "Z")], "node_id string, code string")
    assert {tuple(map(str, x)) for x in chunking.source_warnings(c, i).collect()} == {("c1", "['X', 'Y']", "['X:n1', 'Y:a1']"), ("c2", "['Y']", "['Y:a1']")}
    assert [tuple(x) for x in chunking.empty_article_warnings(c).collect()] == [("c2", "EMPTY_ARTICLE_CHUNK", "a1")]
