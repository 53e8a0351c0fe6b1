import math

from pyspark.sql import functions as F

from lexweave.operators import readiness


def test_vectors(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([1.0, math.nan],), ([1.0, math.inf],), ([1.0, None],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = {r["filter"]: r["n"] for r in readiness.filter_counts(df, readiness.vector_checks("v", 2)).collect()}
    assert got == {"VECTOR_MISSING": 2, "VECTOR_DIMENSION": 1, "VECTOR_NOT_FINITE": 3, "VECTOR_ZERO": 1}
    none = readiness.filter_counts(df.limit(0), readiness.vector_checks("v", 2)).collect()
    assert len(none) == 4 and all(r["n"] == 0 and r["empty"] for r in none)


def test_coverages(spark):
    g = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "b", 3), (2, "c", 4), (2, None, 5)], "query_id int, group_id string, doc_id int")
    s = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (3, 4)], "query_id int, doc_id int")
    assert {tuple(r) for r in readiness.group_coverage(g, s).collect()} == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}
    h = spark.createDataFrame([("q", "x", None), ("q", " ", "y"), ("r", None, None)], "k string, a string, b string")
    assert {tuple(r) for r in readiness.completeness(h, "k", ["a", "b"]).collect()} == {("q", 2, 0.5), ("r", 1, 0.0)}


def test_duplicate_texts(spark):
    df = spark.createDataFrame([(1, "Đò ngang."), (2, "đò NGANG"), (3, "đo ngang"), (4, "khác"), (5, None), (6, " "), (None, "khác"), (7, "!!")], "k int, t string").selectExpr("*", "1 AS same")
    assert {tuple(r) for r in readiness.duplicate_texts(df, "k", "t").collect()} == {("SAME_TEXT", "đò ngang", 2, 1, 1), ("SAME_WITHOUT_MARKS", "đo ngang", 3, 2, 1)}


def test_report_and_status(spark):
    df = spark.createDataFrame([("x", "p", 3), ("x", None, None), (None, "p", 5)], "a string, b string, n int")
    got = {(r["a"], r["b"]): (r["n_rows"], r["s"]) for r in readiness.count_report(df, ["a", "b"], {"s": F.col("n")}).collect()}
    assert got == {("x", "p"): (1, 3), ("x", "unknown"): (1, 0), ("unknown", "p"): (1, 5), ("x", "*"): (2, 3), ("unknown", "*"): (1, 5), ("*", "*"): (3, 8)}
    issues = spark.createDataFrame([("HARD", 2), ("SOFT", 3)], "code string, n bigint")
    say = lambda i, n: tuple(readiness.readiness(i, ["HARD"], n).first())
    assert say(issues, 5) == ("blocked", 2, 3) and say(issues.where("code = 'SOFT'"), 5) == ("ready_with_warnings", 0, 3)
    assert say(issues.limit(0), 5) == ("ready", 0, 0) and say(issues.limit(0), 0)[0] == "blocked"


def test_texts(spark):
    df = spark.createDataFrame([(1, "Đ iều 1. Kho  ản 2 và Điều 3"), (2, None), (3, "Câu một. Câu hai!\n\n- Câu ba: 1.5 ha? Hết")], "k int, t string")
    got = {r["k"]: (r["n"], r["c"], r["p"]) for r in df.select("k", readiness.torn_words("t").alias("n"), readiness.claims("t").alias("c"), readiness.phrases_in("t", ["CÂU hai", "vắng"]).alias("p")).collect()}
    assert got == {1: (2, ["Đ iều 1.", "Kho  ản 2 và Điều 3"], []), 2: (0, [], []), 3: (0, ["Câu một.", "Câu hai!", "- Câu ba: 1.5 ha?", "Hết"], ["CÂU hai"])}


def test_hints_and_common_keys(spark):
    hits = spark.createDataFrame([(1, "Lệ  phí Bến đò"), (1, "giấy phép"), (2, None)], "query_id int, t string")
    hints = spark.createDataFrame([(1, "bến đò"), (1, "GIẤY phép"), (1, " "), (2, "x"), (3, "y")], "query_id int, hint string")
    assert {tuple(r) for r in readiness.hints_met(hits, hints, "t").collect()} == {(1, 2, 2, True), (2, 1, 0, False), (3, 1, 0, False)}
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["p", "p", "q", None], ["p", None, "r"]))
    assert [r["k"] for r in readiness.common_keys(a, b, "k").collect()] == ["p"]
