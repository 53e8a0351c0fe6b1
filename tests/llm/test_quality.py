import numpy as np
import pytest

from lexweave.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    fit = labels.where("xxhash64(doc_id) % 2 = 0")
    held = labels.where("xxhash64(doc_id) % 2 <> 0")
    m = quality.fit_labels(docs, fit)
    got = quality.classify(docs.join(held.select("doc_id"), "doc_id"), m).select("doc_id", "kind").join(held.withColumnRenamed("kind", "true"), "doc_id").collect()
    right = sum(r["kind"] == r["true"] for r in got)
    assert len(got) > 300 and right / len(got) > 0.97


def test_contributions_add_up(spark, tables):
    docs, labels = tables
    m = quality.fit_labels(docs, labels, max_labels=200)
    for r in quality.classify(docs.limit(50), m).collect():
        assert len(r["stats"]) == len(quality.STATS) == len(r["contributions"]) and abs(sum(r["contributions"]) - r["distance"]) < 1e-6 * max(1, abs(r["distance"]))


def test_odd_rows(spark, tables):
    docs, labels = tables
    m = quality.fit_labels(docs, labels)
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "."), (5, "x"), (5, "x"), (6, "từ " * 300_000), (7, "​"), (None, "x")], "doc_id bigint, text string").selectExpr("*", "1 AS kind", "2 AS lang", "3 AS stats")
    got = quality.classify(df, m).collect()
    assert sorted(r["doc_id"] for r in got) == [4, 5, 5, 6, 7] and all(np.isfinite(r["distance"]) for r in got)
    assert quality.classify(df.limit(0), m).count() == 0


def test_fit_needs_prose_and_does_with_few_rows():
    with pytest.raises(ValueError):
        quality.fit(["vi"], np.zeros((1, len(quality.STATS))), ["list"])
    x = np.random.default_rng(1).normal(size=(12, len(quality.STATS)))
    x[10:] += 50
    m = quality.fit(["vi"] * 12, x, ["prose"] * 10 + ["list", "table"])
    assert m.judge(["vi"], x[:1])[1] == ["prose"] and m.judge(["xx"], x[10:11])[1] == ["list"]


def test_robust_fit_ignores_a_tenth_of_outliers():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(180, 3)), 40 + r.normal(size=(20, 3))])
    mid, inv = quality.robust_fit(x)
    assert np.abs(mid).max() < 0.4


def test_statistics():
    lang, s = quality.statistics("Các bên cho rằng việc này là của người khác.\nNếu không thì thôi.")
    v = dict(zip(quality.STATS, s))
    assert lang == "vi" and v["end_punct_share"] == 1 and v["digit_share"] == 0 and round(np.expm1(v["word_count"])) == 14
