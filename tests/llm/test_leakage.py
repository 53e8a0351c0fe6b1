import random
import re

import numpy as np

from lexweave.llm import canonical, leakage

SCORES = canonical.log_scores(np.ones(len(canonical.ALPHABET) ** 2))


def words(t):
    return re.findall(r"[^\W_]+", canonical.canonical(t, SCORES).lower()) if t else []


def brute(docs, items, run):
    grams = {}
    for i, q, a in items:
        for t in (q, a):
            w = words(t)
            for k in range(len(w) - run + 1):
                grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ()) if i and d is not None}
    return out


def make(seed):
    r = random.Random(seed)
    vocab = [f"từ{i}" for i in range(25)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(f"q{i}", " ".join(text(r.choice([5, 12, 40]))), " ".join(text(30)) if i % 3 else None) for i in range(40)]
    docs = []
    for d in range(150):
        w = text(60)
        src = words(r.choice(items)[r.choice([1, 2])])
        if src and r.random() < 0.5:
            n = r.choice([6, 11, 12, 13, 30])
            a = r.randrange(max(1, len(src) - n))
            w[20:20] = src[a : a + n]
        docs.append((d, r.choice([" ", "\n", ", ", " "]).join(w).upper() if d % 2 else " ".join(w)))
    return docs + docs[:5] + [(900, None), (901, ""), (None, docs[0][1]), (902, "x " * 200_000 + items[5][1])], items + items[:3] + [(None, docs[0][1], None)]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS item_id", "2 AS id"), spark.createDataFrame(items, "id string, query string, reference_answer string").selectExpr("*", "1 AS text", "2 AS f0")


def test_against_plain_search(spark):
    docs, items = make(1)
    d, i = frames(spark, docs, items)
    for run in (12, 5, 3):
        assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i, SCORES, run).collect()} == brute(docs, items, run)


def test_several_index_sets(spark, monkeypatch):
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 7)
    docs, items = make(2)
    d, i = frames(spark, docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i, SCORES).collect()} == brute(docs, items, 12)


def test_empty_tables(spark):
    d, i = frames(spark, *make(1))
    assert leakage.find_leaks(d.limit(0), i, SCORES).count() == 0 and leakage.find_leaks(d, i.limit(0), SCORES).count() == 0


def test_fields_and_one_scan(spark, monkeypatch):
    docs, items = make(4)
    d, i = frames(spark, docs, items)
    want = {}
    for field, at in (("query", 1), ("reference_answer", 2)):
        for doc, item in brute(docs, [(x[0], x[at], None) for x in items], 12):
            want[doc, item] = want.get((doc, item), set()) | {field}
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 7)
    df = leakage.find_leak_fields(d, i, SCORES)
    got = {}
    for r in df.collect():
        got.setdefault((r["doc_id"], r["item_id"]), set()).add(r["field"])
        assert r["n_passages"] >= 1
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # six indexes, one pass over the documents
    monkeypatch.setattr(leakage, "SCAN_BYTES", 1)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i, SCORES).collect()} == set(want)


def test_wand_gives_all_items_at_the_threshold(monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 3)
    r = random.Random(6)
    texts = [np.array([r.randrange(30) for _ in range(r.choice([3, 6, 20]))], np.uint64) for _ in range(80)]
    sizes = np.array([len(t) for t in texts])
    ix = leakage.ItemIndex([str(k) for k in range(40)], np.concatenate(texts), sizes, np.arange(80) // 2, np.arange(80) % 2, 4)
    for _ in range(300):
        terms = sorted({r.randrange(len(ix.hashes) + 1) for _ in range(r.choice([1, 2, 5, 9]))})
        score = {}
        for t in terms:
            for k in range(ix.start[t], ix.start[t + 1]):
                score[int(ix.item[k])] = score.get(int(ix.item[k]), 0) + ix.impact[k]
        assert sorted(ix.wand(terms)) == sorted(k for k, x in score.items() if x >= leakage.NEARLY)
