import random
import re

import numpy as np
import pytest

from lexweave.llm import canonical, neardup

SCORES = canonical.log_scores(np.ones(len(canonical.ALPHABET) ** 2))


def brute(rows, t, k, least):
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\W_]+", canonical.canonical(x, SCORES).lower()) if x else []
        if i is not None and len(w) >= max(least, k):
            sets.setdefault(" ".join(w), [set(zip(*(w[j:] for j in range(k)))), []])[1].append(i)
    keys = sorted(sets)
    out = set()
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]][0], sets[keys[b]][0]
            if len(x & y) >= t * len(x | y) - 1e-12:
                out.add(tuple(sorted((min(sets[keys[a]][1]), min(sets[keys[b]][1])))))
    return out, {i: min(ids) for _, ids in sets.values() for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([20, 30, 45, 80, 200]))]
        rows.append((f"d{i:03d}", " ".join(base)))
        for j in range(r.choice([0, 0, 1, 2])):
            e = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                p = r.randrange(len(e))
                e[p : p + r.choice([0, 1])] = [r.choice(vocab)]
            rows.append((f"d{i:03d}_{j}", "  ".join(e).upper() if j else "，".join(e)))
    return rows + rows[:4] + [("n", None), ("e", ""), (None, rows[0][1]), ("short", "một hai"), ("same", "a " * 30), ("same2", "A, " * 30), ("long", "x y z " * 30_000)]


@pytest.mark.parametrize("signature", ["minhash", "sets"])
@pytest.mark.parametrize("t,k", [(0.6, 3), (0.8, 5)])
def test_against_all_pairs(spark, signature, t, k):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3).selectExpr("*", "1 AS id", "2 AS c1", "3 AS shingles", "4 AS key")
    members, pairs = neardup.near_duplicates(df, SCORES, threshold=t, shingle=k, min_words=20, signature=signature)
    want, classes = brute(rows, t, k, 20)
    assert {(r["id"], r["class_id"]) for r in members.collect()} == set(classes.items())
    got = pairs.collect()
    assert {(r["class_a"], r["class_b"]) for r in got} == want and len(got) == len(want)


def test_set_signature_bound_holds_for_all_sizes():
    p = neardup.Plan(0.6)
    for n in (1, 2, 5, 17, 60, 400):
        for m in range(n, int(n / 0.6) + 1):
            least = next(c for c in range(n + 1) if c >= 0.6 * (n + m - c) - 1e-9)
            assert int(p.differ(np.array([n]), np.array([m]))[0]) == n + m - 2 * least


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    members, pairs = neardup.near_duplicates(df, SCORES)
    assert members.count() == 0 and pairs.count() == 0
