import random

from lexweave.operators import hierarchy
from lexweave.operators.graph import connected_components


def brute(rows):
    """(root, path, fault) of each node by plain walks."""
    up = {}
    for n, p in rows:
        n, p = (n or "").strip(), (p or "").strip() or None
        if n:
            up[n] = min(x for x in (up.get(n), p) if x) if (up.get(n) or p) else None
    out = {}
    for n in up:
        seen, k = [], n
        while True:
            if k in seen:
                out[n] = (None, None, "on_cycle" if k == n else "under_cycle")
                break
            if k not in up:
                out[n] = (None, None, "lost")
                break
            seen.append(k)
            if up[k] is None:
                out[n] = (k, seen[::-1], None)
                break
            k = up[k]
    return out


def forest(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        p = None if i % 37 == 0 else f"n{r.randrange(max(1, i - 40), i + 1) if r.random() < 0.97 else r.randrange(n + 20)}"
        rows.append((f"n{i}", p, f"f{i // 50}"))
    rows += [(f" n{i} ", f" n{i - 1} ", "f0") for i in range(5, 8)] + rows[:20]
    rows += [(None, "n1", "f1"), ("  ", None, "f1"), ("solo", "", None), ("ring", "ring", "f2")]
    r.shuffle(rows)
    return rows


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "node_id string, parent_id string, source_file string").selectExpr("*", "1 AS depth", "'x' AS component", "'y' AS parent")
    got = {r["node_id"]: r for r in hierarchy.hierarchy(df, **how).collect()}
    want = brute([(a, b) for a, b, _ in rows])
    assert set(got) == set(want)
    for n, (root, path, fault) in want.items():
        assert (got[n]["root_id"], got[n]["path"], got[n]["fault"]) == (root, path, fault), n
        if path:
            assert got[n]["depth"] == len(path) - 1
            assert got[n]["n_descendants"] == sum(1 for _, p, _ in want.values() if p and n in p[:-1])


def test_matches_plain_walks(spark):
    check(spark, forest(1))


def test_large_components_by_doubling(spark):
    check(spark, forest(2, 200), max_component=3)


def test_both_branches_count_below_faulty_nodes(spark):
    rows = forest(5, 120) + [("l0", "gone", "f9"), *((f"l{i}", f"l{(i - 1) // 2}", "f9") for i in range(1, 12)), ("r0", "r1", "f9"), ("r1", "r0", "f9"), ("r2", "r1", "f9"), ("r3", "r2", "f9")]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, source_file string")
    small, large = ({r["node_id"]: tuple(r) for r in hierarchy.hierarchy(df, max_component=n).collect()} for n in (hierarchy.MAX_COMPONENT, 3))
    assert large == small
    k = hierarchy.TREE.split(", ").index("n_descendants bigint")
    assert large["l0"][k] == 11 and large["l11"][k] == 0 and large["r1"][k] is None and large["r2"][k] is None


def test_descendants_of_faulty_nodes(spark):
    rows = [("a", None), ("b", "a"), ("l0", "gone"), ("l1", "l0"), ("l2", "l1"), ("l3", "l2"), ("x", "y"), ("y", "z"), ("z", "x"), ("u", "x"), ("v", "u"), ("w", "v"), ("o", "o"), ("p", "o")]
    up = dict(rows)
    want = set()
    for n in up:
        k, seen = n, [n]
        while (k := up.get(k)) in up and k not in seen:
            want.add((k, n, len(seen)))
            seen.append(k)
    df = spark.createDataFrame([(*r, "f") for r in rows], "node_id string, parent_id string, source_file string")
    got = [tuple(r) for r in hierarchy.descendants(hierarchy.hierarchy(df)).collect()]
    assert sorted(got) == sorted(want) and ("l0", "l3", 3) in want and ("u", "w", 2) in want and ("y", "w", 4) in want


def test_deep_chain(spark):
    check(spark, [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, f"f{i % 3}") for i in range(1500)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "node_id string, parent_id string, source_file string")
    t = hierarchy.hierarchy(df)
    assert t.count() == 0 and hierarchy.descendants(t).count() == 0


def test_contraction_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK_ROWS", 7)
    check(spark, forest(3, 120))


def test_components(spark):
    r = random.Random(4)
    e = [(f"a{r.randrange(150)}", f"a{r.randrange(150)}") for _ in range(110)] + [(None, "a1"), ("z", "z")]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        if a and b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert got == {n: top(n) for n in up}


def test_cycles_as_rows(spark):
    rows = [("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("s", "s"), ("x", "y"), ("y", "x"), ("r", None), ("l", "gone")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "node_id string, parent_id string, source_file string")
    want = {("a", "a", 0, "c", False), ("a", "c", 1, "b", False), ("a", "b", 2, "a", True), ("s", "s", 0, "s", True), ("x", "x", 0, "y", False), ("x", "y", 1, "x", True)}
    for size in (hierarchy.MAX_COMPONENT, 1):
        assert {tuple(r) for r in hierarchy.cycles(hierarchy.hierarchy(df, max_component=size, paths=False)).collect()} == want
    assert hierarchy.cycles(hierarchy.hierarchy(df.limit(0))).count() == 0


def test_long_chain_holds_no_path_for_each_node():
    import tracemalloc

    n = 200_000
    ids = [f"n{k}" for k in range(n)]
    rows = hierarchy.traverse(ids, [None, *ids[:-1]], [False] * n, paths=False)
    assert sum(1 for r in rows if r[3] is not None) == n
    # With paths a row's path exists only while the row is in hand.
    tracemalloc.start()
    for k, row in enumerate(hierarchy.traverse(ids[:5000], [None, *ids[:4999]], [False] * 5000)):
        assert len(row[4]) == k + 1
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
