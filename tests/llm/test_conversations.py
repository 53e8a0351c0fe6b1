import random

from lexweave.llm import conversations


def brute(msgs, convs):
    one = {}
    for m in sorted(msgs, key=lambda m: m[4]):
        one.setdefault(m[0], m)
    by = {}
    for i, c, r, t, at in one.values():
        if c is not None and t is not None and t.strip(" \t\r\n") and (r or "").strip().lower() != "system":
            by.setdefault(c, []).append((at, i, (r or "").strip().lower()))
    bad = set()
    for c in set(convs) | {m[1] for m in msgs if m[1] is not None}:
        roles = [r for _, _, r in sorted(by.get(c, []))]
        if c not in convs or len(roles) < 2 or len(roles) % 2 or any(r != ("user", "assistant")[k % 2] for k, r in enumerate(roles)):
            bad.add(c)
    return bad


def frames(spark, msgs, convs):
    m = spark.createDataFrame(msgs, "id string, conversation_id string, role string, content string, created_at int").selectExpr("*", "1 AS h", "2 AS pos", "3 AS part", "4 AS n")
    return m, spark.createDataFrame([(c, "x") for c in convs], "id string, conversation_id string")


def make(seed, n=60, long=0):
    r = random.Random(seed)
    msgs, convs = [], []
    for c in range(n):
        if r.random() < 0.9:
            convs.append(f"c{c}")
        k = r.choice([0, 1, 2, 4, 6, 10]) if c else long
        for p in range(k):
            role = ("user", "assistant")[p % 2] if c == 0 or r.random() < 0.97 else r.choice([None, "tool", " ", "system", "user"])
            role = r.choice([role, role.upper(), f" {role} "]) if role else role
            msgs.append((f"m{c}_{p:05d}", f"c{c}", role, "x" if r.random() < 0.97 or c == 0 else r.choice([None, " \t\n"]), p // 2 if r.random() < 0.5 else p // 2))
    msgs += msgs[:15] + [("m_null", None, "user", "x", 1)]
    r.shuffle(msgs)
    return msgs, convs + convs[:2]


def test_against_plain_rules(spark):
    for seed in (1, 2):
        msgs, convs = make(seed)
        m, c = frames(spark, msgs, convs)
        got = conversations.verdicts(m, c)
        assert {r["conversation_id"] for r in got.where("fault is not null").collect()} == brute(msgs, set(convs))
        whole = conversations.rebuild(m, c).collect()
        assert {r["conversation_id"] for r in whole} == set(convs) - brute(msgs, set(convs))
        assert all(r["role"] == ("user", "assistant")[r["turn"] % 2] for r in whole)


def test_one_conversation_with_most_rows_in_many_fragments(spark):
    msgs, convs = make(3, 8, long=2000)
    m, c = frames(spark, msgs, convs)
    one = conversations.assemble(conversations.fragments(conversations.numbered(conversations.clean(m)), 16, 2)).where("conversation_id = 'c0'").first()
    assert (one["n_fragments"], one["n_paths"], one["n_messages"]) == (125, 1, 2000) and one["alternates"]
    assert {r["conversation_id"] for r in conversations.verdicts(m, c, 16).where("fault is not null").collect()} == brute(msgs, set(convs))


def test_gap_between_fragments(spark):
    st = "array<struct<pos:int,h:bigint,role:string>>"
    f = lambda i, hs: ("c", i, [(k, h, ("user", "assistant")[h % 2]) for k, h in enumerate(hs)])
    df = spark.createDataFrame([f(0, [0, 1, 2, 3]), f(1, [2, 3, 4, 5]), f(2, [8, 9])], f"conversation_id string, fragment_id int, messages {st}")
    r = conversations.assemble(df).first()
    assert (r["n_fragments"], r["n_paths"], r["n_messages"]) == (3, 2, 8)


def test_empty_tables(spark):
    m, c = frames(spark, *make(1))
    assert conversations.verdicts(m.limit(0), c.limit(0)).count() == 0
    assert conversations.verdicts(m.limit(0), c).where("fault <> 'empty'").count() == 0
    assert conversations.rebuild(m, c.limit(0)).count() == 0


def test_order_comes_from_the_overlaps(spark, monkeypatch):
    r = random.Random(9)
    parts = []
    for c in range(4):
        hs = [r.randrange(1 << 60) for _ in range(200 if c else 3)]
        cuts = [(a, min(len(hs), a + 12)) for a in range(0, len(hs), 9)] if len(hs) > 12 else [(0, 3)]
        parts += [(f"c{c}", r.randrange(1 << 60), [(h, "user") for h in hs[a:b]], a) for a, b in cuts if b - a > 3 or a == 0]
    r.shuffle(parts)
    df = spark.createDataFrame([p[:3] for p in parts], "conversation_id string, fragment_id bigint, messages array<struct<h:bigint,role:string>>")
    got = {(x["conversation_id"], x["fragment_id"]): (x["start"], x["looped"]) for x in conversations.paths(df).collect()}
    assert got == {(c, f): (a, False) for c, f, _, a in parts}
    # Without overlaps a conversation of many fragments falls apart.
    msgs, convs = make(3, 8, long=200)
    m, c = frames(spark, msgs, convs)
    assert conversations.verdicts(m, c, 16).where("conversation_id = 'c0'").first()["fault"] is None
    real = conversations.overlap_edges
    monkeypatch.setattr(conversations, "overlap_edges", lambda *a: real(*a).where("false"))
    assert conversations.verdicts(m, c, 16).where("conversation_id = 'c0'").first()["fault"] == "gap"


def test_rebuilt_turns_are_in_order_over_fragments(spark):
    msgs, convs = make(3, 8, long=300)
    m, c = frames(spark, msgs, convs)
    rows = sorted((x["turn"], x["created_at"], x["role"]) for x in conversations.rebuild(m, c, 16).where("conversation_id = 'c0'").collect())
    assert [t for t, _, _ in rows] == list(range(300)) and [at for _, at, _ in rows] == sorted(at for _, at, _ in rows)


def test_loop_is_a_gap(spark):
    st = "array<struct<h:bigint,role:string>>"
    f = lambda i, hs: ("c", i, [(h, ("user", "assistant")[h % 2]) for h in hs])
    df = spark.createDataFrame([f(0, [0, 1, 2, 3]), f(1, [10, 11, 12, 13]), f(2, [12, 13, 14, 10, 11])], f"conversation_id string, fragment_id int, messages {st}")
    r = conversations.assemble(df).first()
    assert r["n_looped"] == 2 and r["n_paths"] == 2
