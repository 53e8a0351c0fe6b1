import json
import uuid

import pytest

from lexweave.functions import text
from lexweave.operators import conversation, evidence, fingerprint, splits, validate
from lexweave.sources import files
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, "Straße ĐẤT  số 12", text.tokens) == ["strasse", "đất", "số", "12"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, " a \tb 　", text.collapse) == "a b"
    assert one(spark, "Đất, Đai!", text.bare_key) == "đat đai"
    assert one(spark, "abcdefghij", lambda c: text.truncate(c, 7)) == "abc ..."
    assert one(spark, "x [E2] y [E1] [E2]", text.citation_ids) == ["E2", "E1"]
    assert one(spark, "password: hunter2 sk-abcdefghijklmnopqrst", text.secret_labels) == ["password", "sk_key"]
    assert "hunter2" not in one(spark, "password: hunter2", text.redact)
    assert one(spark, "Điều 1. a\n  Điều 3. b\nxem Điều 7", lambda c: text.article_numbers(c, True)) == [1, 3]
    assert one(spark, "Điều 1. a\nĐiều 3. b", text.sequence_score) == pytest.approx(2 / 3)
    assert one(spark, "12a", text.numeric_prefix) == 12 and one(spark, "a", text.numeric_prefix) is None
    assert one(spark, "một dòng đủ dài\nmột dòng đủ dài\nngắn", text.duplicate_line_ratio) == 0.5


def test_lengths_and_buckets(spark):
    df = spark.createDataFrame([("x" * n,) for n in [1, 2, 2, 3, 10, 250, 999]] + [(None,)], "t string")
    r = validate.length_summary(df, "t").first()
    assert (r["n"], r["min_len"], r["max_len"], r["median_len"], r["p90"], r["p99"]) == (7, 1, 999, 3.0, 250, 999)
    assert {x["bucket"]: x["n"] for x in validate.length_buckets(df, "t").collect()} == {"0-200": 5, "200-500": 1, "500-1000": 1, "1000-2000": 0, "2000+": 0}
    assert validate.length_summary(df.limit(0), "t").first()["n"] == 0


def test_sets_and_references(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    assert {(r["key"], r["observed"], r["reported"]) for r in validate.reconcile(a, b, "k").collect()} == {("x", 2, 1), ("y", 1, 0), ("z", 0, 1)}
    assert [r["key"] for r in validate.orphans(a, b, "k", "k").collect()] == ["y"]
    assert {(r["key"], r["side"]) for r in validate.set_difference(a, b, "k").collect()} == {("y", "left"), ("z", "right")}
    c = spark.createDataFrame([("1", "Đang  TRỰC\ntuyến: 5", None), ("2", "ok", "ok")], "id string, t string, u string")
    assert [(r["key"], r["field"]) for r in validate.contamination(c, "id", ["t", "u"], ["đang trực tuyến"]).collect()] == [("1", "t")]


def test_latest_and_updates(spark):
    t = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 1, "b"), (None, 9, "x")], "id string, v int, w string")
    assert {(r["id"], r["w"]) for r in validate.latest(t, "id", "v").collect()} == {("a", "new"), ("b", "b")}
    u = spark.createDataFrame([("b", 1, "b2"), ("a", 2, "stale"), ("c", 1, "c")], "id string, v int, w string")
    assert {(r["id"], r["w"]) for r in conversation.apply_updates(t, u, "id", "v").collect()} == {("a", "new"), ("b", "b2"), ("c", "c")}


def test_fingerprint_ignores_order_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "null")], "a int, b string")
    same = a.orderBy(F.desc("a")).select("b", "a")
    f = lambda d: fingerprint.table_fingerprint(d).first()["fingerprint"]
    assert f(a) == f(same) != f(a.union(a.limit(1))) and f(a) != f(a.fillna("null"))
    got = a.select(fingerprint.point_id(F.lit("một"), "space").alias("p")).first()["p"]
    assert got == str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, "space"), "một"))


def test_splits_keep_groups_together(spark):
    q = spark.createDataFrame([(f"q{i:02d}", f"f{i % 7}" if i % 3 else None, "same" if i in (1, 2) else None) for i in range(40)], "id string, fam string, other string")
    c = splits.components_by_fields(q, "id", ["fam", "other"])
    comp = {r["key"]: r["component"] for r in c.collect()}
    assert comp["q00"] == "q00" and comp["q01"] == comp["q08"] == comp["q02"]
    s = splits.grouped_split(c, {"dev": 0.7, "held": 0.3})
    by = {}
    for r in s.collect():
        by.setdefault(r["component"], set()).add(r["split"])
    assert s.count() == 40 and all(len(v) == 1 for v in by.values())
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, splits.grouped_split(c, {"dev": 0.7, "held": 0.3}).collect()))


def test_evidence(spark):
    ch = spark.createDataFrame([("a", "L", "1", "c1", "Một hai.", "P"), ("b", "L", "1", "c2", "MỘT HAI", "P"), ("c", "L", "1", "c3", "Ba", "P"), ("d", "L", "2", "c4", " ", "Q"), ("e", "L", "2", "c5", "Năm", None)], "chunk_id string, law_id string, article_number string, citation string, text string, parent_text string")
    h = spark.createDataFrame([(1, x, i, 1.0) for i, x in enumerate("abcdezz", 1)], "query_id int, doc_id string, rank int, score double")
    p = evidence.packets(h, ch).orderBy("packet_no").collect()
    assert [(r["doc_id"], r["context_text"]) for r in p] == [("a", "P"), ("c", None), ("e", None)]
    pr = evidence.prompts(evidence.packets(h, ch)).first()
    assert pr["n_evidence"] == 3 and pr["prompt"].startswith("[E1]\nc1\nMột hai.")
    a = spark.createDataFrame([("x [E1] [E4]", 3), ("none", 3), ("[E2]", 3), (None, 0)], "answer string, n_evidence int")
    assert [(r["cited"], r["unknown"], r["grounded"]) for r in evidence.check_citations(a).collect()] == [(["E1", "E4"], ["E4"], False), ([], [], False), (["E2"], [], True), ([], [], False)]


def test_conversations(spark):
    m = spark.createDataFrame([("1", "c", " User ", "Phí bao nhiêu?", 1), ("1", "c", " User ", "Phí bao nhiêu?", 1), ("2", "c", "assistant", " ", 2), ("3", "c", "user", "Còn trường hợp này thì sao?", 3), (None, "c", "user", "x", 4)], "id string, conversation_id string, role string, content string, created_at int")
    q = {r["id"]: r for r in conversation.rewritten_questions(m).collect()}
    assert q["3"]["question"] == "Phí bao nhiêu?\nCòn trường hợp này thì sao?" and not q["1"]["follow_up"]
    assert {(r["id"], r["age"]) for r in conversation.last_messages(m, 2).collect()} == {("3", 1)}
    c = spark.createDataFrame([("c",), ("d",)], "id string")
    left, msgs = conversation.delete_cascade(c, m, c.where("id = 'c'"))
    assert [r["id"] for r in left.collect()] == ["d"] and msgs.count() == 0


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "n": 2}\n\n{"id": "2", "id": "3"}\n[1]\n{bad\n', "utf-8")
    assert {r["problem"] for r in files.json_problems(spark, str(p)).collect()} == {"REPEATED_KEY", "NOT_AN_OBJECT", "NOT_JSON"}
    assert files.read_jsonl(spark, str(p), "id string, n int", strict=False).where("_bad is null and id is not null").count() >= 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "id string, n int").collect()
    (tmp_path / "arr.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    assert files.read_json_array(spark, str(tmp_path / "arr.json"), "id string").count() == 2
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    files.write_jsonl(df, out)
    with pytest.raises(Exception):
        files.write_jsonl(df, out)
    with pytest.raises(PermissionError):
        files.write_jsonl(df, out, True, [str(tmp_path)])
    for law, sub in (("L1", "latest/"), ("L1", ""), ("L2", "")):
        d = tmp_path / "raw" / law / sub
        d.mkdir(parents=True, exist_ok=True)
        (d / "main.html").write_text("x")
        (d / "metadata.json").write_text("{}")
    (tmp_path / "raw" / "L3").mkdir()
    (tmp_path / "raw" / "L3" / "main.html").write_text("x")
    assert {(r["law_id"], r["layout"]) for r in files.scan_page_folders(spark, str(tmp_path / "raw")).collect()} == {("L1", "latest"), ("L2", "flat")}
    with pytest.raises(ValueError):
        files.assert_no_secrets(spark.createDataFrame([("password: hunter2",)], "t string"), ["t"])
    files.assert_no_secrets(df, ["id"])


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(f"k{i}", i) for i in range(30)], "id string, v int")
    files.upsert_parquet(spark, path, a, "id", 4)
    b = spark.createDataFrame([("k3", 300), ("new", 1)], "id string, v int")
    for _ in range(2):
        files.upsert_parquet(spark, path, b, "id", 4)
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 and got["k3"] == 300 and got["k4"] == 4


def test_targets_and_domains(spark):
    from lexweave.operators import audit

    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 1), (None, 1)], "law_id string, tier int")
    got = {r["law_id"]: r["skip_reason"] for r in audit.select_targets(t, {"tier": [1], "law_id": []}, t.where("law_id = 'd'")).collect()}
    assert got == {"a": None, "b": "not_in_tier", "c": "not_in_tier", "d": "already_there", None: None}
    u = spark.createDataFrame([("https://x.a.example/p",), ("https://a.example.evil/p",), ("no url",), (None,)], "u string")
    assert [r[0] for r in u.select(audit.trusted("u", ["a.example"])).collect()] == [True, False, False, False]


def test_store_updates(spark):
    c = spark.createDataFrame([("c", "o", "t", 5), ("d", "o", "t", 1)], "id string, owner_id string, title string, updated_at int")
    m = spark.createDataFrame([("1", "c", "user", "x", 4)], "id string, conversation_id string, role string, content string, created_at int")
    new = spark.createDataFrame([("1", "c", "user", "again", 9), ("2", "c", "user", "y", 7), ("3", "zz", "user", "z", 8)], "id string, conversation_id string, role string, content string, created_at int")
    c2, m2 = conversation.appended(c, m, new)
    assert {(r["id"], r["updated_at"]) for r in c2.collect()} == {("c", 7), ("d", 1)} and {r["id"] for r in m2.collect()} == {"1", "2"}
    assert [r["id"] for r in conversation.fetch(c, m2, "c", "o").collect()] == ["1", "2"] and conversation.fetch(c, m2, "c", "other").count() == 0
    t = spark.createDataFrame([("c", "o", "new"), ("d", "other", "no")], "id string, owner_id string, title string")
    assert {(r["id"], r["title"]) for r in conversation.retitled(c, t).collect()} == {("c", "new"), ("d", "t")}


def test_index_run_resumes(spark, tmp_path):
    from lexweave.operators import indexing

    path = str(tmp_path / "index")
    df = spark.createDataFrame([(f"k{i}", f"từ {i}" if i % 5 else None) for i in range(20)] + [(None, "x")], "id string, text string")
    first = indexing.index_run(df.where("id < 'k15'"), path, "id", F.col("text"), indexing.hashed_encoder, 2)
    second = indexing.index_run(df, path, "id", F.col("text"), indexing.hashed_encoder)
    assert first["before"] == 0 and second == {"before": first["after"], "after": 16}
    assert indexing.index_run(df, path, "id", F.col("text"), indexing.hashed_encoder) == {"before": 16, "after": 16}


def test_page_folder_source(spark, tmp_path):
    from lexweave.sources.pages import PageFolders

    for law, sub, body in (("L1", "latest", "mới"), ("L1", "", "cũ"), ("L2", "", "hai")):
        d = tmp_path / law / sub
        d.mkdir(parents=True, exist_ok=True)
        (d / "main.html").write_text(body, "utf-8")
    (tmp_path / "L3").mkdir()
    spark.dataSource.register(PageFolders)
    got = spark.read.format("page_folders").option("foldersPerPartition", 1).load(str(tmp_path)).collect()
    assert {(r["law_id"], r["layout"], r["html"]) for r in got} == {("L1", "latest", "mới"), ("L2", "flat", "hai")}
