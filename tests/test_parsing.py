from lexweave.operators import chunking, html

TEXT = """LUẬT NUÔI ONG 2020
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi
1. Khoản một:
a) Điểm a;
b) Điểm b;
2. Khoản hai.
Điều 2. Trống
Chương II
ĐIỀU KHOẢN THI HÀNH
Điều 3. Hiệu lực
Nội dung. Ngày 3. không phải khoản
"""


def test_headings_and_tree():
    h = [(x.level, x.number, x.title) for x in chunking.headings(TEXT)]
    assert h == [("chapter", "I", "QUY ĐỊNH CHUNG"), ("article", "1", "Phạm vi"), ("clause", "1", None), ("point", "a", None), ("point", "b", None), ("clause", "2", None), ("article", "2", "Trống"), ("chapter", "II", "ĐIỀU KHOẢN THI HÀNH"), ("article", "3", "Hiệu lực")]
    rows = chunking.tree("L", TEXT)
    assert rows[0][1] == "L__root" and all(TEXT[r[6] : r[7]] == r[5] for r in rows)
    assert {r[1]: r[8] for r in rows}["L__root__chapter_I__article_1__clause_1__point_b"] == "L__root__chapter_I__article_1__clause_1"


def test_chunks_and_issues(spark):
    df = spark.createDataFrame([("L", TEXT), ("E", ""), ("N", None), (None, "x"), ("P", "không có đề mục")], "doc_id string, text string").selectExpr("*", "1 AS level", "2 AS ordinal")
    nodes = chunking.parse(df)
    assert chunking.tree_issues(nodes).count() == 0
    c = {r["source_node_id"].split("root__")[1]: r for r in chunking.chunk(nodes).collect()}
    assert set(c) == {"chapter_I__article_1__clause_1__point_a", "chapter_I__article_1__clause_1__point_b", "chapter_I__article_1__clause_2", "chapter_I__article_2", "chapter_II__article_3"}
    p = c["chapter_I__article_1__clause_1__point_b"]
    assert p["citation"] == "L, Điểm b, Khoản 1, Điều 1" and p["hierarchy_path"] == "L / Chương I. QUY ĐỊNH CHUNG / Điều 1. Phạm vi / Khoản 1 / Điểm b" and p["text"] in p["parent_text"]
    assert c["chapter_I__article_2"]["chunk_kind"] == "article_level_empty" and c["chapter_II__article_3"]["chunk_kind"] == "article_level"
    bad = nodes.unionByName(nodes.where("level = 'clause'").selectExpr("doc_id", "node_id", "level", "number", "title", "text", "start_offset", "end_offset + 500 AS end_offset", "'nowhere' AS parent_id", "ordinal"))
    assert {r["code"] for r in chunking.tree_issues(bad).collect()} >= {"DUPLICATE_NODE_ID", "PARENT_MISSING", "TEXT_NOT_SPAN"}


def test_siblings_of_one_number():
    rows = chunking.tree("L", "Điều 1. A\nĐiều 1. B\n")
    assert [r[1] for r in rows[1:]] == ["L__root__article_1", "L__root__article_1__occurrence_2"]


def test_html(spark):
    page = "<html><head><title>t</title><script>x()</script></head><body><nav><p>Trang chủ</p></nav><article><p>Điều 1. A&amp;B</p><p>1. <b>Một</b> hai ,<br/>ba</p></article><footer><p>©</p></footer>"
    assert html.main_text(page) == "Điều 1. A&B\n1. Một hai,\nba"
    assert html.main_text("") == "" and html.main_text("<p>cut <b") == "cut"
    df = spark.createDataFrame([("a", page), ("b", None), ("c", "")], "k string, html string")
    assert {r["key"]: r["n_articles"] for r in html.extract(df, "k").collect()} == {"a": 1, "c": 0}


def forms(text):
    h, b = chunking.scan(text)
    return [(x.level, x.number, x.status, x.reason) for x in h], [x.kind for x in b]


def test_candidates():
    text = "Điều 1. A\n1. một\n2.[3] hai\na) a\nđ) đ\nc)[4] c\n3.Thiếu khoảng trắng\n4 thiếu dấu chấm\n01 tháng 01 năm 2026 ngày\n5 + 6 = 11\n6 có điểm\na) a\nĐiều 2. B\na) không có khoản\n"
    got, _ = forms(text)
    assert got == [
        ("article", "1", "certain", None), ("clause", "1", "certain", None), ("clause", "2", "certain", None), ("point", "a", "certain", None), ("point", "đ", "certain", None), ("point", "c", "certain", None),
        ("clause", "3", "certain", None), ("clause", "4", "ambiguous", "malformed_number"), ("clause", "01", "rejected", "date"), ("clause", "5", "rejected", "formula"), ("clause", "6", "certain", None),
        ("point", "a", "certain", None), ("article", "2", "certain", None), ("point", "a", "rejected", "no_clause"),
    ]


def test_notes_end_units_and_resume_at_the_next_article():
    note = "Điều 74 và Điều 75 của Luật Giá số 16 quy định như sau:"
    text = f"Điều 1. A\nNội dung.\n{note}\n1. Không phải khoản.\nĐiều 2. B\nNội dung."
    got, bounds = forms(text)
    assert got == [("article", "1", "certain", None), ("clause", "1", "rejected", "source_note"), ("article", "2", "certain", None)] and bounds == ["note"]
    rows = {r[1]: r[5] for r in chunking.tree("L", text)}
    assert rows["L__root__article_1"] == "Điều 1. A\nNội dung.\n" and rows["L__root__article_2"].endswith("Nội dung.")
    assert forms(f"Điều 3 của Luật\n{note}\nĐiều 1. A")[0] == []
    assert forms(f"Điều 1. A\n{note}\nx\nĐiều 7. Q\nĐiều 2. B")[0] == [("article", "1", "certain", None)]


def test_trailing_regions_and_structure():
    text = "Lời.\nPhần thứ nhất\nQUY ĐỊNH\nChương I\nCHUNG\nMục 1. A\nĐiều 1. X\nND.\nChương II\nĐiều 2. Y\nND.\nNơi nhận:\nỦy ban."
    rows = {r[1]: r for r in chunking.tree("L", text)}
    assert list(rows) == ["L__root", "L__root__part_thu_nhat", "L__root__part_thu_nhat__chapter_I", "L__root__part_thu_nhat__chapter_I__section_1", "L__root__part_thu_nhat__chapter_I__section_1__article_1", "L__root__part_thu_nhat__chapter_II", "L__root__part_thu_nhat__chapter_II__article_2"]
    assert rows["L__root__part_thu_nhat"][4] == "QUY ĐỊNH" and rows["L__root__part_thu_nhat__chapter_II"][4] is None
    assert rows["L__root__part_thu_nhat__chapter_II__article_2"][5] == "Điều 2. Y\nND.\n"
