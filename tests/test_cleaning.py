import base64

from pyspark.sql import functions as F

from lexweave.operators import cleaning, indexing


def run(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_steps(spark):
    assert run(spark, "a b​\x01\tc", cleaning.plain_characters) == "a b\tc"
    assert run(spark, "  a   b \r\n\n\n\n c\nĐi\nều\nĐiều\n1. x", cleaning.plain_white_space) == "a b\n\nc\nĐiều\nĐiều 1. x"
    assert run(spark, "Đăng nhập\nĐiều 1. Đăng nhập\nQuảng cáo ", cleaning.without_lines) == "Điều 1. Đăng nhập"
    mark = base64.b64encode("xx site.example mark xx".encode()).decode()
    assert run(spark, f"a\n{mark}\nABCDEFGHIJKLMNOPQRSTUVWX", lambda c: cleaning.without_encoded_lines(c, "SITE.example")) == "a\nABCDEFGHIJKLMNOPQRSTUVWX"
    assert run(spark, "&amp; ế", cleaning.decoded) == "& ế"


def test_body(spark):
    page = "Menu\nXem\nLUẬT ONG\nCăn cứ;\nĐiều 1. a\nĐiều 2. b\nĐiều 3. c\nx\nBình luận (3)\nĐiều 9. z"
    assert run(spark, page, cleaning.body) == "LUẬT ONG\nCăn cứ;\nĐiều 1. a\nĐiều 2. b\nĐiều 3. c\nx"
    assert run(spark, "không có gì\nBình luận", cleaning.body) == "không có gì\nBình luận" and run(spark, "", cleaning.body) == ""
    df = spark.createDataFrame([(page,), (None,)], "t string")
    assert [r["clean_text"] is None for r in cleaning.clean(df, "t").collect()] == [False, True]


def test_index_inputs(spark):
    df = spark.createDataFrame([("a", "L", "c", " x ", "clause"), ("b", None, "c", "y", "clause"), ("c", "L", "c", " ", "point")], "id string, law_name string, citation string, text string, level string")
    assert [r[0] for r in df.select(indexing.embedding_input("law_citation_text")).collect()] == ["L\nc\nx", None, None]
    assert df.where(indexing.payload_filter(level="clause", law_name=None)).count() == 2
    v = indexing.embed(df, F.col("law_name"), indexing.hashed_encoder).collect()
    assert len(v[0]["embedding"]) == 64 and v[1]["embedding"] is None and v[0]["embedding"] == v[2]["embedding"]
    assert [r["id"] for r in indexing.remaining(df, df.where("id <> 'b'"), "id").collect()] == ["b"]
