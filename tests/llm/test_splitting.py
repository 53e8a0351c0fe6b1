import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import splitting


def sound(text, most, lap):
    parts = splitting.split_text(text, most, lap)
    assert "".join(text[a:b] for a, b, _, _ in parts) == text
    for k, (a, b, s, _) in enumerate(parts):
        assert 0 < b - s <= most and a < b
        assert a - s == (lap if k else 0) or (k and a - s == min(lap, a))
    return parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .;,\n1Đế̂a)", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, most, lap):
    sound(text, most, lap)


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "1. " + "a" * 40 + " b c.\n2. " + "d" * 45
    parts = sound(text, 60, 5)
    assert text[parts[1][0] :].startswith("2. ") and parts[0][3] == "clause"


def test_long_text_and_text_without_boundaries():
    assert len(sound("x" * 100_000, 700, 60)) > 140
    assert len(sound("từ " * 200_000, 700, 60)) > 900


def test_limits_are_checked():
    with pytest.raises(ValueError):
        splitting.split_text("abc", 5, 5)


def test_frame(spark):
    limits = spark.createDataFrame([("k", "text", 10, 2), ("k", "text", 12, 2), ("k", "parent_text", 4, 1)], "chunk_kind string, field_name string, max_chars int, overlap_chars int")
    rows = [("a", "k", "0123456789", "abc"), ("b", "k", "0123456789 1", None), ("b", "k", "0123456789 1", None), ("c", None, "x" * 50, "y" * 50), ("d", "other", "x" * 50, ""), (None, "k", "x" * 50, "y" * 50), ("e", "k", "", "ééééé")]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_kind string, text string, parent_text string").selectExpr("*", "1 AS value", "2 AS field_name", "3 AS p", "4 AS max_chars")
    got = splitting.split_oversized(df, limits)
    assert {(r["item_id"], r["field_name"]) for r in got.collect()} == {("b", "text"), ("e", "parent_text")}
    assert [r["piece"] for r in got.where("item_id = 'e'").orderBy("piece_no").collect()] == ["éé", "éééé"] or all(len(r["piece"]) <= 4 for r in got.where("item_id = 'e'").collect())
    assert splitting.split_oversized(df.limit(0), limits).count() == 0 and splitting.split_oversized(df, limits.limit(0)).count() == 0


def test_a_letter_keeps_its_marks():
    text = "e\u0302\u0301" * 60
    parts = splitting.split_text(text, 40, 5)
    assert "".join(text[a:b] for a, b, _, _ in parts) == text and all(b - s <= 40 for _, b, s, _ in parts)
    assert all(text[a] == "e" for a, _, _, _ in parts)
