import numpy as np

from lexweave.llm import boilerplate, canonical

SCORES = canonical.log_scores(np.ones(len(canonical.ALPHABET) ** 2))
PAGE = """Trang chủ » Hỏi đáp » Đăng nhập
Bạn cho phép trang dùng cookie để đo lượng truy cập và ghi nhớ lựa chọn.
Xem nhiều
Luật Bến đò 2001
1. Đo đạc bến cần giấy tờ gì
VĂN BẢN HỢP NHẤT
LUẬT NUÔI ONG 2020
Căn cứ hồ sơ gốc;
Chia sẻ
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
1. Người nuôi ong phải lưu các nội dung sau:
a) Tổ ong
Tải bản Word

b) Giá sách;
2. Trong thời hạn 3 ngày, người nuôi ong phải khai báo với tổ giám sát.
Nơi nhận:
- Người nuôi ong;
Lưu: văn thư.
Có thể bạn quan tâm
Luật Chợ nổi 2003
2. Khai báo cần giấy tờ gì
Đang trực tuyến: 12"""
KEPT = [6, 7, 8, 10, 11, 12, 13, 14, 17, 18, 19, 20, 21]


def found(spark, rows, kept):
    df = spark.createDataFrame(rows, "raw_artifact_path string, normalized_text string").selectExpr("*", "1 AS line_no", "2 AS line")
    return {(r["raw_artifact_path"], r["line_no"]) for r in boilerplate.page_lines(df, SCORES, kept).collect()}


def test_body_lines(spark):
    rows = [("a", PAGE), ("a", PAGE), ("err", "Trang bạn tìm không còn tồn tại\n\nĐang trực tuyến: 5"), ("n", None), (None, PAGE), ("e", ""), ("b", " \n\t")]
    assert found(spark, rows, True) == {("a", k) for k in KEPT}
    every = {k for k, x in enumerate(PAGE.split("\n"), 1) if x.strip()}
    assert found(spark, rows, False) == {("a", k) for k in every - set(KEPT)} | {("err", 1), ("err", 3)}
    assert found(spark, rows[:0], True) == set()


def test_odd_characters_and_markup():
    odd = PAGE.replace(" ", " ").replace("Điều 1.", "Điều １．").replace("2. Trong", "<p>2. Trong")
    assert [k for k, (m, x) in enumerate(zip(boilerplate.content_mask(odd, SCORES), PAGE.split("\n")), 1) if m and x.strip()] == KEPT


def test_long_page():
    page = "Trang chủ | Liên hệ\n" + "\n".join(f"Điều {i}. Tên\n1. Nội dung của điều này dài vừa đủ." for i in range(1, 8001)) + "\nĐang trực tuyến: 1"
    mask = boilerplate.content_mask(page, SCORES)
    assert not mask[0] and not mask[-1] and all(mask[1:-1])


def test_line_blocks():
    assert boilerplate.line_blocks([1, 2, 3, 4], 3).tolist() == [6, 9, 7, 4]


DOCUMENT = ["LUẬT NUÔI ONG 2020", "Điều 1. Phạm vi"] + [f"{k}. Người nuôi ong phải khai báo với tổ giám sát trong thời hạn {k} ngày." for k in range(1, 9)]
SIDEBAR = ["Chương trình ưu đãi"] * 12 + [f"{k}. Bến đò mở cửa ngày {k} hằng tháng cho khách qua sông." for k in range(1, 4)] + ["Liên hệ"] * 3


def mask(lines, **how):
    return [k for k, ok in enumerate(boilerplate.content_mask("\n".join(lines), SCORES, **how)) if ok]


def test_windows_decide():
    page = DOCUMENT + SIDEBAR
    assert mask(page) == list(range(10))  # numbered sentences of a sidebar are a region of their own
    # With windows that reach over the gap, or a bound that all windows reach, the sidebar is taken in.
    assert max(mask(page, window=31)) > 20 and mask(page, window=31) != mask(page)
    # Windows of one line part the document at a gap that wider ones bridge.
    parts = DOCUMENT[:7] + ["Chia sẻ"] * 10 + DOCUMENT[7:]
    assert mask(parts, window=5) != mask(parts, window=1)
    assert mask(page, rise=3.0) == []


def test_flat_distribution_changes_the_result(monkeypatch):
    page = DOCUMENT + SIDEBAR
    whole = mask(page)
    monkeypatch.setattr(boilerplate, "line_blocks", lambda mass, window=5: np.ones(len(mass)))
    assert mask(page) != whole


def test_page_without_headings():
    story = [f"Người lái đò kể rằng mùa nước nổi năm thứ {k} cả xóm cùng nhau kéo lưới qua đêm." for k in range(1, 8)]
    page = ["Trang chủ » Tin tức", "Đăng nhập"] + story + ["Chia sẻ", "Đang trực tuyến: 5"]
    assert mask(page) == list(range(2, 9))
    assert mask(["Trang chủ » Tin tức", "Hệ thống đang bảo trì.", "Bằng việc xem trang, bạn cho phép dùng tệp nhận dạng để ghi nhớ lựa chọn.", "Liên hệ"]) == []
