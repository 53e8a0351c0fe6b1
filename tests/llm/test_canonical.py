import unicodedata

import numpy as np
import pytest

from lexweave.llm import canonical
from lexweave.llm.words import word_hashes

CLEAN = "Điều 1. Các bên cho rằng khoản ký quỹ là của người lái thuyền thúng, gia hạn theo từng quý với mức 70.000 đồng. a) Gia hạn"


@pytest.fixture(scope="module")
def scores(spark):
    return canonical.train(spark.createDataFrame([(CLEAN,)] * 20 + [("Речной причал Λύχνος",)], "t string"))


@pytest.mark.parametrize("odd", [
    unicodedata.normalize("NFD", CLEAN), CLEAN.replace(" ", " "), CLEAN.replace(" ", "　"), CLEAN.replace("khoản", "kho​ản").replace("quý", "qu­ý"),
    CLEAN.replace("1", "１").replace("a)", "ａ）"), CLEAN.replace("o", "о").replace("c", "с"), CLEAN.replace("Đ", "Ð").replace("o", "ο"), CLEAN.replace("a) ", "а) "), CLEAN.replace("Đ", "Ɖ"),
])
def test_looks_the_same_becomes_equal(scores, odd):
    assert odd != CLEAN and canonical.canonical(odd, scores) == CLEAN


@pytest.mark.parametrize("text", [CLEAN, "", "   ", "hệ số α bằng 0,85", "mang tên «Речной причал».", "nhãn hiệu “Λύχνος” – 12 m² … 5°C", "Р е ч н о й", "\n\n", "①②", "½ № ℃ ™"])
def test_ordinary_text_stays(scores, text):
    assert canonical.canonical(text, scores) == text


def test_stable_and_null(scores):
    assert canonical.canonical(None, scores) is None
    for odd in ("ｃủａ  Ⅳ ﬁ", "е" * 5000, "x́‍"):
        once = canonical.canonical(odd, scores)
        assert canonical.canonical(once, scores) == once
    assert canonical.canonical("Chương Ⅳ ﬁn", scores) == "Chương IV fin"


def test_frame(spark, scores):
    df = spark.createDataFrame([("a", "x y"), ("a", "x y"), ("b", "x y"), ("c", None), (None, "​"), ("d", "")], "k string, t string").selectExpr("*", "1 AS record_key")
    assert [r["record_key"] for r in canonical.nonstandard(df, "k", "t", scores).collect()] == ["a"]
    out = canonical.canonicalize(df, "t", "t2")
    assert out.count() == 6 and {r["t2"] for r in out.where("k = 'a'").collect()} == {"x y"}
    assert canonical.nonstandard(df.limit(0), "k", "t", scores).count() == 0 and np.isfinite(canonical.train(df.limit(0).select("t"))).all()


def test_hashed_words_agree_with_plain_words(scores):
    import re

    texts = [CLEAN, None, "", "Đế́ CỦA  của_của", "x\x00y", "１２ ab", "𝒜b \U0001f600 中文", unicodedata.normalize("NFD", CLEAN), "İ ß"]
    h, n = word_hashes(texts, scores)
    plain = [re.findall(r"[^\W_]+", canonical.canonical(t.replace("\x00", " "), scores).lower()) if t else [] for t in texts]
    assert n.tolist() == [len(p) for p in plain]
    seen = {}
    for w, x in zip([w for p in plain for w in p], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_letters_of_further_scripts(scores):
    for odd, plain in (("Ꭺnh", "Anh"), ("nɡười", "người"), ("ngườı", "người"), ("ᏞUẬT", "LUẬT"), ("đօ", "đo")):
        assert canonical.canonical(f"theo {odd} này", scores) == f"theo {plain} này", odd
    assert canonical.canonical("ᎠᏂᏴᏫᏯ", scores) == "ᎠᏂᏴᏫᏯ"
