"""Extracted page text to normalized text: characters, white space, fragments, site lines, and the bounds of the body.

All but entity decoding and composition (one pandas UDF) are JVM expressions over the text or its array of lines."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text

# Menu lines that may be dropped wherever they stand alone, markers that protect a line, markers after which
# nothing of a statute follows, and beginnings of official headers (without spaces).
SITE_LINES = ("Đăng nhập", "Đăng ký", "Hotline", "Liên hệ", "Tải về", "Văn bản liên quan", "Lược đồ", "Quảng cáo")
PROTECTED = ("Điều", "Chương", "Phần", "Mục", "Luật", "Bộ luật")
END_MARKERS = ("Văn bản liên quan", "Liên quan hiệu lực", "Liên quan nội dung", "Thuộc tính", "Tải về", "Bình luận", "Hỏi đáp", "Tin liên quan")
HEADERS = ("LUẬT", "BỘLUẬT", "VĂNBẢNHỢPNHẤT", "HIẾNPHÁP", "PHÁPLỆNH", "NGHỊĐỊNH", "THÔNGTƯ", "QUỐCHỘI", "CHÍNHPHỦ")


def decoded(c: Column | str) -> Column:
    """Character references decoded, text composed."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", html.unescape(x)), na_action="ignore")

    return f.asNondeterministic()(text.col(c))  # so that it is run once, below the expressions over its result


def plain_characters(c: Column | str) -> Column:
    """No-break spaces as spaces; zero-width and control characters dropped, line ends and tabs kept."""
    return F.regexp_replace(F.translate(text.col(c), "\u00a0", " "), r"[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def plain_white_space(c: Column | str) -> Column:
    """Lines without spaces at their ends or runs of spaces inside, at most one blank line together; words of headings that
    were broken over two lines are joined."""
    c = F.regexp_replace(text.col(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?dm)^ | $", "")
    c = F.regexp_replace(c, r"(?dm)^Điều\n(?=\d+\.)", "Điều ")
    for word in ("Điều", "ĐIỀU", "điều", "Mục", "MỤC", "mục", "Việc", "việc"):
        for k in range(1, len(word)):
            c = F.regexp_replace(c, f"(?dm)^{word[:k]}\n{word[k:]}$", word)
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def without_lines(c: Column | str, phrases: Sequence[str] = SITE_LINES, protected: Sequence[str] = PROTECTED) -> Column:
    """The text without lines that are exactly one of ``phrases``, unless a line holds a protected word."""
    def keep(x):
        held = F.lit(False)
        for p in protected:
            held = held | F.contains(x, F.lit(p))
        return held | ~F.trim(x).isin(*phrases)

    return F.array_join(F.filter(text.lines(c), keep), "\n")


def without_encoded_lines(c: Column | str, marker: str) -> Column:
    """The text without lines of 24 characters or more that are base64 and decode to something with ``marker``."""
    def coded(x):
        raw = F.try_to_binary(x, F.lit("base64"))
        wide = F.unhex(F.regexp_replace(F.hex(raw), "([0-9A-F]{2})00", "$1"))  # UTF-16 of plain letters
        found = F.lit(False)
        for b in (raw, wide):
            found = found | F.coalesce(F.contains(F.lower(b.cast("string")), F.lit(marker.lower())), F.lit(False))
        return (F.length(x) >= 24) & (F.length(x) % 4 == 0) & x.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & found

    return F.array_join(F.filter(text.lines(c), lambda x: ~coded(F.trim(x))), "\n")


def body(c: Column | str, window: int = 3000, look_back: int = 6, min_articles: int = 3) -> Column:
    """The statute's own lines: from the official header nearest above an early Article 1 to the first end marker after
    ``min_articles`` lines that name an article. Without an early Article 1 the start stays, without a marker the end."""
    x = F.coalesce(text.col(c), F.lit(""))
    rows = F.split(x, "\n")
    first = F.array_position(F.transform(F.split(F.substring(x, 1, window), "\n"), lambda r: r.rlike(r"(?iu)^\s*điều\s+1\.")), True).cast("int")
    head = F.filter(F.sequence(F.greatest(first - look_back, F.lit(1)), F.greatest(first - 1, F.lit(1))), lambda i: (i < first) & F.upper(F.regexp_replace(F.get(rows, i - 1), r"\s+", "")).rlike("^(?:" + "|".join(HEADERS) + ")"))
    start = F.when(first > 0, F.coalesce(F.array_max(head), first)).otherwise(1)
    articles = F.transform(rows, lambda r: r.rlike(r"(?iu)điều\s+\d+"))
    nth = F.get(F.filter(F.transform(articles, lambda a, i: F.when(a, i + 1)), lambda i: i.isNotNull()), F.lit(min_articles - 1))
    marked = F.filter(F.transform(rows, lambda r, i: F.when(F.lower(r).rlike("|".join(m.lower() for m in END_MARKERS)), i + 1)), lambda i: i.isNotNull() & (i > nth))
    end = F.coalesce(F.get(marked, F.lit(0)) - 1, F.size(rows))
    return F.array_join(F.slice(rows, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def clean(pages: DataFrame, column: str, out: str = "clean_text") -> DataFrame:
    """The frame with ``out``: characters, white space, site lines and bounds of ``column`` put right; null stays null."""
    d = pages.withColumn(out, decoded(column))
    c = without_lines(plain_white_space(plain_characters(out)))
    return d.withColumn(out, F.when(F.col(out).isNotNull(), body(c)))
