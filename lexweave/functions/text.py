"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Vietnamese letters with marks and their bare forms, for keys that ignore marks (d-bar stays a letter of its own).
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
BARE = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"
# Labels and patterns of text that looks like a secret.
SECRETS = {
    "api_key": r"(?i)\bapi[_-]?key\s*[:=]\s*\S+",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._-]{8,}",
    "password": r"(?i)\b(?:password|passwd)\s*[:=]\s*\S+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "token": r"(?i)\b(?:access|auth|secret)[_-]?token\s*[:=]\s*\S+",
    "sk_key": r"\bsk-[A-Za-z0-9_-]{16,}",
    "url_credentials": r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Case folding for comparison: lower case with sharp s as ss."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def tokens(c: Column | str) -> Column:
    """Folded runs of letters and digits; null gives no token."""
    return F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def collapse(c: Column | str) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(col(c), f"^{SPACE}|{SPACE}$", ""), F.lit(""))


def duplicate_key(c: Column | str) -> Column:
    """Key of texts that are the same but for punctuation, white space and case."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\p{M}]+", " "))


def bare_key(c: Column | str) -> Column:
    """The duplicate key without marks on letters."""
    return F.translate(duplicate_key(c), MARKED, BARE)


def truncate(c: Column | str, most: int, marker: str = " ...") -> Column:
    """At most ``most`` characters, the last of them a marker if any were cut."""
    c = col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, max(0, most - len(marker)))), F.lit(marker)))


def preview(c: Column | str, most: int) -> Column:
    return truncate(collapse(c), most, "...")


def redact(c: Column | str) -> Column:
    """Secret-looking text replaced by its label."""
    return reduce(lambda x, kv: F.regexp_replace(x, kv[1], f"[{kv[0]}]"), SECRETS.items(), col(c))


def secret_labels(c: Column | str) -> Column:
    """Labels of the secret patterns that occur, in their order."""
    return F.filter(F.array(*[F.when(col(c).rlike(p), F.lit(k)) for k, p in SECRETS.items()]), lambda x: x.isNotNull())


def citation_ids(c: Column | str) -> Column:
    """Distinct citation ids like [E1], in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[(E\d+)\]"), F.lit(1)))


def numeric_prefix(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^(\d+)", 1), F.lit("")).try_cast("int")


def article_numbers(c: Column | str, headings_only: bool = False) -> Column:
    """Numbers of the articles that a text names; with ``headings_only`` those that begin a line."""
    p = r"(?dium)^\s*điều\s+([0-9]{1,9})\." if headings_only else r"(?iu)điều\s+([0-9]{1,9})"
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(p), F.lit(1)), lambda x: x.cast("int"))


def sequence_score(c: Column | str) -> Column:
    """Distinct heading numbers by the largest: 1 for an unbroken sequence, 0 without headings."""
    n = article_numbers(c, True)
    return F.coalesce(F.size(F.array_distinct(n)) / F.nullif(F.array_max(n), F.lit(0)), F.lit(0.0))


def lines(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), "\n")


def duplicate_line_ratio(c: Column | str, least: int = 12) -> Column:
    """Share of the lines of ``least`` characters or more that repeat an earlier one."""
    long = F.filter(F.transform(lines(c), lambda x: collapse(x)), lambda x: F.length(x) >= least)
    return F.round(F.coalesce((F.size(long) - F.size(F.array_distinct(long))) / F.nullif(F.size(long), F.lit(0)), F.lit(0.0)), 4)


def looks_vietnamese(c: Column | str) -> Column:
    return F.coalesce(fold(c).rlike("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"), F.lit(False))


def markers(c: Column | str) -> Column:
    """What of a statute's structure a text shows."""
    c = F.coalesce(col(c), F.lit(""))
    refs, heads = article_numbers(c), article_numbers(c, True)
    word = lambda w: c.rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_]){w}(?:$|[^\p{{L}}\p{{N}}_])")
    return F.struct(
        word("phần").alias("contains_part"),
        word("chương").alias("contains_chapter"),
        word("mục").alias("contains_section"),
        (F.size(refs) > 0).alias("contains_article"),
        c.rlike(r"(?dium)^\s*[0-9]+\..").alias("contains_clause_numbering"),
        c.rlike(r"(?dium)^\s*[a-zđ]\).").alias("contains_point_labeling"),
        F.size(refs).alias("article_reference_count"),
        F.size(heads).alias("article_heading_count"),
        F.coalesce(F.array_max(heads), F.lit(0)).alias("max_heading_article_number"),
        F.array_contains(heads, 1).alias("has_heading_article_1"),
        F.array_contains(heads, 2).alias("has_heading_article_2"),
        F.round(sequence_score(c), 6).alias("heading_sequence_score"),
    )
