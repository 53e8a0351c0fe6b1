"""Selection of crawl targets, audits of stored pages, and comparison of raw with cleaned text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text


def select_targets(targets: DataFrame, wanted: Mapping[str, Sequence], done: DataFrame | None = None, key: str = "law_id") -> DataFrame:
    """The targets with ``skip_reason``: null for a selected one, else the first rule that leaves it out. ``wanted``: column
    to allowed values, where an empty list allows all; a null value is never allowed by a list. ``done``: targets already
    there (column ``key``)."""
    reason = F.lit(None).cast("string")
    for c, values in reversed(wanted.items()):
        if values:
            reason = F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.lit(f"not_in_{c}")).otherwise(reason)
    if done is None:
        return targets.withColumn("skip_reason", reason)
    d = done.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_there", F.lit(True))
    j = targets.join(d, F.col(key) == F.col("_k"), "left")
    return j.withColumn("skip_reason", F.coalesce(reason, F.when(F.col("_there"), F.lit("already_there")))).drop("_k", "_there")


def trusted(url: Column | str, domains: Sequence[str]) -> Column:
    """Whether the host of a URL is one of the domains or below one; what is no URL isn't."""
    host = F.lower(F.try_parse_url(text.col(url), F.lit("HOST")))
    ok = F.lit(False)
    for d in domains:
        ok = ok | (host == F.lit(d)) | F.endswith(host, F.lit("." + d))
    return F.coalesce(ok, F.lit(False))


def page_checks(least_chars: int = 500, domains: Sequence[str] = ()) -> dict[str, Column]:
    """Checks of a stored page's row: what must be there, its status, its size, signs of an error page."""
    head = F.lower(F.substring(F.coalesce("html", F.lit("")), 1, 2048))
    checks = {
        "LAW_ID_MISSING": text.blank_to_null("law_id").isNull(),
        "URL_MISSING": text.blank_to_null("url").isNull(),
        "STATUS_NOT_SUCCESS": F.coalesce(F.col("crawl_status") != "success", F.lit(True)),
        "HTTP_NOT_OK": F.coalesce(F.col("http_status") != 200, F.lit(True)),
        "HASH_NOT_SHA256": F.coalesce(~F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(True)),
        "HTML_MISSING": F.col("html").isNull(),
        "HTML_SHORT": F.length("html") < least_chars,
        "HTML_CUT_OFF": ~F.endswith(F.trim(F.col("html")), F.lit("</html>")),
        "ERROR_PAGE": head.rlike("404 not found|access denied|403 forbidden"),
    }
    if domains:
        checks["DOMAIN_NOT_TRUSTED"] = F.col("url").isNotNull() & ~trusted("url", domains)
    return checks


def holds_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether a text holds one of the phrases, case ignored."""
    low, out = F.lower(c), F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def first_position(c: Column | str, patterns: Sequence[str]) -> Column:
    """The least place (from 0) at which one of the patterns begins in a text; null if none occurs."""
    t = F.coalesce(text.col(c), F.lit(""))
    at = [F.regexp_instr(t, F.lit(p)) for p in patterns]
    return F.array_min(F.filter(F.array(*at), lambda x: x > 0)) - 1


def suspicious_flags(c: Column | str, start_phrases: Sequence[str] = (), end_phrases: Sequence[str] = (), least_chars: int = 5000, most_repeated: float = 0.2) -> Column:
    """What speaks against a cleaned text, in this order: short_normalized_text, missing_article_headings,
    missing_article_1_heading, high_duplicate_line_ratio, possible_wrong_start (a phrase in its first 20 lines),
    possible_wrong_end (in its last 40). A null text counts as empty."""
    t = F.coalesce(text.col(c), F.lit(""))
    heads, rows = text.article_numbers(t, True), text.lines(t)
    part = lambda x: F.array_join(x, "\n")
    flags = {
        "short_normalized_text": F.length(t) < least_chars,
        "missing_article_headings": F.size(heads) == 0,
        "missing_article_1_heading": ~F.array_contains(heads, 1),
        "high_duplicate_line_ratio": text.duplicate_line_ratio(t) > most_repeated,
        "possible_wrong_start": holds_any(part(F.slice(rows, 1, 20)), start_phrases),
        "possible_wrong_end": holds_any(part(F.slice(rows, F.greatest(F.size(rows) - 39, F.lit(1)), 40)), end_phrases),
    }
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))


def article_checks(nodes: DataFrame, expected: DataFrame, key: str = "law_id") -> DataFrame:
    """(key, n_articles, expected_articles, code) of documents whose tree and cleaned text disagree: NO_ARTICLES_FOUND,
    MISSING_ARTICLE_1 (the text has its heading, the tree has no such node) or ARTICLE_COUNT_MISMATCH. ``expected``: key,
    article_heading_count, has_heading_article_1; the largest of repeated rows counts. Levels compare in small letters."""
    article = F.lower(F.trim("level")) == "article"
    n = nodes.where(F.col(key).isNotNull()).select(key, "node_id", article.alias("a"), (article & (F.trim("number") == "1")).alias("one")).distinct()
    n = n.groupBy(key).agg(F.count_if("a").alias("n_articles"), F.coalesce(F.max("one"), F.lit(False)).alias("one"))
    e = expected.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("article_heading_count").alias("expected_articles"), F.max("has_heading_article_1").alias("want_one"))
    none = F.col("n_articles") == 0
    codes = F.array_compact(F.array(F.when(none, "NO_ARTICLES_FOUND"), F.when(~none & F.col("want_one") & ~F.col("one"), "MISSING_ARTICLE_1"), F.when(~none & (F.col("n_articles") != F.col("expected_articles")), "ARTICLE_COUNT_MISMATCH")))
    return n.join(e, key).select(key, "n_articles", "expected_articles", F.explode(codes).alias("code"))


def raw_and_cleaned(raw: DataFrame, cleaned: DataFrame, key: str = "raw_artifact_path") -> DataFrame:
    """(key, raw_chars, clean_chars, ratio, flag) of pages that both tables have; flag: possibly_incomplete below 0.2 of
    the raw size, possibly_uncleaned above 0.85. The longest row of each side counts. Only lengths are joined."""
    r = raw.where(F.col(key).isNotNull() & F.col("html").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.length("html")).alias("raw_chars"))
    c = cleaned.where(F.col(key).isNotNull() & F.col("normalized_text").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.length("normalized_text")).alias("clean_chars"))
    ratio = F.round(F.coalesce(F.try_divide("clean_chars", "raw_chars"), F.lit(0.0)), 4)
    return r.join(c, "key").withColumn("ratio", ratio).withColumn("flag", F.when(F.col("ratio") < 0.2, "possibly_incomplete").when(F.col("ratio") > 0.85, "possibly_uncleaned"))


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def line_noise(c: Column | str, phrases: Sequence[str]) -> Column:
    """Share of a text's non-blank lines that hold one of the phrases, case ignored."""
    rows = F.filter(text.lines(c), lambda x: F.trim(x) != "")
    low = [p.lower() for p in phrases]

    def noisy(x):
        hit = F.lit(False)
        for p in low:
            hit = hit | F.contains(F.lower(x), F.lit(p))
        return hit

    return F.round(F.coalesce(F.try_divide(F.size(F.filter(rows, noisy)), F.size(rows)), F.lit(0.0)), 4)
