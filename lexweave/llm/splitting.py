"""Problem 1: items longer than a limit, cut at natural boundaries with overlap.

Method: recursive bisection. A span longer than the limit minus the overlap is cut at the strongest boundary near its
midpoint and both halves are treated alike; afterwards each piece but the first is extended back by the overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, strongest first: before an article heading, before a clause, before a point, after a blank line,
#: after a line, after a sentence, after a semicolon, after a comma or colon, at a space.
BOUNDARIES: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("heading", re.compile(r"\n(?=\s*(?:Phần|Chương|Mục|Điều|Part|Chapter|Section|Article)\s)")),
    ("clause", re.compile(r"\n(?=\s*\d+[.)]\s)")),
    ("point", re.compile(r"\n(?=\s*[a-zđ]\)\s)")),
    ("paragraph", re.compile(r"\n[ \t]*\n+")),
    ("line", re.compile(r"\n+")),
    ("sentence", re.compile(r"[.!?…][”\"»)]*\s+")),
    ("semicolon", re.compile(r";\s+")),
    ("comma", re.compile(r"[,:]\s+")),
    ("space", re.compile(r"\s+")),
)
#: A cut may lie this share of the span away from the midpoint, at most.
REACH = 0.3


def _marks(text: str) -> list[tuple[int, int]]:
    """(position after the boundary, kind), by position, each position with its strongest kind."""
    best: dict[int, int] = {}
    for kind, (_, pattern) in enumerate(BOUNDARIES):
        for m in pattern.finditer(text):
            best.setdefault(m.end(), kind)
    return sorted(best.items())


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces of a text as (core start, core end, start with overlap, boundary that ends it).

    Cores follow one another without gap; ``text[start:end]`` is a piece, at most ``max_chars`` code points long, and
    shares exactly ``overlap`` characters with the piece before. A text within the limit is one piece, an empty one has
    none. Where a span has no boundary in reach, the nearest one counts; without any, the cut is at the midpoint.
    """
    if max_chars <= 0 or overlap < 0 or overlap >= max_chars:
        raise ValueError("the limit must be positive and larger than the overlap")
    if not text:
        return []
    if len(text) <= max_chars:
        return [(0, len(text), 0, "end")]
    room = max_chars - overlap
    marks = _marks(text)
    from bisect import bisect_left, bisect_right

    at, kinds = [p for p, _ in marks], dict(marks)
    cuts: dict[int, str] = {len(text): "end"}
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        # The first core has no overlap before it, so it may fill the limit.
        if hi - lo <= (max_chars if lo == 0 else room):
            continue
        mid = (lo + hi) // 2
        reach = max(1, int((hi - lo) * REACH))
        near = marks[bisect_left(at, mid - reach) : bisect_right(at, mid + reach)]
        near = [m for m in near if lo < m[0] < hi]
        if near:
            cut, kind = min(near, key=lambda m: (m[1], abs(m[0] - mid), m[0]))
            name = BOUNDARIES[kind][0]
        else:
            i = bisect_left(at, mid)
            around = [p for p in at[max(0, i - 1) : i + 1] if lo < p < hi]
            cut = min(around, key=lambda p: (abs(p - mid), p)) if around else mid
            while not around and cut > lo + 1 and unicodedata.combining(text[cut]):
                cut -= 1  # a letter keeps its marks
            name = BOUNDARIES[kinds[cut]][0] if around else "none"
        cuts[cut] = name
        todo += [(lo, cut), (cut, hi)]
    out, start = [], 0
    for end in sorted(cuts):
        out.append((start, end, max(0, start - overlap), cuts[end]))
        start = end
    return out


PIECES = "item_id string, field_name string, piece_no int, n_pieces int, start_offset int, end_offset int, overlap_chars int, boundary string, piece string"


def _pieces(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    for df in frames:
        rows = []
        for item, field, value, most, lap in zip(df["item_id"], df["field_name"], df["value"], df["max_chars"], df["overlap_chars"]):
            parts = split_text(value, int(most), int(lap))
            for k, (a, b, s, kind) in enumerate(parts, 1):
                rows.append((item, field, k, len(parts), s, b, a - s, kind, value[s:b]))
        yield pd.DataFrame(rows, columns=names)


def oversized(items: DataFrame, limits: DataFrame, key: str, kind: str, fields: tuple[str, ...]) -> DataFrame:
    """(item_id, field_name, value, max_chars, overlap_chars) of the values above the limit of their kind, once each.

    Null keys, kinds and values never count; lengths are in Unicode characters. ``limits`` has one row for each kind and
    field (kind, field_name, max_chars, overlap_chars); of repeated rows the smallest limit holds. The limits become one
    literal map per field when they are at most 10,000 rows, and are joined otherwise.
    """
    lim = limits.where("max_chars is not null").groupBy(F.col(kind).alias("kind"), "field_name").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l"))
    few = lim.limit(10_001).collect()
    base = items.select(F.col(key).cast("string").alias("item_id"), F.col(kind).alias("kind"), *[F.col(f).alias(f) for f in fields if f not in (key, kind)])
    base = base.where(F.col("item_id").isNotNull() & F.col("kind").isNotNull())
    if len(few) <= 10_000:
        parts = []
        for f in fields:
            own = [r for r in few if r["field_name"] == f and r["kind"] is not None]
            if not own:
                continue
            most = F.create_map(*[F.lit(x) for r in own for x in (r["kind"], r["l"]["max_chars"])])
            lap = F.create_map(*[F.lit(x) for r in own for x in (r["kind"], r["l"]["overlap_chars"] or 0)])
            parts.append(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.try_element_at(most, F.col("kind")).alias("max_chars"), F.try_element_at(lap, F.col("kind")).alias("overlap_chars")))
        if not parts:
            return items.sparkSession.createDataFrame([], "item_id string, field_name string, value string, max_chars int, overlap_chars int")
        # The filter stands inside the array so that values within the limit are dropped before rows multiply.
        over = F.filter(F.array(*parts), lambda p: F.length(p["value"]) > p["max_chars"])
        long = base.select("item_id", F.explode(over).alias("p")).select("item_id", "p.*")
    else:
        long = base.select("item_id", "kind", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("p"))
        long = long.select("item_id", "kind", "p.*").join(lim.select("kind", "field_name", "l.*"), ["kind", "field_name"])
        long = long.where(F.length("value") > F.col("max_chars")).select("item_id", "field_name", "value", "max_chars", "overlap_chars")
    return long.dropDuplicates(["item_id", "field_name", "value"])


def split_oversized(items: DataFrame, limits: DataFrame, key: str = "chunk_id", kind: str = "chunk_kind", fields: tuple[str, ...] = ("text", "parent_text")) -> DataFrame:
    """Ordered pieces of every oversized value: columns of :data:`PIECES`.

    Repeated rows give their pieces once; a key that stands for several different values gives the pieces of each.
    Empty tables give an empty result. Only oversized values leave the JVM.
    """
    return oversized(items, limits, key, kind, fields).mapInPandas(_pieces, PIECES)
