"""Statute text to headings, spans, a section tree and chunks.

Recognizing headings is sequential in a document (a heading counts only in the context of those before it), so it is a
function over the lines of one document, run in Arrow batches; all that follows from its rows is relational.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.lineforms import WORDS, Form, Words, cites_article, follows_plainly, has_footnote, is_date, is_formula, is_repealed_clause, line_form

#: Levels from the whole text down.
LEVELS = ("law", "part", "chapter", "section", "article", "clause", "point")
#: Nodes that are held against their document's text at once.
SPAN_BLOCK = 1000
BREAKS = "\r\n\v\f\x1c\x1d\x1e\x85\u2028\u2029"


@dataclass(frozen=True)
class Heading:
    """A line that heads a unit. status: certain, ambiguous or rejected; only certain ones make units."""

    level: str
    number: str
    title: str | None
    start: int
    end: int
    status: str = "certain"
    reason: str | None = None


@dataclass(frozen=True)
class Boundary:
    """A line at which a region that isn't the statute's own text begins."""

    kind: str
    start: int


def line_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, line) in code points; ends lie before the line break."""
    out, at = [], 0
    for raw in text.splitlines(keepends=True):
        line = raw.rstrip(BREAKS)
        out.append((at, at + len(line), line))
        at += len(raw)
    return out


def title_like(line: str) -> bool:
    """At least three quarters of the letters are capitals, 150 characters at most, no closing punctuation."""
    s = line.strip()
    letters = [c for c in s if c.isalpha()]
    return bool(letters) and len(s) <= 150 and s[-1] not in ".,;:" and sum(c.isupper() for c in letters) >= 0.75 * len(letters)


def scan(text: str, words: Words = WORDS) -> tuple[list[Heading], list[Boundary]]:
    """Headings of every status, and boundaries, in order.

    A clause needs an article, a point a clause. Source notes, appendices and tables begin regions in which clauses and
    points are rejected; a note that quotes or cites another statute's articles swallows all that follows, unless the next
    article of the own numbering comes. A number without its dot is a clause only if a point or the next clause follows.
    Parts and chapters take the next line as their title if it reads like one.
    """
    rows = [(s, e, x) for s, e, x in line_spans(text) if x.strip()]
    kinds = [line_form(x, words) for _, _, x in rows]
    heads: list[Heading] = []
    bounds: list[Boundary] = []
    article: str | None = None
    clause: str | None = None
    note = ""  # "", "first" (nothing of it seen), "open" or "tail"
    region = ""  # "", "appendix" or "table"
    for i, ((start, end, line), m) in enumerate(zip(rows, kinds)):
        if m.kind == "tail" and article is None:
            m = line_form(line, words, tails=False)
        kind = m.kind
        if kind in ("note", "tail", "appendix", "table", "signature"):
            bounds.append(Boundary({"tail": "note"}.get(kind, kind), start))
            clause = None
            if kind in ("note", "tail"):
                note = "tail" if kind == "tail" or has_footnote(line) else "first"
            elif kind != "signature":
                region = "appendix" if kind == "appendix" or region == "appendix" else "table"
            continue
        if note == "tail":
            continue
        if note:
            quoted, cited = line.lstrip()[:1] in ("“", '"'), cites_article(line, words)
            own = kind == "article" and int(re.match(r"\d+", m.number)[0]) == (int(re.match(r"\d+", article)[0]) + 1 if article else 1)
            if quoted or (cited and (note == "first" or not own)):
                note = "tail"
                continue
            note = "" if cited and own else "open"
        shut = "source_note" if note else region
        here = start + len(line) - len(line.lstrip())
        stop = start + len(line.rstrip())
        if kind in ("part", "chapter"):
            title = rows[i + 1][2].strip() if i + 1 < len(rows) and not kinds[i + 1].kind and title_like(rows[i + 1][2]) else None
            heads.append(Heading(kind, m.number, title, here, stop))
            article = clause = None
        elif kind == "section":
            heads.append(Heading(kind, m.number, m.title, here, stop))
            article = clause = None
        elif kind == "article" and region != "appendix":
            heads.append(Heading(kind, m.number, m.title, here, stop))
            article, clause, note, region = m.number, None, "", ""
        elif kind == "point":
            why = shut or (None if clause else "no_clause")
            heads.append(Heading(kind, m.number, None, here, stop, "rejected" if why else "certain", why or None))
        elif kind in ("clause", "loose"):
            why = shut or ("date" if is_date(line, words) else None if article else "no_article")
            status = "rejected" if why else "certain"
            if not why and kind == "loose":
                if is_formula(line):
                    status, why = "rejected", "formula"
                elif not _confirmed(line, m, rows, kinds, i, words):
                    status, why = "ambiguous", "malformed_number"
            heads.append(Heading("clause", m.number, None, here, stop, status, why or None))
            if status == "certain":
                clause = m.number
    return heads, bounds


def _confirmed(line: str, m: Form, rows: list, kinds: list[Form], i: int, words: Words) -> bool:
    """Whether what follows a number without dot shows that it heads a clause."""
    if line[m.end : m.end + 1] == ".":
        return False
    if is_repealed_clause(line, words):
        return True
    if i + 1 >= len(rows):
        return False
    after = kinds[i + 1]
    return after.kind == "point" or (after.kind == "clause" and follows_plainly(rows[i + 1][2]) and int(after.number) == int(m.number) + 1)


def headings(text: str, words: Words = WORDS) -> list[Heading]:
    """The certain headings."""
    return [h for h in scan(text, words)[0] if h.status == "certain"]


def segment(text: str, found: list[Heading], bounds: list[Boundary] = ()) -> list[tuple[Heading, int]]:
    """Each heading with the end of its span: the next heading of the same or a higher level or the next boundary, whichever
    comes first. A signature or a table ends a span only as far as it is a boundary: signatures where no heading follows,
    tables never."""
    rank = {k: i for i, k in enumerate(LEVELS)}
    last = found[-1].start if found else -1
    cuts = sorted(b.start for b in bounds if b.kind in ("note", "appendix") or (b.kind == "signature" and b.start >= last))
    ends = [len(text)] * len(found)
    open_: list[tuple[int, int]] = []
    for i, h in enumerate(found):
        while open_ and open_[-1][0] >= rank[h.level]:
            ends[open_.pop()[1]] = h.start
        open_.append((rank[h.level], i))
    out = []
    for h, e in zip(found, ends):
        k = bisect_right(cuts, h.start)
        out.append((h, min(e, cuts[k]) if k < len(cuts) else e))
    return out


def _toneless(s: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))


def id_token(level: str, number: str) -> str:
    """A heading's number as a part of an id: without marks (d-bar stays), other signs as underscores."""
    n = number.strip()
    if level == "chapter" and re.fullmatch(r"[IVXLCivxlc]+", n):
        return n.upper()
    n = n.lower() if level in ("part", "article", "point") else n
    return re.sub(r"[^0-9A-Za-zđĐ-]+", "_", _toneless(n)).strip("_")


NODES = "doc_id string, node_id string, level string, number string, title string, text string, start_offset int, end_offset int, parent_id string, ordinal int"


def tree(doc_id: str, text: str, words: Words = WORDS) -> list[tuple]:
    """Rows of :data:`NODES`: the root (level law) and every segment below the nearest open unit of a higher level. Of
    siblings with the same number the later ones get ``__occurrence_n``. A unit that its parent's span doesn't hold (a
    boundary cut the parent before it) has no place in the tree and is left out with what is below it."""
    rank = {k: i for i, k in enumerate(LEVELS)}
    root = f"{doc_id}__root"
    rows = [(doc_id, root, "law", None, None, text, 0, len(text), None, 0)]
    stack = [(0, root)]
    used: dict[str, int] = {}
    found, bounds = scan(text, words)
    spans = {root: len(text)}
    for k, (h, end) in enumerate(segment(text, [x for x in found if x.status == "certain"], bounds), 1):
        while stack[-1][0] >= rank[h.level]:
            stack.pop()
        parent = stack[-1][1]
        if end > spans[parent] or (h.level == "point" and stack[-1][0] != rank["clause"]) or (h.level == "clause" and stack[-1][0] != rank["article"]):
            continue
        base = f"{parent}__{h.level}_{id_token(h.level, h.number)}"
        used[base] = used.get(base, 0) + 1
        node = base if used[base] == 1 else f"{base}__occurrence_{used[base]}"
        rows.append((doc_id, node, h.level, h.number, h.title, text[h.start : end], h.start, end, parent, k))
        stack.append((rank[h.level], node))
        spans[node] = end
    return rows


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: Words = WORDS) -> DataFrame:
    """Section tree of every document as node rows (:data:`NODES`). Null ids and texts give none; a text without headings
    is its root alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODES.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.string() for c in NODES.split(", ")]
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [r for d, t in zip(*(c.to_pylist() for c in part.columns)) for r in tree(d, t, words)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(doc_id).cast("string"), F.col(text)).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, NODES)


def label(level, number):
    """Vietnamese label of a level and number."""
    names = F.create_map(*[F.lit(x) for kv in (("part", "Phần"), ("chapter", "Chương"), ("section", "Mục"), ("article", "Điều"), ("clause", "Khoản"), ("point", "Điểm")) for x in kv])
    return F.concat_ws(" ", F.try_element_at(names, level), number)


def chunk(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Leaf chunks of section trees: articles without clauses, clauses without points, and points; with citation,
    hierarchy path, article context and hashes. ``names``: (doc_id, law_name), optional.

    Ancestors are at most six levels up: they are taken from windows over the document's order, not by joins."""
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    # The nearest open ancestor of a level: the last one seen, if it spans this node.
    n = nodes
    for lv in LEVELS[1:]:
        seen = F.last(F.when(F.col("level") == lv, F.struct("node_id", "number", "title", "start_offset", "end_offset", *(["text"] if lv == "article" else []))), True).over(order)
        n = n.withColumn(f"a_{lv}", seen)
        n = n.withColumn(f"a_{lv}", F.when(F.col(f"a_{lv}.end_offset") >= F.col("end_offset"), F.col(f"a_{lv}")))
    has_child = nodes.where("level in ('clause', 'point')").select(F.col("parent_id").alias("node_id")).distinct().withColumn("has_child", F.lit(True))
    leaf = n.where("level in ('article', 'clause', 'point')").join(has_child, "node_id", "left").where("has_child is null")
    if names is not None:
        leaf = leaf.join(names.select("doc_id", "law_name"), "doc_id", "left")
    else:
        leaf = leaf.withColumn("law_name", F.col("doc_id"))
    seg = lambda lv: F.when(F.col(f"a_{lv}").isNotNull(), F.concat_ws(". ", label(F.lit(lv), F.col(f"a_{lv}.number")), F.col(f"a_{lv}.title")))
    cite = lambda lv: F.when(F.col(f"a_{lv}").isNotNull(), label(F.lit(lv), F.col(f"a_{lv}.number")))
    body = F.regexp_replace("text", r"(?iu)^\s*điều\s+\d+[a-zđ]?\s*\.[^\n]*", "")
    empty = (F.col("level") == "article") & ~body.rlike(r"\S")
    repealed = F.col("text").rlike(r"(?iu)\(\s*được\s+bãi\s+bỏ\s*\)|(?:^|[^\p{L}])(?:điều|khoản|điểm)\s+này\s+được\s+bãi\s+bỏ(?![\p{L}])")
    kind = F.when(F.col("level") != "article", F.concat("level", F.lit("_level"))).when(empty | repealed, "article_level_empty").otherwise("article_level")
    return leaf.select(
        F.concat("node_id", F.lit("__chunk")).alias("chunk_id"), F.col("doc_id").alias("law_id"), "law_name", "level", kind.alias("chunk_kind"), F.col("node_id").alias("source_node_id"),
        F.col("a_article.node_id").alias("parent_article_node_id"), F.col("a_article.number").alias("article_number"), F.col("a_article.title").alias("article_title"),
        F.col("a_clause.number").alias("clause_number"), F.col("a_point.number").alias("point_label"),
        F.concat_ws(", ", "law_name", cite("point"), cite("clause"), cite("article")).alias("citation"), F.concat_ws(" / ", "law_name", *[seg(x) for x in LEVELS[1:]]).alias("hierarchy_path"),
        "text", F.col("a_article.text").alias("parent_text"), "start_offset", "end_offset", F.col("a_article.start_offset").alias("article_start_offset"), F.col("a_article.end_offset").alias("article_end_offset"),
        F.sha2("text", 256).alias("text_hash"), F.sha2("a_article.text", 256).alias("parent_text_hash"), (empty | repealed).alias("is_empty_or_repealed"),
    )


def source_warnings(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """(chunk_id, source_warnings, caveat_references) of the chunks whose own node or article has issues (node_id, code):
    the codes, and ``code:node`` references, each once and in order. Chunks without any have no row."""
    own = chunks.select("chunk_id", F.explode(F.array_distinct(F.array_compact(F.array("source_node_id", "parent_article_node_id")))).alias("node_id"))
    j = own.join(issues.where("node_id is not null").select("node_id", "code").distinct(), "node_id")
    # A chunk has two nodes, and a node as many issues as there are codes.
    return j.groupBy("chunk_id").agg(F.sort_array(F.collect_set("code")).alias("source_warnings"), F.sort_array(F.collect_set(F.concat_ws(":", "code", "node_id"))).alias("caveat_references"))


def empty_article_warnings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, code, source_node_id) of article chunks that keep an empty or repealed article."""
    return chunks.where((F.col("level") == "article") & F.col("is_empty_or_repealed")).select("chunk_id", F.lit("EMPTY_ARTICLE_CHUNK").alias("code"), "source_node_id")


def tree_issues(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, code) of broken invariants of section trees: duplicate ids, missing or wrong roots, parents that
    no row has, levels that can't be below each other, spans outside the parent's, overlapping siblings, texts that are
    not their span of the root's text."""
    rank = F.create_map(*[F.lit(x) for i, lv in enumerate(LEVELS) for x in (lv, i)])
    n = nodes.withColumn("rank", F.try_element_at(rank, "level"))
    p = n.select("doc_id", F.col("node_id").alias("parent_id"), F.col("rank").alias("p_rank"), F.col("start_offset").alias("p_start"), F.col("end_offset").alias("p_end"))
    dup = n.groupBy("doc_id", "node_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "node_id", F.lit("DUPLICATE_NODE_ID").alias("code"))
    roots = n.groupBy("doc_id").agg(F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id").isNull() & (F.col("level") == "law")).alias("laws"))
    root = roots.where("roots <> 1 or laws <> 1").select("doc_id", F.lit(None).cast("string").alias("node_id"), F.lit("ROOT_COUNT").alias("code"))
    j = n.where("parent_id is not null").join(p.dropDuplicates(["doc_id", "parent_id"]), ["doc_id", "parent_id"], "left")
    codes = F.filter(F.array(F.when(F.col("p_rank").isNull(), F.lit("PARENT_MISSING")), F.when(F.col("p_rank") >= F.col("rank"), F.lit("LEVEL_NOT_BELOW_PARENT")), F.when((F.col("start_offset") < F.col("p_start")) | (F.col("end_offset") > F.col("p_end")), F.lit("OUTSIDE_PARENT"))), lambda x: x.isNotNull())
    link = j.select("doc_id", "node_id", F.explode(codes).alias("code"))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("start_offset", "node_id")
    over = n.where("parent_id is not null").withColumn("before", F.lag("end_offset").over(w)).where("before > start_offset").select("doc_id", "node_id", F.lit("SIBLINGS_OVERLAP").alias("code"))
    # A document's text meets its spans in blocks of about SPAN_BLOCK, not once for each node; no document's nodes gather.
    whole = n.where("parent_id is null").groupBy("doc_id").agg(F.max("text").alias("whole"))
    blocks = n.groupBy("doc_id").agg(F.ceil(F.count("*") / SPAN_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("node_id"), F.col("blocks")).alias("block")
    spans = n.join(blocks, "doc_id").groupBy("doc_id", block).agg(F.collect_list(F.struct("node_id", "start_offset", "end_offset", F.xxhash64("text").alias("h"), F.length("text").alias("k"))).alias("spans"))
    wrong = F.filter("spans", lambda s: s["h"].isNotNull() & s["k"].isNotNull() & (F.xxhash64(F.substring(F.col("whole"), s["start_offset"] + 1, s["end_offset"] - s["start_offset"])) != s["h"]))
    cut = whole.join(spans, "doc_id").select("doc_id", F.explode(wrong).alias("s")).select("doc_id", "s.node_id", F.lit("TEXT_NOT_SPAN").alias("code"))
    return dup.unionByName(root).unionByName(link).unionByName(over).unionByName(cut)
