"""Main text of stored web pages, with block-aware lines. Parsing is sequential in a page and runs in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import spread

BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 div br tr td th article section main body header footer nav aside ul ol table form figure".split())
SKIPPED = frozenset("script style noscript template svg head iframe".split())
FURNITURE = frozenset("nav aside footer header form".split())
MAIN = frozenset("article main".split())
_SPACE = re.compile(r"\s+")
_ARTICLE = re.compile(r"^\s*điều\s+\d+", re.I | re.M)


class _Reader(HTMLParser):
    """Collects (line, inside main, inside furniture). Unclosed and stray tags don't matter: only depth per kind counts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, bool]] = []
        self.part: list[str] = []
        self.depth = dict.fromkeys(("skip", "main", "furniture"), 0)

    def flush(self) -> None:
        line = _SPACE.sub(" ", "".join(self.part)).strip()
        line = re.sub(r"\s+([,.;:!?)])", r"\1", line)
        if line:
            self.lines.append((line, self.depth["main"] > 0, self.depth["furniture"] > 0))
        self.part = []

    def _change(self, tag: str, by: int) -> None:
        for kind, tags in (("skip", SKIPPED), ("main", MAIN), ("furniture", FURNITURE)):
            if tag in tags:
                self.depth[kind] = max(0, self.depth[kind] + by)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self._change(tag, 1)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self._change(tag, -1)

    def handle_data(self, data):
        if not self.depth["skip"]:
            self.part.append(data)


def read_lines(page: str) -> list[tuple[str, bool, bool]]:
    r = _Reader()
    r.feed(re.sub(r"<[^<>]*$", "", page))  # a tag that the page's end cuts off is no text
    r.close()
    r.flush()
    return r.lines


def main_text(page: str) -> str:
    """Of the candidates (lines in main elements, lines outside furniture, all lines) the first with the most article
    headings, and by length among equals."""
    rows = read_lines(page)
    options = [[x for x, m, _ in rows if m], [x for x, _, f in rows if not f], [x for x, _, _ in rows]]
    texts = ["\n".join(o) for o in options if o]
    return max(texts, key=lambda t: (len(_ARTICLE.findall(t)), -texts.index(t))) if texts else ""


def extract(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, main_text, n_lines, n_articles) of every page with html; cut-off pages give what they hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string()), pa.array([len(x.split("\n")) if x else 0 for x in out], pa.int32()), pa.array([len(_ARTICLE.findall(x)) for x in out], pa.int32())], names=["key", "main_text", "n_lines", "n_articles"])

    kind = dict(pages.dtypes)[key]
    return spread(pages.select(F.col(key).alias("key"), F.col(html)).where(F.col("key").isNotNull() & F.col(html).isNotNull())).mapInArrow(run, f"key {kind}, main_text string, n_lines int, n_articles int")


def profile(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, n_lines, n_main, n_furniture, n_articles, n_articles_main): lines of a page by where they stand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_lines(x) for x in b.column(1).to_pylist()]
            count = lambda f: pa.array([sum(map(f, g)) for g in got], pa.int32())
            art = lambda r: bool(_ARTICLE.match(r[0]))
            yield pa.record_batch([b.column(0), count(lambda r: 1), count(lambda r: r[1]), count(lambda r: r[2]), count(art), count(lambda r: r[1] and art(r))], names=["key", "n_lines", "n_main", "n_furniture", "n_articles", "n_articles_main"])

    kind = dict(pages.dtypes)[key]
    return spread(pages.select(F.col(key).alias("key"), F.col(html)).where(F.col("key").isNotNull() & F.col(html).isNotNull())).mapInArrow(run, f"key {kind}, n_lines int, n_main int, n_furniture int, n_articles int, n_articles_main int")
