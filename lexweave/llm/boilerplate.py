"""Problem 6: the document itself, without what the site put around or between its lines.

Method: line-block distribution. Markup is stripped, each line gets a mass (the length of its running text), masses are
summed over sliding windows of lines, and the text between the surge and the dive of that distribution is kept:

* A line has mass if it shows running text or structure: a sentence (closing punctuation), a line too long for a label, a
  numbered or lettered provision, a heading. Labels, link lists and slogans have none, however many they are.
* The windows whose sum reaches RISE times the page's median sum make regions. The region of the largest mass is the
  document; a neighbour joins it over a gap of at most GAP lines if it is not small beside it. So a notice above the
  menu and a numbered list in a sidebar are regions of their own and stay out.
* Surge and dive are the region's first and last line of structure, moved outwards over structure that a window joins to
  it (a title above an advertisement). Between them the lines without mass were put in by the site.

Nothing but these sums moves the bounds; the forms of lines only say what has mass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.canonical import canonical
from lexweave.session import spread

#: Lines of a window; share of the median window sum from which a window belongs to a region; most lines without mass
#: between regions that join, and least share of the main region's mass for that; mass of a line of structure besides its
#: length; characters from which a line is no label; provisions that make a document, or sentences where it has no heading.
WINDOW, RISE, GAP, JOIN, FLOOR, LONG = 5, 0.25, 8, 0.1, 20, 90
PROVISIONS, SENTENCES = 3, 5
# Forms of lines in statutes (Vietnamese and English).
HEADING = re.compile(r"(?:phần|chương|mục|tiểu mục|part|chapter|section)\s+(?:thứ\s+\w+|[ivxlc]+|\d+)\b[.:]?\s*(.*)$", re.I)
ARTICLE = re.compile(r"(?:điều|article)\s+\d+[a-zđ]?\s*[.:]", re.I)
PREAMBLE = re.compile(r"(?:căn cứ|xét|theo (?:đề nghị|kiến nghị)|pursuant to|having regard to|on the proposal)\b", re.I)
CLOSING = re.compile(r"(?:nơi nhận\s*:?$|[-–]?\s*lưu\s*:)", re.I)
TITLE = re.compile(r"\w[\w ]{2,80}\s\d{4}$")
POINT = re.compile(r"[a-zđ]\)\s*\S")
NUMBERED = re.compile(r"(?:[-–—•+*]|\d{1,3}[.)])\s*\S")
LINKS = re.compile(r"\s[»|·>/]\s|\S {2,}\S.*\S {2,}\S")
END = re.compile(r"(?:[.;:]|\(…\))[”\"»)]*$")
TAGS = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^<>]*>", re.I | re.S)


def strip_markup(line: str) -> str:
    """A line without tags and character references; lines without either are returned as they are."""
    return html.unescape(TAGS.sub("", line)) if "<" in line or "&" in line else line


def line_form(s: str) -> str:
    """The form of a stripped canonical line: '' blank, h heading, u capitals, p preamble, e numbered, lettered or closing
    line, s sentence or long line, - without mass."""
    if not s:
        return ""
    if LINKS.search(s):
        return "-"
    if (m := HEADING.match(s)) and len(s) < 150 and not END.search(m.group(1)):
        return "h"
    if ARTICLE.match(s):
        return "h"
    if POINT.match(s) or CLOSING.match(s):
        return "e"
    whole = END.search(s) is not None
    if whole and PREAMBLE.match(s):
        return "p"
    if NUMBERED.match(s):
        return "e" if whole or len(s) > LONG else "-"
    letters = [c for c in s if c.isalpha()]
    if len(letters) > 2 and all(c.isupper() for c in letters):
        return "u"
    return "s" if whole or len(s) > LONG else "-"


def masses(lines: list[str], forms: list[str]) -> np.ndarray:
    return np.array([0 if f in ("", "-") else len(x) + (FLOOR if f != "s" else 0) for x, f in zip(lines, forms)], np.float64)


def line_blocks(mass: np.ndarray | list, window: int = WINDOW) -> np.ndarray:
    """Sum of the masses of ``window`` lines from each line on."""
    c = np.concatenate([[0], np.cumsum(mass)])
    n = len(mass)
    return c[np.minimum(np.arange(n) + window, n)] - c[:-1]


def regions(blocks: np.ndarray, rise: float = RISE) -> list[tuple[int, int]]:
    """(first, last) of the runs of windows whose sum reaches ``rise`` times the median of the sums that are not 0."""
    some = blocks[blocks > 0]
    if not len(some):
        return []
    edge = np.diff(np.concatenate([[0], (blocks >= rise * np.median(some)).astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))


def surge_and_dive(lines: list[str], forms: list[str], window: int = WINDOW, rise: float = RISE) -> tuple[int, int] | None:
    """First and last of the non-blank ``lines`` that belong to the document; None where a page has none."""
    mass = masses(lines, forms)
    # A line's window has as many lines before it as after it.
    runs = regions(line_blocks(np.pad(mass, (window // 2, 0)), window)[: len(mass)], rise)
    if not runs:
        return None
    total = [float(mass[a : z + 1].sum()) for a, z in runs]
    low = high = max(range(len(runs)), key=lambda k: total[k])
    least = JOIN * total[low]
    while low and runs[low][0] - runs[low - 1][1] <= GAP and total[low - 1] >= least:
        low -= 1
    while high + 1 < len(runs) and runs[high + 1][0] - runs[high][1] <= GAP and total[high + 1] >= least:
        high += 1
    first, last = runs[low][0], runs[high][1]
    inside = range(first, last + 1)
    if any(forms[k] == "h" for k in inside):
        body = [k for k in inside if forms[k] in "he"]
        if len(body) < PROVISIONS:
            return None
        surge, dive = next(k for k in inside if forms[k] in ("h", "u", "p")), body[-1]
        tail = any(forms[k] == "s" for k in range(body[0], dive))
    else:  # a document without headings: its sentences are the body
        body = [k for k in inside if forms[k] in ("s", "e")]
        if len(body) < SENTENCES:
            return None
        surge, dive, tail = body[0], body[-1], True
    reach = window // 2 + 1
    surge = _outwards(forms, surge, -1, ("h", "u", "p"), reach)
    dive = _outwards(forms, dive, 1, ("h", "e"), reach)
    # Sentences below the last provision belong to the document if it has such between its provisions.
    while tail and dive < last and forms[dive + 1] == "s":
        dive += 1
    # A title in small letters has no mass; it is the nearest such line above the surge.
    if not any(forms[k] == "u" and TITLE.search(lines[k]) for k in range(surge, min(surge + window + 1, dive))):
        surge = next((k for k in range(surge - 1, max(-1, surge - 1 - reach), -1) if forms[k] == "-" and TITLE.match(lines[k])), surge)
    return surge, dive


def _outwards(forms: list[str], at: int, step: int, kinds: tuple[str, ...], reach: int) -> int:
    """The last line of structure that steps of at most ``reach`` lines lead to."""
    while True:
        near = [k for k in range(at + step * reach, at, -step) if 0 <= k < len(forms) and forms[k] in kinds]
        if not near:
            return at
        at = near[0]


def page_mask(text: str, logp: np.ndarray, window: int = WINDOW, rise: float = RISE) -> tuple[list[bool], list[bool]]:
    """For each line of a page whether it belongs to the document, and whether it is blank. Blank lines between surge and
    dive belong to it. A page without a document keeps no line."""
    lines = text.split("\n")
    plain = (canonical(text, logp) or "").split("\n")
    if len(plain) != len(lines):
        plain = [canonical(x, logp) for x in lines]
    blank = [not x.strip() for x in plain]
    plain = [strip_markup(x).strip() for x in plain]
    forms = [line_form(x) for x in plain]
    at = [k for k, f in enumerate(forms) if f]
    keep = [False] * len(lines)
    found = surge_and_dive([plain[k] for k in at], [forms[k] for k in at], window, rise) if at else None
    if found:
        first, last = at[found[0]], at[found[1]]
        for k in range(first, last + 1):
            keep[k] = forms[k] != "-" or k == first
    return keep, blank


def content_mask(text: str, logp: np.ndarray, window: int = WINDOW, rise: float = RISE) -> list[bool]:
    """For each line of a page, whether it belongs to the document."""
    return page_mask(text, logp, window, rise)[0]


def _lines(batches: Iterable[pa.RecordBatch], logp: np.ndarray, kept: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, nos, texts = [], [], []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for no, (line, ok, blank) in enumerate(zip(text.split("\n"), *page_mask(text, logp)), 1):
                if ok == kept and not blank:
                    paths.append(path)
                    nos.append(no)
                    texts.append(line)
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(nos, pa.int64()), pa.array(texts, pa.string())], names=["raw_artifact_path", "line_no", "line"])


def page_lines(pages: DataFrame, logp: np.ndarray, kept: bool, key: str = "raw_artifact_path", text: str = "normalized_text") -> DataFrame:
    """(raw_artifact_path, line_no, line): the non-blank lines of the documents (``kept``) or those that the sites added.

    One page is one task's row, never shuffled; equal rows of a page give their lines once. Null keys or texts give no row.
    """
    p = spread(pages.select(F.col(key).cast("string"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()))
    return p.mapInArrow(lambda it: _lines(it, logp, kept), "raw_artifact_path string, line_no bigint, line string")


def main_text(pages: DataFrame, logp: np.ndarray, key: str = "raw_artifact_path", text: str = "normalized_text") -> DataFrame:
    """(raw_artifact_path, main_text): each row's document; empty where the page only reports an error."""

    def run(batches):
        for b in batches:
            out = ["\n".join(x for x, ok in zip(t.split("\n"), content_mask(t, logp)) if ok).strip("\n") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["raw_artifact_path", "main_text"])

    p = spread(pages.select(F.col(key).cast("string"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()))
    return p.mapInArrow(run, "raw_artifact_path string, main_text string")
