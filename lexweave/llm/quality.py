"""Problem 10: per-document text statistics, and prose told apart from lists, tables and junk.

Method: the robust Mahalanobis distance of a document's statistics from the mean and covariance of prose in its
language, with each statistic's contribution. Outlying documents get the kind whose own distribution is nearest.

The fit uses labelled rows: at most ``max_labels`` of them, drawn by seeded hash (a parameter; 20,000 by default). The
statistics of every document are computed over its whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.canonical import _COMPAT, IGNORABLE
from lexweave.session import spread

# Frequent function words of Vietnamese (with and without accents) and English.
_VI = "và của là có các được cho trong theo với không khi này một người tại từ do thì đã về để đến phải hoặc nếu trên những bên việc quy định trường hợp ngày nhưng sau trước cần như bị ở mà"
_EN = "the of and to in a is that it for on with as be by or an this are not at from if shall under within when who which but has have must may"
COMMON = {"vi": frozenset(_VI.split()), "en": frozenset(_EN.split())}


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d")


COMMON["vi_bare"] = frozenset(_bare(_VI).split()) - COMMON["en"]

WORD = re.compile(r"[^\W_]+")
ITEM = re.compile(r"\s*(?:[-–—•*+·▪◦]|\d{1,3}[.)]|[a-zđ][.)]|[ivx]+[.)])\s+")
CELLS = re.compile(r"\||\t|;(?=\S)| {2,}|,(?=[^\s\d])")
STOP = re.compile(r"[.!?…][”\"»)\]]*\s*$")
WIDE = re.compile("[\u00a0\u00ad\u0300-\u036f\u2000-\u200f\u202f\u2060\u3000\ufeff\uff01-\uff5e]")
CLOSE = re.compile(r"[.!?…:;][”\"»)\]]*\s*$")
SENTENCE = re.compile(r"[.!?…;:,](?:\s|$)")
CODE = re.compile(r"[{}<>=\\_@#^~`$+/�\x80-\x9f]+")
MISREAD = re.compile(r"[ÃÂÄÅÆ][\x80-¿]|á[º»]")
DIGITS = re.compile(r"\d+")

STATS = (
    "word_count", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "digit_share", "words_per_line",
    "item_share", "cell_share", "sentence_char_share", "distinct_words", "distinct_pairs", "single_share", "long_word_share",
    "code_ratio", "punct_per_word", "line_len_spread", "cells_per_line",
)


def unwrapped(lines: list[str]) -> list[str]:
    """Sentences broken over lines as one line each: a run of lines of three words or more, none of them an item or a row
    of cells, whose first to end with a full stop is its last. Other lines stay as they are."""
    out: list[str] = []
    run: list[str] = []
    for x in lines:
        if STOP.search(x) and run:
            out.append(" ".join([*run, x]))
            run = []
        elif CLOSE.search(x) or x.count(" ") < 2 or ITEM.match(x) or CELLS.search(x.strip()):
            out += run
            out.append(x)
            run = []
        else:
            run.append(x)
    return out + run


def statistics(text: str) -> tuple[str, list[float]]:
    """(language, values of :data:`STATS`) of a text that isn't blank. Shares lie in 0 .. 1."""
    if not text.isascii() and WIDE.search(text):
        text = unicodedata.normalize("NFC", IGNORABLE.sub("", text).translate(_COMPAT))
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \n\t\r"))
    alnum = sum(map(len, words))
    lines = unwrapped([x for x in text.split("\n") if x.strip()])
    seen = Counter(words)
    shares = {k: sum(seen[w] for w in v) / max(1, n) for k, v in COMMON.items()}
    lang = max(shares, key=lambda k: (shares[k], k))
    if shares[lang] < 0.03:
        lang = "none"
    per_line = [len(x) for x in lines]
    total = max(1, sum(per_line))
    ends = [bool(CLOSE.search(x)) for x in lines]
    items = [bool(ITEM.match(x)) and len(x) < 160 for x in lines]
    cells = [len(CELLS.findall(x.strip())) for x in lines]
    width = Counter(c for c in cells if c).most_common(1)
    same = sum(1 for c in cells if c and width and c == width[0][0])
    # Sentences: lines of ten words or more that close with punctuation or hold marks between words, few digits.
    marks = [len(SENTENCE.findall(x)) for x in lines]
    sent = 0
    for x, e, c, k in zip(lines, ends, cells, marks):
        if len(x) >= 60 and (e or k >= 2):
            gaps = x.count(" ")
            if gaps >= 9 and gaps * 2.2 < len(x) and c < gaps / 4:
                sent += len(x)
    pairs = len(set(zip(words, words[1:])))
    mean_len = total / max(1, len(lines))
    spread = math.sqrt(sum((x - mean_len) ** 2 for x in per_line) / max(1, len(lines))) / max(1.0, mean_len)
    return lang, [
        math.log1p(n),
        alnum / max(1, n),
        (chars - alnum) / max(1, chars),
        sum(ends) / max(1, len(lines)),
        max(shares.values()),
        sum(map(len, DIGITS.findall(text))) / max(1, chars),
        math.log1p(n / max(1, len(lines))),
        sum(items) / max(1, len(lines)),
        same / max(1, len(lines)),
        sent / total,
        len(seen) / max(1.0, n**0.75),
        pairs / max(1, n - 1),
        sum(c for w, c in seen.items() if len(w) == 1) / max(1, n),
        sum(c for w, c in seen.items() if len(w) > 12) / max(1, n),
        (sum(map(len, CODE.findall(text))) + (2 * len(MISREAD.findall(text)) if "º" in text or "»" in text or "Ã" in text else 0)) / max(1, chars),
        sum(marks) / max(1, n),
        spread,
        math.log1p(sum(cells) / max(1, len(lines))),
    ]


_SCHEMA = "doc_id {kind}, lang string, stats array<double>"


def _stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [statistics(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["doc_id", "lang", "stats"])


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang, stats) of every document whose text is not null or blank; ``stats`` follows :data:`STATS`."""
    kind = dict(docs.dtypes)[doc_id]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull())
    return d.mapInArrow(_stats, _SCHEMA.format(kind=kind))


def robust_fit(x: np.ndarray, keep: float = 0.85, steps: int = 10, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance after concentration steps: the share ``keep`` nearest by the last fit is fitted again.
    The start is median and scaled median deviation; the covariance is shrunk towards its diagonal."""
    mid = np.median(x, 0)
    dev = 1.4826 * np.median(np.abs(x - mid), 0) + 0.02
    d = (((x - mid) / dev) ** 2).sum(1)
    h = max(min(len(x), x.shape[1] + 2), int(keep * len(x)))
    inv = np.diag(1 / dev**2)
    for _ in range(steps):
        near = x[np.argsort(d, kind="stable")[:h]]
        mid = near.mean(0)
        cov = np.cov(near, rowvar=False, bias=True).reshape(x.shape[1], -1)
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 5e-3 * np.eye(x.shape[1])
        inv = np.linalg.inv(cov)
        new = np.einsum("ij,jk,ik->i", x - mid, inv, x - mid)
        if np.allclose(new, d):
            break
        d = new
    return mid, inv


@dataclass
class Model:
    """Prose of each language, the other kinds, and the distance beyond which a document is no prose."""

    prose: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    kinds: dict[str, tuple[np.ndarray, np.ndarray, float]] = field(default_factory=dict)
    bound: float = 0.0

    def judge(self, lang: list[str], x: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(squared distance from prose, kind, contributions that add up to the distance)."""
        dist, share = np.zeros(len(x)), np.zeros_like(x)
        groups = np.array([g if g in self.prose else "" for g in lang], dtype=object)
        for g in set(groups):
            own = groups == g
            mid, inv = self.prose[g]
            diff = x[own] - mid
            share[own] = diff * (diff @ inv)
            dist[own] = share[own].sum(1)
        names = sorted(self.kinds)
        score = np.full((len(x), len(names)), np.inf)
        for j, k in enumerate(names):
            mid, inv, const = self.kinds[k]
            score[:, j] = np.einsum("ij,jk,ik->i", x - mid, inv, x - mid) + const
        best = score.argmin(1) if names else np.zeros(len(x), int)
        # Outlying, and nearer to a kind's own distribution than to prose.
        out = (dist > self.bound) & (score.min(1) < dist + self.lean) if names else np.zeros(len(x), bool)
        return dist, [names[b] if o else "prose" for o, b in zip(out, best)], share

    lean: float = 0.0


def fit(lang: list[str], x: np.ndarray, kind: list[str]) -> Model:
    """A model of labelled statistics. Languages with fewer than 40 prose rows share the prose of all; a kind with few
    rows borrows the covariance of all rows of the other kinds."""
    m = Model()
    kinds = np.array(kind)
    langs = np.array(lang)
    prose = kinds == "prose"
    if not prose.any():
        raise ValueError("no labelled prose")
    m.prose[""] = robust_fit(x[prose])
    for g in sorted(set(langs[prose])):
        own = prose & (langs == g)
        if own.sum() >= 40:
            m.prose[g] = robust_fit(x[own])
    others = [k for k in ("junk", "list", "table") if (kinds == k).any()]
    centred = [x[kinds == k] - x[kinds == k].mean(0) for k in others]
    if others:
        pooled = np.cov(np.concatenate(centred), rowvar=False, bias=True)
        for k in others:
            rows = x[kinds == k]
            w = len(rows) / (len(rows) + 3.0 * x.shape[1])
            cov = w * np.cov(rows, rowvar=False, bias=True) + (1 - w) * pooled if len(rows) > 1 else pooled
            cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-3 * np.eye(x.shape[1])
            m.kinds[k] = (rows.mean(0), np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1]))
        low = min(c for _, _, c in m.kinds.values())
        m.kinds = {k: (a, b, c - low) for k, (a, b, c) in m.kinds.items()}
    # The bound and lean that err least on the labelled rows; among equals the middle ones.
    m.bound, m.lean = -1.0, np.inf
    dist, _, _ = m.judge(list(langs), x)
    best = min(
        ((sum((np.array(_kinds(m, langs, x, b, lean)) != kinds)), abs(math.log(b / 60.0)) + abs(lean) / 100, b, lean) for b in (15, 20, 25, 30, 40, 50, 60, 80, 100, 130, 170, 220, 300, 400) for lean in (-40, -20, 0, 20, 60, 150, 400, 1e6)),
        key=lambda t: t[:2],
    )
    m.bound, m.lean = float(best[2]), float(best[3])
    return m


def _kinds(m: Model, langs, x, bound: float, lean: float) -> list[str]:
    cache = getattr(m, "_cache", None)
    if cache is None:
        m.bound, m.lean = -1.0, np.inf
        dist, best, _ = m.judge(list(langs), x)
        names = sorted(m.kinds)
        score = np.full(len(x), np.inf)
        for k in names:
            mid, inv, const = m.kinds[k]
            score = np.minimum(score, np.einsum("ij,jk,ik->i", x - mid, inv, x - mid) + const)
        cache = m._cache = (dist, best, score)
    dist, best, score = cache
    return [b if d > bound and s < d + lean else "prose" for d, b, s in zip(dist, best, score)]


def fit_labels(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled documents: all of them up to ``max_labels``, else that many by seeded hash; the labels
    that are broadcast are as many at most. Labels other than prose, list, table and junk are left out; of repeated labels one counts."""
    lab = labels.where(F.col("kind").isin("prose", "list", "table", "junk")).groupBy("doc_id").agg(F.min("kind").alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(lab), "doc_id")
    # One row for each labelled document, however often it stands: at most max_labels come to the driver.
    once = d.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = document_statistics(once.select("doc_id", "text")).join(F.broadcast(lab), "doc_id").select("lang", "stats", "kind").collect()
    if not rows:
        raise ValueError("no labelled documents")
    m = fit([r["lang"] for r in rows], np.array([r["stats"] for r in rows]), [r["kind"] for r in rows])
    m._cache = None
    return m


def _judge(batches: Iterable[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [statistics(t) for t in b.column(1).to_pylist()]
        if not got:
            continue
        dist, kinds, share = m.judge([g[0] for g in got], np.array([g[1] for g in got]))
        yield pa.record_batch(
            [b.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array(dist), pa.array(list(share), pa.list_(pa.float64())), pa.array(kinds)],
            names=["doc_id", "lang", "stats", "distance", "contributions", "kind"],
        )


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang, stats, distance, contributions, kind) of every document with text. Null or blank texts have no row;
    repeated rows keep theirs. A pass over the documents without shuffle."""
    kind = dict(docs.dtypes)[doc_id]
    d = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull()))
    return d.mapInArrow(lambda it: _judge(it, model), f"doc_id {kind}, lang string, stats array<double>, distance double, contributions array<double>, kind string")
