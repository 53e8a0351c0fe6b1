"""Problem 8: evaluation items leaking into training text.

Method: a BM25 inverted index of the test items with block-max WAND. Every passage of ``run`` consecutive words of every
document is a query; all items whose score reaches their threshold are retrieved and verified field by field, word by
word. The index's terms are shingles of five words: test items share their vocabulary with the corpus, so single words
don't tell them apart (with them three quarters of all passages reached a threshold).

The threshold loses nothing: an item's score for a query that is one of its own runs is the sum of the impacts of that
run's distinct words, so the smallest such sum over the item's runs bounds every true leak from below. Impacts are
divided by it, which makes the threshold 1 for all items.

The corpus is read and hashed once for all indexes that fit into SCAN_BYTES, not once for each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.words import mix, word_hashes
from lexweave.session import in_sets, spread

#: BM25 parameters; items in a block of postings; items in an index; bytes of the indexes that one scan of the corpus is
#: held against (about 3 kB an item; a further scan is made beyond it).
K1, B = 1.2, 0.75
BLOCK_ITEMS = 32
INDEX_ITEMS = 16_384
SCAN_BYTES = 128_000_000
#: Words in a term; what a score may stay below the threshold for rounding.
TERM_WORDS = 5
NEARLY = 1 - 1e-4
#: Terms whose postings a worker keeps as lists.
CACHED_TERMS = 100_000

_U = np.uint64


def term_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles that begin at each word but the last k - 1."""
    n = max(0, len(word_hashes) - k + 1)
    acc = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = (acc ^ (acc >> _U(29))) * _U(0xBF58476D1CE4E5B9) + word_hashes[j : j + n]
    return acc ^ (acc >> _U(32))


def _inside(texts: np.ndarray, k: int) -> np.ndarray:
    """Whether the k places from each one lie in the same text; ``texts``: the text of each place, in order."""
    n = max(0, len(texts) - k + 1)
    return texts[:n] == texts[k - 1 :] if n else np.zeros(0, bool)


class ItemIndex:
    """Inverted index of items in flat arrays: postings by (term, item), and the largest impact of each term in each block
    of items."""

    def __init__(self, ids: list[str], words: np.ndarray, sizes: np.ndarray, item: np.ndarray, field: np.ndarray, run: int):
        """``words``: word hashes of all texts one after another, ``sizes`` words of text, of ``item`` and ``field``."""
        self.run, self.ids = run, ids
        self.width = min(TERM_WORDS, run)
        self.span = run - self.width + 1  # terms in a passage
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        inside = _inside(text_of, self.width)
        h, text_of = term_hashes(words, self.width)[inside], text_of[: len(inside)][inside]
        # Term numbers: 1 + place in the sorted hashes; 0 is any term of no item.
        self.hashes, term = np.unique(h, return_inverse=True)
        owner = item[text_of] if len(text_of) else np.zeros(0, np.int64)
        n, terms = len(ids), max(1, len(self.hashes))
        pair, place, tf = np.unique(owner * terms + term, return_inverse=True, return_counts=True)
        p_item, p_term = pair // terms, pair % terms
        df = np.bincount(p_term, minlength=terms)
        length = np.bincount(p_item, weights=tf, minlength=n)
        mean = max(1.0, length.sum() / max(1, n))
        idf = np.log(1 + (n - df[p_term] + 0.5) / (df[p_term] + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[p_item] / mean))
        # Every run of an item as a row of its postings; a term that repeats in a run counts once.
        at = np.nonzero(_inside(text_of, self.span))[0]
        rows = np.sort(place[at[:, None] + np.arange(self.span)[None, :]], axis=1) if len(at) else np.zeros((0, self.span), np.int64)
        first = np.ones(rows.shape, bool)
        first[:, 1:] = rows[:, 1:] != rows[:, :-1]
        least = np.full(n, np.inf)
        if len(at):
            np.minimum.at(least, owner[at], (impact[rows] * first).sum(1))
        # Items without a full run can't leak and have no postings.
        keep = np.isfinite(least[p_item])
        p_item, p_term, impact = p_item[keep], p_term[keep], (impact / least[p_item])[keep]
        order = np.lexsort((p_item, p_term))
        self.item, self.impact = p_item[order].astype(np.int32), impact[order]
        self.start = np.concatenate([[0, 0], np.cumsum(np.bincount(p_term, minlength=len(self.hashes)))])
        self.term_max = np.zeros(len(self.hashes) + 1)
        np.maximum.at(self.term_max, p_term + 1, impact)
        block = p_term[order] * (n // BLOCK_ITEMS + 1) + self.item // BLOCK_ITEMS
        edge = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
        self.block_of = np.cumsum(edge) - 1  # of each posting
        self.block_max = np.maximum.reduceat(self.impact, np.nonzero(edge)[0]) if len(block) else np.zeros(0)
        # What verifies: a run's words in a field of an item.
        fields = field[text_of[at]] if len(at) else np.zeros(0, np.int64)
        self.runs = np.unique(self._run_key(term_hashes(h, self.span)[at] if len(at) else np.zeros(0, _U), owner[at], fields))
        self.fields = int(field.max()) + 1 if len(field) else 0
        self._lists: dict[int, tuple] = {}

    @staticmethod
    def _run_key(run_hash: np.ndarray, item: np.ndarray, field: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(run_hash + (np.asarray(item) * 64 + np.asarray(field)).astype(_U) * _U(0x9E3779B97F4A7C15), 5)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.item, self.impact, self.start, self.term_max, self.block_of, self.block_max, self.runs)) + sum(map(len, self.ids))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def _postings(self, t: int) -> tuple[list[int], list[float], list[float], float]:
        """A term's items, impacts, largest impact in each posting's block, and largest of all."""
        got = self._lists.get(t)
        if got is None:
            if len(self._lists) >= CACHED_TERMS:
                self._lists.clear()
            a, z = int(self.start[t]), int(self.start[t + 1])
            got = self._lists[t] = self.item[a:z].tolist(), self.impact[a:z].tolist(), self.block_max[self.block_of[a:z]].tolist(), float(self.term_max[t])
        return got

    def wand(self, terms: list[int]) -> Iterator[int]:
        """The items whose score for the distinct ``terms`` reaches 1, by block-max WAND: cursors over the postings in order
        of items. The pivot is the first item that the terms up to its cursor could bring to the threshold; if the maxima
        of the blocks there can't, the cursors before it jump past the nearest end of a block."""
        cursors = [[p[0][0], 0, *p] for t in terms if t and (p := self._postings(t))[0]]  # item, place and the postings
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= NEARLY:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = cursors[pivot][0]
            block = item // BLOCK_ITEMS
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound = score = 0.0
            near = cursors[: pivot + 1]
            for c in near:
                if c[0] < item:
                    c[1] = bisect_left(c[2], item, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
                if c[0] // BLOCK_ITEMS == block:
                    bound += c[4][c[1]]
                    if c[0] == item:
                        score += c[3][c[1]]
            if bound >= NEARLY:
                if score >= NEARLY:
                    yield item
                past = item + 1
            else:
                past = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    past = max(item + 1, min(past, cursors[pivot + 1][0]))
            for c in near:
                if 0 <= c[0] < past:
                    c[1] = bisect_left(c[2], past, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def search(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document number, item number, field, passages) once each. ``words``: word hashes of documents one after
        another; ``ends``: where each document ends."""
        if len(words) < self.run or not len(self.hashes):
            return
        hashed = term_hashes(words, self.width)
        terms = self.number(hashed)
        # A passage whose summed upper bounds stay below the threshold has no pivot (a repeated term only raises its sum).
        s = np.concatenate([np.zeros(1), np.cumsum(self.term_max[terms])])
        start = np.nonzero(s[self.span :] - s[: -self.span] >= NEARLY - 1e-9 * s[-1])[0]
        doc = np.searchsorted(ends, start, side="right")
        inside = start + self.run <= ends[doc]
        start, doc = start[inside], doc[inside]
        if not len(start):
            return
        whole = terms.tolist()
        hits = [(j, item) for j, at in enumerate(start.tolist()) for item in self.wand(sorted(set(whole[at : at + self.span])))]
        if not hits:
            return
        # What was retrieved is verified word by word in each field, all at once.
        j, item = np.array(hits, np.int64).T
        own = term_hashes(hashed, self.span)[start[j]]
        for f in range(self.fields):
            key = self._run_key(own, item, np.full(len(item), f))
            at = np.minimum(np.searchsorted(self.runs, key), len(self.runs) - 1)
            same = self.runs[at] == key
            pairs, counts = np.unique(np.stack([doc[j[same]], item[same]], 1), axis=0, return_counts=True)
            for (of, k), n in zip(pairs.tolist(), counts.tolist()):
                yield of, k, f, n


def _scan(batches: Iterable[pa.RecordBatch], indexes: list[ItemIndex], fields: tuple[str, ...], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            words, n = word_hashes(part.column(1).to_pylist(), logp)
            ends = np.cumsum(n)
            hits = [(d, ix.ids[k], fields[f], m) for ix in indexes for d, k, f, m in ix.search(words, ends)]
            docs, items, names, counts = zip(*hits) if hits else ((), (), (), ())
            yield pa.record_batch(
                {"doc_id": part.column(0).take(pa.array(docs, pa.int64())), "item_id": pa.array(items, pa.string()), "field": pa.array(names, pa.string()), "n_passages": pa.array(counts, pa.int64())}
            )


def _indexes(rows: DataFrame, fields: tuple[str, ...], run: int, logp: np.ndarray) -> Iterator[ItemIndex]:
    for part in in_sets(rows, "id", INDEX_ITEMS):
        texts, item, field = [], [], []
        for k, r in enumerate(part):
            for f in range(len(fields)):
                for t in sorted(r[f"f{f}"]):
                    texts.append(t)
                    item.append(k)
                    field.append(f)
        words, sizes = word_hashes(texts, logp)
        yield ItemIndex([r["id"] for r in part], words, sizes, np.array(item, np.int64), np.array(field, np.int64), run)


def find_leak_fields(docs: DataFrame, items: DataFrame, logp: np.ndarray, run: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "id", fields: tuple[str, ...] = ("query", "reference_answer")) -> DataFrame:
    """(doc_id, item_id, field, n_passages): the document holds n_passages passages of ``run`` consecutive words that the
    item's field has. Of repeated document rows the most passages stand.

    Null and short texts and fields match nothing; repeated documents and items count once; an empty table gives an empty
    result. Items are indexed in sets of :data:`INDEX_ITEMS`; all indexes that fit into :data:`SCAN_BYTES` are broadcast
    together and held against every document in one scan. The documents are never shuffled.
    """
    if not 1 <= len(fields) <= 64:
        raise ValueError("1 to 64 fields")
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, item_id string, field string, n_passages bigint"
    rows = items.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).cast("string").alias("id")).agg(*[F.collect_set(f).alias(f"f{k}") for k, f in enumerate(fields)])
    base = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    groups: list[list[ItemIndex]] = []
    filled = 0
    for index in _indexes(rows, fields, run, logp):
        if not groups or filled + index.nbytes() > SCAN_BYTES:
            groups.append([])
            filled = 0
        groups[-1].append(index)
        filled += index.nbytes()
    out = None
    for group in groups:
        shared = docs.sparkSession.sparkContext.broadcast(group)
        found = base.mapInArrow(lambda it, own=shared: _scan(it, own.value, fields, logp), schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id", "field").agg(F.max("n_passages").alias("n_passages"))


def find_leaks(docs: DataFrame, items: DataFrame, logp: np.ndarray, run: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "id", fields: tuple[str, ...] = ("query", "reference_answer")) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``run`` consecutive words of a field of the item; cases as in
    :func:`find_leak_fields`."""
    return find_leak_fields(docs, items, logp, run, doc_id, text, item_id, fields).select("doc_id", "item_id").distinct()
