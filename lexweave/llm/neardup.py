"""Problem 5: near-duplicates with small edits, by Jaccard similarity of word shingles.

Method: deletion-variant signatures. A document's signature is cut into so few segments that two similar documents have
one segment that differs in at most one place; every segment is indexed once for each place left out (one wildcard);
equality joins on the variants give the candidates, and those are verified on the whole shingle sets.

Two signatures are offered:

* ``minhash`` (default): SEGMENTS segments of PLACES min-hash values. A pair of similarity s shares the variant of a
  segment with probability s^r + r s^(r-1) (1-s); with 20 segments of 5 values a pair at 0.6 is missed with probability
  0.0003, at 0.65 with 0.00002, at 0.8 with 1e-13. The number of rows is the same for every document.
* ``sets``: the shingle set itself, cut by hash into segments. Of a set of n shingles at most D = n - t / (1 + t) * (n + l)
  are missing from a partner of l >= n; of c shingles chosen in a segment all pairs are lost only if c - 1 are missing. So the
  smaller set probes with all pairs inside its chosen shingles, chosen so that sum(c - 1) > D, against all pairs inside the
  segments of the larger one: some pair is met, and none of the links is lost. Any choice of that sum is exact, so each set
  takes its rarest shingles, and of neighbours in the text, which come together, only one where it can.

The pairs of a set would be hundreds of rows. So ``sets`` moves what they are made from: the contents of a bundle of segments
of many documents go to one task as packed arrays (:func:`_contents`), where the keys of the probes are held and those of the
index are made as they stream by (:func:`_unit_pairs`). Parity sketches drop pairs that can't reach the threshold before
they leave the join; the sketch test loses nothing. Documents of the same word sequence are one class; pairs are between
classes, and copies hang on their class.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.words import mix, word_hashes
from lexweave.session import materialize, spread

#: Of the min-hash signature: values in a segment, and segments.
PLACES, SEGMENTS = 5, 20
#: Of the set signature: shingles of the largest set of a size group for each segment, and buckets (a power of two) in which
#: shingles are counted, one byte each when broadcast. A size group reaches to 1 / threshold times its least size, so partners
#: are in the next at most. Of two shingles of a segment that begin within NEAR words the more frequent is taken as this frequent.
PER_SEGMENT, BUCKETS, NEAR, TOGETHER = 12, 1 << 22, 6, 0.5
#: 64-bit words of a min-hash row's sketch, bits of a sketch for each shingle of a set signature, and its most words.
SKETCH, SKETCH_BITS, SKETCH_MOST = 4, 1.9, 64
#: Bytes that a task gets of one bundle of segments, or as part of all where that is more, bytes of probes that it holds,
#: shingles of a batch of sets, and matches that are tested at once.
UNIT_BYTES, UNITS, HELD_BYTES, BATCH_SHINGLES, MATCHES = 12_000_000, 10, 200_000_000, 400_000, 500_000

_U = np.uint64


class Plan:
    """Size groups and segment numbers for a threshold."""

    def __init__(self, threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies in (0, 1]")
        self.t = threshold
        self.ratio = min(2.0, max(1.1, 1 / threshold))

    def group(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / math.log(self.ratio) + 1e-9).astype(np.int64)

    def top(self, g: int) -> int:
        """The largest size of a group."""
        n = max(1, int(self.ratio ** (g + 1)) + 1)
        while n > 1 and self.group(np.array([n]))[0] > g:
            n -= 1
        return n

    def differ(self, n, m):
        """Most bits in which sets of these sizes may differ: the overlap must reach t / (1 + t) of the sum."""
        s = n + m
        return s - 2 * np.ceil(self.t / (1 + self.t) * s - 1e-9).astype(np.int64)

    def bottom(self, g: int) -> int:
        """The smallest size of a group."""
        return self.top(g - 1) + 1 if g > 0 else 1

    def need(self, n, g: int):
        """One more than the most shingles of sets of size n that a partner in group g, at least as large, lacks."""
        m = np.maximum(n, self.bottom(g))
        return np.maximum(n - np.ceil(self.t / (1 + self.t) * (n + m) - 1e-9).astype(np.int64), 0) + 1

    @functools.cache
    def segments(self, g: int) -> tuple[int, int]:
        """(segments, shingles in a key) of a group: pairs, unless some set that probes it is too small to do with them."""
        n = np.arange(max(1, math.floor(self.t * self.bottom(g))), self.top(g) + 1)
        most = int((n - self.need(n, g)).min())
        return (max(1, min(self.top(g) // PER_SEGMENT, most)), 2) if most >= 1 else (1, 1)

    def sketch_words(self, g: int) -> int:
        return min(SKETCH_MOST, max(2, math.ceil(SKETCH_BITS * self.top(g) / 64)))


def _runs(h: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All k-word shingles of many documents in their order: (hashes, document numbers, places of their first words)."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(h) - k + 1
    if n < 1:
        return np.array([], _U), np.array([], np.int64), np.array([], np.int64)
    acc = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix(acc * _U(31) + h[j : j + n], j + 1)
    at = np.nonzero(doc[:n] == doc[k - 1 :])[0]
    return acc[at], doc[at], at


def _placed_sets(h: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of :func:`_runs`, each at its first place, sorted by document."""
    acc, doc, at = _runs(h, sizes, k)
    order = np.lexsort((acc, doc))
    acc, doc, at = acc[order], doc[order], at[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[new], doc[new], at[new]


def shingle_sets(h: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of many documents, given their word hashes and numbers of words: (hashes, document
    numbers), sorted by document."""
    return _placed_sets(h, sizes, k)[:2]


def _digests(batches: Iterable[pa.RecordBatch], k: int, least: int, logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, c1, c2, words) of the documents with enough words: the 128-bit digest of the word sequence, and the hashes of
    its words in order, which compress about as well as the text."""
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            words, n = word_hashes(part.column(1).to_pylist(), logp)
            cut = np.concatenate([[0], np.cumsum(n)])
            keep = np.nonzero(n >= max(least, k))[0]
            seqs = [words[cut[i] : cut[i + 1]].tobytes() for i in keep]
            d = [xxhash.xxh3_128_intdigest(x) for x in seqs]
            i64 = lambda xs: pa.array(np.array(xs, _U).view(np.int64) if xs else np.array([], np.int64))
            yield pa.record_batch([part.column(0).take(pa.array(keep, pa.int64())), i64([x >> 64 for x in d]), i64([x & 0xFFFFFFFFFFFFFFFF for x in d]), pa.array(seqs, pa.binary())], names=["id", "c1", "c2", "words"])


def _words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, numbers of words) of packed word hashes."""
    return np.frombuffer(b"".join(words), _U), np.array([len(x) // 8 for x in words], np.int64)


def _unpack(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, documents) of packed word hashes."""
    return shingle_sets(*_words(words), k)


def _with_sizes(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(class_id, words, n): n distinct shingles."""
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            _, doc = _unpack(part.column(1).to_pylist(), k)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(np.bincount(doc, minlength=part.num_rows).astype(np.int32))], names=["class_id", "words", "n"])


def _minhash_variants(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every segment with each of its values left out, and the documents they belong to."""
    rng = np.random.default_rng(20)
    k = PLACES * SEGMENTS
    mul, add = rng.integers(1, 2**63, k, dtype=_U) | _U(1), rng.integers(0, 2**63, k, dtype=_U)
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    keys = np.empty((len(n), k), _U)
    with np.errstate(over="ignore"):
        for s in range(SEGMENTS):
            part = [np.minimum.reduceat((h * mul[i] + add[i]) >> _U(24), starts) for i in range(s * PLACES, (s + 1) * PLACES)]
            for out in range(PLACES):
                key = np.full(len(n), s * PLACES + out, _U)
                for j, x in enumerate(part):
                    if j != out:
                        key = mix(key * _U(31) + x, 7)
                keys[:, s * PLACES + out] = key
    return keys.ravel(), np.repeat(np.arange(len(n)), k)


def _sketches(h: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Parity sketches of ``words`` 64-bit words, a row for each set."""
    bits = mix(h, 77) % _U(64 * words)
    one, word = np.left_shift(_U(1), bits & _U(63)), bits >> _U(6)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == _U(w), one, _U(0)), starts) for w in range(words)], 1)


def _minhash_rows(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, rid, n, b0 ..) of the min-hash variants."""
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            rid = part.column(0).to_numpy(zero_copy_only=False)
            h, doc = _unpack(part.column(1).to_pylist(), k)
            if not len(rid):
                continue
            n = np.bincount(doc, minlength=len(rid))
            sketch = _sketches(h, np.concatenate([[0], np.cumsum(n)])[:-1], SKETCH)
            key, d = _minhash_variants(h, n)
            for a in range(0, len(key), 100_000):
                e = d[a : a + 100_000]
                yield pa.record_batch(
                    [pa.array(key[a : a + 100_000].view(np.int64)), pa.array(rid[e]), pa.array(n[e].astype(np.int32)), *[pa.array(sketch[e, w].view(np.int64)) for w in range(SKETCH)]],
                    names=["key", "rid", "n", *[f"b{w}" for w in range(SKETCH)]],
                )


def _counts(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(block, buckets, counts) of a partition's shingles: blocks of 65,536 buckets, packed."""
    total = np.zeros(BUCKETS, np.uint32)
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            h = _runs(*_words(b.column(0).slice(lo, 2048).to_pylist()), k)[0]
            at, c = np.unique((h & _U(BUCKETS - 1)).astype(np.int64), return_counts=True)
            total[at] += c.astype(np.uint32)
    for block in range(BUCKETS >> 16):
        part = total[block << 16 : (block + 1) << 16]
        if len(at := np.nonzero(part)[0]):
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["block", "at", "counts"])


def _levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, levels): eight times the binary logarithm of each bucket's sum, as bytes."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, at, c in zip(*(x.to_pylist() for x in b.columns)):
            total.setdefault(block, np.zeros(1 << 16))[np.frombuffer(at, np.uint16)] += np.frombuffer(c, np.uint32)
    for block, x in total.items():
        level = np.minimum(np.rint(8 * np.log2(x + 1)), 255).astype(np.uint8)
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])


def frequencies(words: DataFrame, k: int) -> np.ndarray:
    """Levels of all buckets; what is sent to the driver and from there to the tasks are BUCKETS bytes."""
    parts = words.mapInArrow(lambda it: _counts(it, k), "block int, at binary, counts binary").repartition("block")
    out = np.zeros(BUCKETS, np.uint8)
    for r in parts.mapInArrow(_levels, "block int, levels binary").collect():
        out[r["block"] << 16 : (r["block"] + 1) << 16] = np.frombuffer(r["levels"], np.uint8)
    return out


def layout(plan: Plan, groups: Iterable[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Bundles of segments, blocks of probes and number of the first task for every size group that documents are sent to,
    from (group, documents, shingles); each bundle and block is a task. Where the probes of a bundle are more than a task may
    hold, they go to blocks, and the index to each. Of the numbers of bundles that keep a task's share near UNIT_BYTES, or
    near a part of all where that is more, that one is taken that moves the fewest bytes."""
    own = {g: (n, s) for g, n, s in groups}
    docs: dict[int, int] = {}
    shingles: dict[int, int] = {}
    for g, (n, s) in own.items():
        for at in (g, g + 1, g + 2) if plan.ratio * plan.t < 1 - 1e-9 else (g, g + 1):
            docs[at] = docs.get(at, 0) + n
            shingles[at] = shingles.get(at, 0) + s
    unit = max(UNIT_BYTES, sum(7 * s for _, s in own.values()) // UNITS)
    out, tasks = {}, 0
    for g, n in sorted(docs.items()):
        if g not in own:
            continue
        m, fixed = plan.segments(g)[0], 8 * plan.sketch_words(g) + 6
        b = np.arange(1, m + 1)
        # A probe has about 0.6 keys a shingle, of 18 bytes each with their buckets, and sends 0.4 of its shingles.
        blocks = np.maximum(1, np.ceil((11 * shingles[g] / b + (fixed + 12) * n) / HELD_BYTES))
        index = own[g][0] * (b * fixed + 2 * m) + 5 * own[g][1]
        probes = n * (b * fixed + 2 * m) + 2 * shingles[g]
        moved, share = blocks * index + probes, (index + probes / blocks) / b
        pick = int(np.argmin(np.where((share <= unit) | (share <= share.min() * 1.01), moved, np.inf)))
        out[g] = int(b[pick]), int(blocks[pick]), tasks
        tasks += out[g][0] * out[g][1]
    return out


def _chosen(plan: Plan, g: int, n: np.ndarray, doc: np.ndarray, cell: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which shingles the sets of sizes n probe group g with; cells are (document, segment), the rows are sorted by cell and
    frequency. Of c chosen shingles of a segment all keys are lost only if c + 1 - (shingles in a key) are missing, so each
    further one is worth 1; the cheapest are taken, by how often their keys are to be expected."""
    pair = plan.segments(g)[1] == 2
    begins = np.ones(len(cell), bool)
    begins[1:] = cell[1:] != cell[:-1]
    first = np.maximum.accumulate(np.where(begins, np.arange(len(cell)), 0))
    before = np.concatenate([[0.0], np.cumsum(q)])
    cost = q * (before[:-1] - before[first]) if pair else q
    worth = np.nonzero(~begins)[0] if pair else np.arange(len(cell))
    worth = worth[np.lexsort((cost[worth], doc[worth]))]
    mine = doc[worth]
    taken = worth[np.arange(len(worth)) - np.searchsorted(mine, mine) < plan.need(n, g)[mine]]
    last = np.full(len(cell), -1)
    np.maximum.at(last, first[taken], taken)
    return np.arange(len(cell)) <= last[first]


def _pairs_of(vals: np.ndarray, cell: np.ndarray, seg: np.ndarray, doc: np.ndarray, pair: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents): of every pair of values of a cell, or of every value; rows are sorted by cell."""
    with np.errstate(over="ignore"):
        salt = seg.astype(_U) * _U(0x632BE59BD9B4E019)
        if not pair:
            return mix(vals + salt, 3000), doc
        left = np.searchsorted(cell, cell, "right") - 1 - np.arange(len(cell))
        keys, docs, at, k = [], [], np.nonzero(left > 0)[0], 1
        while len(at):
            keys.append(vals[at] + vals[at + k] + salt[at])
            docs.append(doc[at])
            k += 1
            at = at[left[at] >= k]
        return (mix(np.concatenate(keys), 3001), np.concatenate(docs)) if keys else (np.array([], _U), np.array([], np.int64))


FIELDS = ("docs", "sizes", "cells", "vals", "sketches")
CONTENTS = "task int, unit bigint, kind int, base bigint, " + ", ".join(f"{f} binary" for f in FIELDS)


def _contents(batches: Iterable[pa.RecordBatch], k: int, plan: Plan, parts: dict[int, tuple[int, int, int]], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (task, unit, kind, base, packed arrays): for each size group and bundle of its segments the documents of a batch,
    as probes (kind 0) with their chosen shingles, and in their own group as index (kind 1) with all.

    unit is (group, bundle, block); a document's number is base plus ``docs``; ``sizes`` its shingles; ``cells`` those that
    are sent for each segment of the bundle; ``vals`` 40 bits of each, by document and segment.
    """
    for b in batches:
        rids = b.column(0).to_numpy(zero_copy_only=False)
        sizes = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        # Batches of consecutive numbers and of a bounded number of shingles.
        block = np.cumsum(sizes) // BATCH_SHINGLES
        cuts = [0, *(np.nonzero((np.diff(rids) != 1) | (np.diff(block) != 0))[0] + 1).tolist(), len(rids)]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, 4096):
                part = b.slice(at, min(hi, at + 4096) - at)
                if not part.num_rows:
                    continue
                h, doc, place = _placed_sets(*_words(part.column(2).to_pylist()), k)
                rows = _of_batch(h, doc, place, part.num_rows, int(rids[at]), plan, parts, levels)
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * len(FIELDS)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["task", "unit", "kind", "base", *FIELDS])


def _of_batch(h: np.ndarray, doc: np.ndarray, place: np.ndarray, count: int, base: int, plan: Plan, parts: dict[int, tuple[int, int, int]], levels: np.ndarray) -> list[tuple]:
    n = np.bincount(doc, minlength=count)
    own, last = plan.group(n), plan.group(np.floor(n / plan.t + 1e-9).astype(np.int64))
    often = np.exp2(levels[(h & _U(BUCKETS - 1)).astype(np.int64)] / 8.0)
    often /= max(1.0, 2 * often.max())
    out = []
    for g in range(int(own.min()), int(last.max()) + 1):
        pick = (own <= g) & (last >= g) & (n > 0)
        if g not in parts or not pick.any():
            continue
        m, (bundles, blocks, task), words = plan.segments(g)[0], parts[g], plan.sketch_words(g)
        docs = np.nonzero(pick)[0]
        rank = np.full(count, -1)
        rank[docs] = np.arange(len(docs))
        inside = pick[doc]
        x, d, q, p = h[inside], rank[doc[inside]], often[inside], place[inside]
        sketch = _sketches(x, np.concatenate([[0], np.cumsum(n[docs])])[:-1], words)
        seg = (mix(x, 1000 + g) % _U(m)).astype(np.int64)
        cell = d * m + seg
        order = np.lexsort((p, cell))
        x, d, seg, q, p, cell = x[order], d[order], seg[order], q[order], p[order], cell[order]
        near = np.nonzero((cell[1:] == cell[:-1]) & (p[1:] - p[:-1] <= NEAR))[0]
        q[np.where(q[near] >= q[near + 1], near, near + 1)] = TOGETHER
        order = np.lexsort((q, cell))
        x, d, seg, q, cell = x[order], d[order], seg[order], q[order], cell[order]
        value = (mix(x, 2000 + g) >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        head = n[docs].astype(np.uint32)
        mine = int(mix(np.array([base], _U), 5)[0] % _U(blocks))
        for kind, who, sent in ((0, np.ones(len(docs), bool), _chosen(plan, g, n[docs], d, cell, q)), (1, own[docs] == g, np.ones(len(x), bool))):
            if not who.any():
                continue
            sent &= who[d]
            cells = np.bincount(cell[sent], minlength=len(docs) * m).reshape(len(docs), m)
            if cells.max() >= 1 << 16:
                raise ValueError("a segment of more than 65,535 shingles")
            for u in range(bundles):
                first, stop = u * m // bundles, (u + 1) * m // bundles
                c = cells[:, first:stop]
                # A document of no key in the bundle isn't sent.
                some = who & (c >= plan.segments(g)[1]).any(1)
                if not some.any():
                    continue
                vals = value[sent & (seg >= first) & (seg < stop) & some[d]]
                packed = docs[some].astype(np.uint16).tobytes(), head[some].tobytes(), c[some].astype(np.uint16).tobytes(), vals.tobytes(), sketch[some].tobytes()
                for r in range(blocks) if kind else (mine,):
                    out.append((task + u * blocks + r, g << 44 | u << 22 | r, kind, base, *packed))
    return out


def _keyed(row: tuple, plan: Plan, g: int) -> tuple[np.ndarray, ...]:
    """(numbers, sizes, sketches, keys, documents of the keys) of a row of :func:`_contents`."""
    _, _, base, docs, sizes, cells, vals, sketches = row
    rid = np.frombuffer(docs, np.uint16).astype(np.int64) + base
    size = np.frombuffer(cells, np.uint16).astype(np.int64)
    width = len(size) // len(rid)
    v = np.zeros((int(size.sum()), 8), np.uint8)
    v[:, :5] = np.frombuffer(vals, np.uint8).reshape(-1, 5)
    cell = np.repeat(np.arange(len(size)), size)
    keys, doc = _pairs_of(v.view(_U).ravel(), cell, cell % width, cell // width, plan.segments(g)[1] == 2)
    return rid, np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(sketches, _U).reshape(len(rid), -1), keys, doc


class Probes:
    """The probes of one unit, their keys in buckets by the leading bits."""

    def __init__(self, rows: list[tuple], plan: Plan, g: int):
        got = [_keyed(r, plan, g) for r in rows]
        self.plan, self.g = plan, g
        self.rid, n, self.sketch, keys = (np.concatenate([x[k] for x in got]) for k in range(4))
        self.n = n.astype(np.int32)
        start = np.cumsum([0, *(len(x[0]) for x in got)])
        doc = np.concatenate([(x[4] + at).astype(np.int32) for x, at in zip(got, start)])
        del got
        order = np.argsort(keys)
        self.keys, self.doc = keys[order], doc[order]
        self.shift = _U(64 - max(1, (len(keys) - 1).bit_length()))
        self.starts = np.zeros((1 << (64 - int(self.shift))) + 1, np.int32)
        self.starts[1:] = np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=len(self.starts) - 1))

    def pairs(self, row: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of numbers of a probe and a document of the row that meet in a key, and whose sizes and sketches let them
        reach the threshold."""
        rid, n, sketch, keys, doc = _keyed(row, self.plan, self.g)
        bucket = (keys >> self.shift).astype(np.int64)
        lo = self.starts[bucket].astype(np.int64)
        count = self.starts[bucket + 1] - lo
        hit = count > 0
        lo, count, keys, doc = lo[hit], count[hit], keys[hit], doc[hit]
        upto = np.concatenate([[0], np.cumsum(count)])
        t, words, a = self.plan.t, sketch.shape[1], 0
        while a < len(lo):
            z = max(a + 1, int(np.searchsorted(upto, upto[a] + MATCHES, "right")) - 1)
            # One key of very many probes is cut as well.
            for part in range(0, max(1, int(upto[z] - upto[a])), MATCHES):
                at = np.arange(upto[a] + part, min(upto[z], upto[a] + part + MATCHES))
                k = np.searchsorted(upto, at, "right") - 1 if z == a + 1 else np.repeat(np.arange(a, z), count[a:z])
                e = lo[k] + at - upto[k]
                same = self.keys[e] == keys[k]
                p, i = self.doc[e[same]], doc[k[same]]
                np_, ni = self.n[p], n[i]
                ok = ((np_ < ni) | ((np_ == ni) & (self.rid[p] < rid[i]))) & (np_ + 1e-6 >= t * ni)
                p, i = p[ok], i[ok]
                s = self.n[p] + n[i]
                most = s - 2 * np.ceil(t / (1 + t) * s - 1e-9)
                differ = np.zeros(len(p), np.int64)
                for w in range(words):
                    differ += np.bitwise_count(self.sketch[p, w] ^ sketch[i, w])
                    if w % 2 or w == words - 1:
                        ok = differ <= most
                        p, i, most, differ = p[ok], i[ok], most[ok], differ[ok]
                if len(p):
                    x, y = self.rid[p], rid[i]
                    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                    yield pair[:, 0], pair[:, 1]
            a = z


def _unit_pairs(batches: Iterable[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and kind: (ra, rb). The probes of a unit are held, its index streams by."""
    held: list[tuple] = []
    probes, unit = None, None
    for b in batches:
        for j in range(b.num_rows):
            row = tuple(c[j].as_py() for c in b.columns)
            if row[0] != unit:
                held, probes, unit = [], None, row[0]
            if row[1] == 0:
                held.append(row)
                continue
            if held:
                probes, held = Probes(held, plan, unit >> 44), []
            if probes is not None:
                for x, y in probes.pairs(row):
                    yield pa.record_batch([pa.array(x), pa.array(y)], names=["ra", "rb"])


def _verified(batches: Iterable[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """(ka, kb, wa, wb) to the pairs of enough similarity, from the whole shingle sets."""
    for b in batches:
        keep, sims = [], []
        for j, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            h, doc = _unpack([x, y], k)
            common = len(h) - len(np.unique(h))
            sim = common / max(1, len(h) - common)
            if sim >= least - 1e-12:
                keep.append(j)
                sims.append(sim)
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(sims, pa.float64())], names=["ka", "kb", "similarity"])


def near_duplicates(docs: DataFrame, logp: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = 0.8, shingle: int = 5, min_words: int = 1, signature: str = "minhash") -> tuple[DataFrame, DataFrame]:
    """(members, pairs).

    ``members``: (id, class_id) for every distinct id and word sequence of at least ``min_words`` words (and at least one
    shingle), words in canonical form and lower-cased; class_id is the smallest id with the same word sequence.
    ``pairs``: (class_a, class_b, similarity) of different classes, class_a < class_b, Jaccard similarity of the shingle
    sets at least ``threshold``, found by the ``signature`` (see the module's text on what each guarantees). Null ids and texts take no part; repeated rows count once.
    """
    kind = dict(docs.dtypes)[key]
    plan = Plan(threshold)
    d = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null"))
    words = materialize(d.mapInArrow(lambda it: _digests(it, shingle, min_words, logp), f"id {kind}, c1 bigint, c2 bigint, words binary"))
    first = words.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.any_value("words").alias("words"))
    classes = words.select("id", "c1", "c2").groupBy("c1", "c2").agg(F.min("id").alias("class_id"))
    members = words.select("id", "c1", "c2").distinct().join(classes, ["c1", "c2"]).select("id", "class_id")
    # The number of a class is written with it, so that it stays the same in all that follows.
    reps = first.select("class_id", "words").mapInArrow(lambda it: _with_sizes(it, shingle), f"class_id {kind}, words binary, n int")
    reps = materialize(reps.where("n > 0").withColumn("rid", F.monotonically_increasing_id()))
    if signature == "minhash":
        sig = "key bigint, rid bigint, n int, " + ", ".join(f"b{w} bigint" for w in range(SKETCH))
        rows = reps.select("rid", "words").mapInArrow(lambda it: _minhash_rows(it, shingle), sig)
        share = threshold / (1 + threshold)
        total = F.col("i.n") + F.col("p.n")
        # Sketches whose parity differs in more bits than the sets may can't be of a pair.
        differ = sum((F.bit_count(F.col(f"i.b{w}").bitwiseXOR(F.col(f"p.b{w}"))) for w in range(SKETCH)), F.lit(0))
        near = (F.col("p.n") <= F.col("i.n")) & (F.col("p.n") + F.lit(1e-6) >= threshold * F.col("i.n")) & (differ <= total - 2 * F.ceil(share * total - F.lit(1e-9)))
        cond = (F.col("i.key") == F.col("p.key")) & (F.col("i.rid") != F.col("p.rid")) & near
        found = rows.alias("i").join(rows.alias("p"), cond).select(F.least("i.rid", "p.rid").alias("ra"), F.greatest("i.rid", "p.rid").alias("rb"))
    else:
        # A row for each size group, of which a threshold has a few dozen.
        group = F.floor(F.log(F.col("n")) / F.lit(math.log(plan.ratio)) + F.lit(1e-9)).cast("int")
        sizes = reps.groupBy(group.alias("g")).agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).collect()
        parts = layout(plan, [(r["g"], r["docs"], r["shingles"]) for r in sizes])
        levels = frequencies(reps.select("words"), shingle)
        sent = reps.select("rid", "n", "words").mapInArrow(lambda it: _contents(it, shingle, plan, parts, levels), CONTENTS)
        tasks = sum(bundles * blocks for bundles, blocks, _ in parts.values())
        found = sent.repartitionById(max(1, tasks), "task").drop("task").sortWithinPartitions("unit", "kind").mapInArrow(lambda it: _unit_pairs(it, plan), "ra bigint, rb bigint")
    found = found.distinct()
    a = reps.select(F.col("rid").alias("ra"), F.col("class_id").alias("ka"), F.col("words").alias("wa"))
    b = reps.select(F.col("rid").alias("rb"), F.col("class_id").alias("kb"), F.col("words").alias("wb"))
    both = found.join(a, "ra").join(b, "rb").select("ka", "kb", "wa", "wb")
    checked = both.mapInArrow(lambda it: _verified(it, shingle, threshold), f"ka {kind}, kb {kind}, similarity double")
    return members, checked.select(F.least("ka", "kb").alias("class_a"), F.greatest("ka", "kb").alias("class_b"), "similarity")
