"""The set signature on texts of a small stock of phrases, where any two texts share some."""

import random
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import canonical, neardup
from lexweave.llm.words import word_hashes

SCORES = canonical.log_scores(np.ones(len(canonical.ALPHABET) ** 2))


def texts(count, seed):
    r = random.Random(seed)
    slots = [[[f"s{s}o{o}w{w}" for w in range(r.randint(3, 7))] for o in range(40)] for s in range(14)]
    out = []
    while len(out) < count:
        words = [w for slot in slots for w in r.choice(slot)]
        out.append(" ".join(words))
        if r.random() < 0.1:
            for _ in range(r.randint(1, 6)):
                p = r.randrange(len(words))
                words[p : p + r.choice([0, 1])] = [f"x{r.randrange(50)}"]
            out.append(" ".join(words))
    return out


def joined(rows, t, k):
    """(pairs of the join by the set signature, pairs of enough similarity)."""
    words, n = word_hashes(rows, SCORES)
    cut = np.concatenate([[0], np.cumsum(n)])
    packed = [words[a:z].tobytes() for a, z in zip(cut, cut[1:])]
    h, doc = neardup._unpack(packed, k)
    size = np.bincount(doc, minlength=len(rows))
    plan = neardup.Plan(t)
    group = plan.group(size)
    parts = neardup.layout(plan, [(int(g), int((group == g).sum()), int(size[group == g].sum())) for g in np.unique(group)])
    levels = np.zeros(neardup.BUCKETS, np.uint8)
    for b in neardup._levels(neardup._counts([pa.record_batch([pa.array(packed, pa.binary())], names=["words"])], k)):
        at = b.column(0)[0].as_py() << 16
        levels[at : at + (1 << 16)] = np.frombuffer(b.column(1)[0].as_py(), np.uint8)
    docs = [pa.record_batch([pa.array(np.arange(a, min(a + 500, len(rows)))), pa.array(size[a : a + 500].astype(np.int32)), pa.array(packed[a : a + 500], pa.binary())], names=["rid", "n", "words"]) for a in range(0, len(rows), 500)]
    sent = [r for b in neardup._contents(docs, k, plan, parts, levels) for r in b.to_pylist()]
    sent.sort(key=lambda r: (r["unit"], r["kind"]))
    found = set()
    for _, unit in groupby(sent, key=lambda r: r["task"]):
        for b in neardup._unit_pairs([pa.RecordBatch.from_pylist([{f: x for f, x in r.items() if f != "task"} for r in unit])], plan):
            found.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    where: dict = {}
    for x, d in zip(h.tolist(), doc.tolist()):
        where.setdefault(x, []).append(d)
    both: dict = {}
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    return found, {(a, b) for (a, b), c in both.items() if c >= t * (size[a] + size[b] - c) - 1e-9}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("t,k", [(0.6, 3), (0.8, 5), (0.3, 2)])
def test_no_pair_is_lost(monkeypatch, small, t, k):
    if small:  # many bundles, blocks and cuts
        monkeypatch.setattr(neardup, "UNIT_BYTES", 30_000)
        monkeypatch.setattr(neardup, "HELD_BYTES", 20_000)
        monkeypatch.setattr(neardup, "MATCHES", 50)
    found, true = joined(texts(900, 3) + ["a b c d e", "a b c d f", "a b c d", "a a a a a a a a", "a a a a a a a a a"], t, k)
    assert len(true) > 20 and true <= found


def test_few_matches_among_shared_phrases(monkeypatch):
    tested = []
    count = np.bitwise_count
    monkeypatch.setattr(neardup.np, "bitwise_count", lambda x: tested.append(len(x)) or count(x))
    rows = texts(3000, 4)
    found, true = joined(rows, 0.6, 3)
    assert true <= found
    assert sum(tested) < 20 * len(rows)
