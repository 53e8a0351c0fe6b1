"""Problem 7: text that looks the same, in one consistent form.

Method: delete ignorable characters, apply compatibility normalization (only the mappings that keep the look), compose,
and search each line's look-alike lattice with Viterbi under script-consistent character-bigram scores.

The bigram scores are trained on all texts given (:func:`train`); their table is bounded by the fixed alphabet below
(``len(ALPHABET) ** 2`` counts), whatever the corpus size, so it may go to the driver and into closures.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import spread

# Characters that are not seen (default-ignorable code points and invisible format controls).
IGNORABLE = re.compile(
    r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻\U000e0000-\U000e0fff]"
)
# Letters of other scripts (or other Latin letters) that look like a Latin letter, from the public confusables data.
LOOKALIKES = {
    **dict(zip("аеорсухіѕјһԁԛԝѵ", "aeopcyxisjhdqwv")),
    **dict(zip("АВЕКМНОРСТУХІЅЈԌԚԜ", "ABEKMHOPCTYXISJGQW")),
    **dict(zip("ονρυικϲϳ", "ovpuikcj")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ")),
    **dict(zip("ÐƉðոսօցհ", "ĐĐđnuoqh")),
    **dict(zip("ӀӏүҮѡ", "IlyYw")),
    **dict(zip("յՏՕԼ", "jSOL")),
    **dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ")),
    **dict(zip("ɡɑıᴄᴏᴠᴡᴢꜱ", "gaicovwzs")),
}
# Those that are letters of the same script; only the n-gram score and the Vietnamese letter decide on them.
SAME_SCRIPT = set("ÐƉðɡɑı")
# Compatibility characters with a look of their own, kept as they are.
KEPT = set("µ․‥…ſ℀℁℃℅℆℉№℡")

_LATIN = "aăâbcdđeêghiklmnoôơpqrstuưvxyfjwzáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяіѕјһ"
_GREEK = "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώ"
#: Index 0 stands for anything else, word ends included.
ALPHABET = " " + _LATIN + _CYRILLIC + _GREEK + "ðɖ"
_INDEX = {c: i for i, c in enumerate(ALPHABET)}
_LUT = np.zeros(0x2000, np.int32)
for _c, _i in _INDEX.items():
    _LUT[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x1FFF:
        _LUT[ord(_c.upper())] = _i

#: A text of none but these characters is in canonical form already.
_ODD = re.compile("[^\\x00-\\x7f" + _LATIN + _LATIN.upper() + "–—“”‘’…°²³«»·•©®§×]")


def _maps() -> dict[int, str]:
    """Single characters to their look-keeping compatibility form: width, font, no-break and ligature or number letters."""
    out: dict[int, str] = {}
    for cp in (*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(cp)
        if c in KEPT:
            continue
        cat, deco = unicodedata.category(c), unicodedata.decomposition(c)
        if cat == "Zs":
            out[cp] = " "
        elif cat in ("Zl", "Zp"):
            out[cp] = "\n"
        elif deco.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or (deco.startswith("<compat>") and cat[0] in "LN" and cat != "No"):
            out[cp] = unicodedata.normalize("NFKC", c)
    out[0x85] = "\n"
    return out


_COMPAT = _maps()
#: Composed letters whose base has a look-alike, taken apart for the lattice and composed again after it.
_APART = {
    cp: d
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000))
    if len(d := unicodedata.normalize("NFD", chr(cp))) > 1 and d[0] in LOOKALIKES
}
_LINE_LETTERS = re.compile("[" + re.escape("".join(LOOKALIKES) + "".join(map(chr, _APART))) + "]")


def script(c: str) -> str:
    """L, C or G for Latin, Cyrillic and Greek letters; ? for letters of other scripts."""
    cp = ord(c)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "L"
    if 0x400 <= cp < 0x530:
        return "C"
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "G"
    return "?"


#: Costs of the lattice, in nats: a change of script inside a word, between words, and a replacement.
IN_WORD, BETWEEN, REPLACE = 12.0, 3.0, 1.0


def _viterbi(line: str, logp: np.ndarray) -> str:
    """The cheapest reading of a line. Every letter may stay or become the letter that it looks like."""
    states: list[tuple[float, str, str]] = []  # cost, script and reading of the last letter
    back: list[list[int]] = []
    at: list[int] = []
    choices: list[list[str]] = []
    last = -2
    sure = [script(c) for c in line if c.isalpha() and c not in LOOKALIKES]
    home = max(set(sure), key=lambda s: (sure.count(s), s)) if sure else "L"
    for i, c in enumerate(line):
        if not (c.isalpha() or unicodedata.combining(c)):
            continue
        if unicodedata.combining(c):
            last = i
            continue
        options = [c] + ([LOOKALIKES[c]] if c in LOOKALIKES else [])
        inside = last == i - 1 and bool(at)
        new: list[tuple[float, str, str]] = []
        ptr: list[int] = []
        for k, o in enumerate(options):
            s, own = script(o), REPLACE * k
            if c in SAME_SCRIPT:
                own = 0.0 if k else 6.0
            j = _INDEX.get(o.lower(), 0)
            if not states:
                new.append((own - logp[0, j] + (BETWEEN if s != home else 0.0), s, o))
                ptr.append(-1)
                continue
            best, arg = np.inf, 0
            for q, (cost, ps, po) in enumerate(states):
                if inside:
                    step = (IN_WORD if ps != s else 0.0) - logp[_INDEX.get(po.lower(), 0), j]
                else:
                    step = (BETWEEN if ps != s else 0.0) - logp[0, j]
                if cost + step < best:
                    best, arg = cost + step, q
            new.append((best + own, s, o))
            ptr.append(arg)
        states, last = new, i
        at.append(i)
        choices.append(options)
        back.append(ptr)
    if not at:
        return line
    # The line begins and ends in the script of most of its unambiguous letters.
    k = min(range(len(states)), key=lambda q: states[q][0] + (BETWEEN if states[q][1] != home else 0.0))
    out = list(line)
    for pos in range(len(at) - 1, -1, -1):
        out[at[pos]] = choices[pos][k]
        k = back[pos][k]
    return "".join(out)


def canonical(text: str | None, logp: np.ndarray) -> str | None:
    """One text in canonical form. Null stays null, an empty text stays empty; the form is stable under repetition."""
    if text is None or not _ODD.search(text):
        return text
    out = unicodedata.normalize("NFC", IGNORABLE.sub("", text).translate(_COMPAT))
    if _LINE_LETTERS.search(out):
        out = "\n".join(_viterbi(x.translate(_APART), logp) if _LINE_LETTERS.search(x) else x for x in out.split("\n"))
        out = unicodedata.normalize("NFC", out)
    return out


def log_scores(counts: np.ndarray) -> np.ndarray:
    """Bigram counts to smoothed log probabilities, each of the next letter among those of its own script, so that a
    reading is not preferred for the mere frequency of its script; changes of script have their own costs."""
    k = len(ALPHABET)
    c = counts.reshape(k, k).astype(np.float64) + 0.1
    scripts = np.array([script(x) if x != " " else " " for x in ALPHABET])
    out = np.zeros((k, k), np.float32)
    for s in set(scripts):
        own = scripts == s
        out[:, own] = np.log(c[:, own] / c[:, own].sum(1, keepdims=True))
    return out


def _bigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(ALPHABET)
    total = np.zeros(k * k, np.int64)
    for b in batches:
        for col in b.columns:
            text = "\n".join(x for x in col.to_pylist() if x)
            cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            ids = _LUT[np.minimum(cps, 0x1FFF)]
            if len(ids) > 1:
                total += np.bincount(ids[:-1] * k + ids[1:], minlength=k * k)
    pair = np.nonzero(total)[0]
    yield pa.record_batch({"pair": pa.array(pair, pa.int32()), "n": pa.array(total[pair], pa.int64())})


def train(*texts: DataFrame) -> np.ndarray:
    """Character-bigram log scores over every text of the one-column frames. The collected table has at most
    ``len(ALPHABET) ** 2`` rows (about 38,000), independent of the data."""
    k = len(ALPHABET)
    counts = np.zeros(k * k, np.int64)
    for df in texts:
        rows = spread(df).mapInArrow(_bigrams, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        for r in rows:
            counts[r["pair"]] += r["n"]
    return log_scores(counts)


def canonical_udf(logp: np.ndarray):
    """A pandas UDF string -> string."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: canonical(x, logp), na_action="ignore")

    return f


def canonicalize(df: DataFrame, text: str, out: str = "canonical", logp: np.ndarray | None = None) -> DataFrame:
    """Add column ``out``: ``text`` in canonical form. Null text gives null; other columns stay as they are; a column of
    the name ``out`` is replaced. Without ``logp`` the scores are trained on the frame itself."""
    scores = train(df.select(text)) if logp is None else logp
    return df.withColumn(out, canonical_udf(scores)(F.col(text)))


def _changed(batches: Iterable[pa.RecordBatch], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, text = b.column(0), b.column(1).to_pylist()
        hit = [x is not None and canonical(x, logp) != x for x in text]
        yield pa.record_batch([key.filter(pa.array(hit))], names=["record_key"])


def nonstandard(df: DataFrame, key: str, text: str, logp: np.ndarray) -> DataFrame:
    """Keys of the rows whose text is not in canonical form, once each. Null keys and null texts give no row."""
    return (
        spread(df.select(F.col(key).cast("string"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()))
        .mapInArrow(lambda it: _changed(it, logp), "record_key string")
        .distinct()
    )


__all__ = ["ALPHABET", "canonical", "canonical_udf", "canonicalize", "log_scores", "nonstandard", "train", "Column"]
