"""Words in canonical form, lower-cased, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from lexweave.functions.words import END, TOP, hash_words, mix, points
from lexweave.llm.canonical import _LATIN, canonical

#: Characters that make a text odd, that is, worth a look by canonical().
_ODD = np.ones(TOP, bool)
_ODD[[ord(c) for c in _LATIN + _LATIN.upper() + "–—“”‘’…°²³«»·•©®§×" + "".join(map(chr, range(128)))]] = False


def word_hashes(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text). Null texts have none."""
    own = ["" if t is None else t.replace(END, " ") if END in t else t for t in texts]
    cps = points(END.join(own) + END)
    odd = _ODD[np.minimum(cps, TOP - 1)]
    if odd.any():
        ends = np.nonzero(cps == 0)[0]
        for k in np.unique(np.searchsorted(ends, np.nonzero(odd)[0])).tolist():
            own[k] = canonical(own[k], logp)
    return hash_words(own, str.lower)


__all__ = ["mix", "word_hashes"]
