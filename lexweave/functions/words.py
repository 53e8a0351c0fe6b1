"""Words of many texts at once as 64-bit hashes, in array operations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_U = np.uint64
END = "\x00"
TOP = 0x32000
_WORD = np.array([chr(i).isalnum() for i in range(TOP)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHAR = np.random.default_rng(7).integers(1, 2**63, 0x4000, dtype=_U)
_POW: dict = {"n": 0}


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ _U((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
            done += step
    return out


def points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> str:
    """Lower case, sharp s as ss."""
    return text.lower().replace("ß", "ss")


def hash_words(texts: list[str | None], fold: Callable[[str], str] = folded) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text); words are folded runs of letters and digits, null
    texts have none.

    A word's hash is a polynomial over random values of its characters, taken from prefix sums, then scrambled: the cost
    is a few array operations per character, without a Python object per word.
    """
    joined = END.join("" if t is None else t.replace(END, " ") if END in t else t for t in texts) + END
    cps = points(fold(joined))
    n = len(cps)
    if _POW["n"] < n + 1:
        size = 1 << max(16, n.bit_length())
        _POW.update(n=size, up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    inside = _WORD[np.minimum(cps, TOP - 1)]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    with np.errstate(over="ignore"):
        value = np.where(cps < 0x4000, _CHAR[np.minimum(cps, 0x3FFF)], cps.astype(_U) * _U(0xD6E8FEB86659FD93))
        sums = np.zeros(n + 1, _U)
        np.cumsum(value * _POW["up"][:n], out=sums[1:])
        h = mix((sums[stop] - sums[start]) * _POW["down"][start], 1)
    upto = np.searchsorted(start, np.nonzero(cps == 0)[0])
    return h, np.diff(upto, prepend=0)
