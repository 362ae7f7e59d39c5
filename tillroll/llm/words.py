"""Hashes of the words of many texts at once, in numpy.

A word is a run of bytes other than the six ASCII white-space characters, which is
what ``bytes.split()`` takes too. Its hash is a polynomial over random per-byte
values modulo 2^64, finalised by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# A text beyond this many bytes is hashed in pieces cut at white space.
PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def buffer_words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one buffer."""
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[buf] * _powers(_BASE, len(buf)), out=sums[1:])
    hashes = (sums[end] - sums[start]) * _powers(_INVERSE, int(start[-1]) + 1)[start]
    return mix(hashes), start, end


def pieces(text: bytes):
    """The text cut at white space into runs of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: Sequence[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of ``texts`` in order, and the number of words of each text.

    ``lower`` folds A-Z only.
    """
    if sum(map(len, texts)) <= PIECE or len(texts) == 0:
        hashes, start, _ = buffer_words(b"\n".join(texts), lower)
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        return hashes, np.diff(np.searchsorted(start, offsets))
    found = [np.concatenate([buffer_words(p, lower)[0] for p in pieces(t)]) for t in texts]
    return np.concatenate(found), np.array([len(f) for f in found], np.int64)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``k`` words.

    A text of fewer words, but not none, has one: its whole sequence.
    """
    n = len(hashes)
    combined = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        combined = (combined + hashes[j : j + len(combined)]) * _U(_BASE)
    combined = mix(combined)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(combined[at : at + c - k + 1]))
        elif c:
            whole = _U(c)
            for h in hashes[at : at + c]:
                whole = mix(np.array([(int(whole) * 31 + int(h)) & (2**64 - 1)], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out
