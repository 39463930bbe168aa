"""64-bit hashes of the words of a text, vectorised: A-Z lower-cased, split at ASCII white space."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the odd _P and of its inverse, modulo 2**64: two tables of BLOCK entries."""
    if not _powers:
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(BLOCK, x, np.uint64)))) for x in (_P, pow(_P, -1, 1 << 64))]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of every word, the same wherever it stands. Words longer than BLOCK are digested."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    out, i = np.empty(len(start), np.uint64), 0
    up, down = _power_tables()
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + BLOCK, "right"))
        if j == i:
            out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        piece, a, b = raw[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        with np.errstate(over="ignore"):
            out[i:j] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out
