"""Words of many texts at once, and rolling hashes over bytes and words, in numpy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20)
BYTE_CODES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, WORD_BASE, TEXT_CODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of slices of a sequence of codes."""

    def __init__(self, codes: np.ndarray, base: np.uint64):
        steps = np.full(len(codes) + 1, base, np.uint64)
        steps[0] = 1
        powers = np.cumprod(steps)
        steps[1:] = np.uint64(pow(int(base), -1, 1 << 64))
        self.back = np.cumprod(steps)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.back[begin]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xFF51AFD7ED558CCD)


class Scan:
    """Texts laid end to end as UTF-8, their words (runs of other bytes than ASCII white space) and hashes.

    ``chars`` counts, up to each byte, the code points outside white space.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.offsets = offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)])
        self.data = data = np.frombuffer(b"".join(raw), np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        self.chars = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~white)])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inner = ~white
        self.begin = np.flatnonzero(inner & (np.concatenate([[True], white[:-1]])[:len(data)] | edge[:-1]))
        self.end = np.flatnonzero(inner & (np.concatenate([white[1:], [True]])[:len(data)] | edge[1:])) + 1
        self.n_words = np.diff(np.searchsorted(self.begin, offsets))
        self.owner = np.repeat(np.arange(len(texts)), self.n_words)
        self.rolling = Rolling(BYTE_CODES[data], BASE)
        self.over_words = Rolling(self.rolling.of(self.begin, self.end), WORD_BASE)
