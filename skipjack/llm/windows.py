"""Word windows of whole texts in NumPy: spans, hashes and winnowed anchors."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial hashes and of the finaliser (64-bit, wrapping).
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)

#: True for the ASCII white space that separates words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of several texts at once; `bounds[k]:bounds[k+1]` are those of text k."""

    def __init__(self, texts: list[bytes]):
        whole = b" ".join(texts) + b" "
        data = np.frombuffer(whole, np.uint8)
        space = IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.data, self.whole = data, whole
        self.starts, self.ends = edge[0::2], edge[1::2]
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.firsts = limits - np.array([len(t) + 1 for t in texts], np.int64)
        self.bounds = np.concatenate(([0], np.searchsorted(self.starts, limits)))
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = self.data[~IS_SPACE[self.data]].astype(np.uint64) + np.uint64(1)
        values *= powers(BYTE_BASE, int(sizes.max()))[inside]
        return mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes))

    def gram_hashes(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on (the last k - 1 places are left out)."""
        h = self.hashes()
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        p = powers(WORD_BASE, k)
        for j in range(k):
            out += h[j : j + n] * p[j]
        return mixed(out)

    def window_places(self, size: int) -> np.ndarray:
        """First words of the windows of `size` words that lie in one text."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text_of[:n] == self.text_of[size - 1 :])

    def anchors(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, anchor of each window): the least hash of its grams. Equal windows have equal anchors."""
        places = self.window_places(size)
        h = self.gram_hashes(gram)
        width = size - gram + 1
        if not len(places):
            return places, np.zeros(0, np.uint64)
        low, step = h, 1
        while step < width:  # sliding minimum by doubling
            move = min(step, width - step)
            low = np.minimum(low[: len(low) - move], low[move:])
            step += move
        return places, low[places]
