"""Folding and shingling whole batches of texts with numpy.

A batch is one array of code points; letters and digits are kept, folded in case and width, all else is dropped.  Shingles are runs of
K code points (5 where the text is mostly Han, which parts no words; 8, some two words, elsewhere), hashed by doubling.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from loomgraph.plans.shared import worker_cache

K_HAN, K_OTHER = 5, 8
_B = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
BITS = 22


def _fold_char(c: int) -> int:
    x = chr(c)
    if 0xFF00 < c < 0xFFF0:
        x = unicodedata.normalize("NFKC", x)[:1]
    x = x.lower()[:1]
    return ord(x) if x.isalnum() else 0


def fold(codes: np.ndarray) -> np.ndarray:
    """The folded code point of each, 0 for what is dropped."""
    c = worker_cache()
    if "fold" not in c:
        c["fold"], c["known"] = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    table, known = c["fold"], c["known"]
    if len(new := np.unique(codes[~known[codes]])):
        table[new] = [_fold_char(int(x)) for x in new]
        known[new] = True
    return table[codes]


class Batch:
    """Folded texts: ``chars`` of all, ``doc`` the number of each char's text, ``at`` its place in the raw text, ``start`` each text's first char."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        f = fold(raw)
        keep = np.flatnonzero(f)
        self.chars = f[keep]
        first = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.repeat(np.arange(len(texts)), lengths)[keep]
        self.at = keep - first[self.doc] if len(keep) else keep
        self.start = np.searchsorted(keep, first)

    def hashes(self) -> dict[int, np.ndarray]:
        """Shingle hashes by K, one for each char; 0 where the text ends too soon."""
        n = len(self.chars)
        b = np.uint64(_B)
        power = lambda e: np.uint64(pow(_B, e, 1 << 64))

        def join(left: np.ndarray, right: np.ndarray, a: int, c: int) -> np.ndarray:
            out = left * power(c)
            if a < n:
                out[: n - a] += right[a:]
            return out

        with np.errstate(over="ignore"):
            h1 = (self.chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            h1 ^= h1 >> np.uint64(32)
            h2 = join(h1, h1, 1, 1)
            h4 = join(h2, h2, 2, 2)
            h5 = join(h4, h1, 4, 1)
            h8 = join(h4, h4, 4, 4)
            out = {K_HAN: h5 * b, K_OTHER: h8 * b}
        end = self.start[1:][self.doc] if n else np.zeros(0, np.int64)
        for k, h in out.items():
            h ^= h >> np.uint64(29)
            h[np.arange(n) + k > end] = 0
        return out


def k_of(chars: np.ndarray) -> int:
    """Shingle length for a text: Han and kana are above U+2E80."""
    return K_HAN if len(chars) and np.mean(chars > 0x2E80) > 0.3 else K_OTHER


class Lookup:
    """Set of 64-bit hashes with a bit map before it."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self._slot(self.values)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in ``values``) of the hashes that are in the set."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[self._slot(h)] & (h != 0))
        j = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[j] == h[at]
        return at[ok], j[ok]
