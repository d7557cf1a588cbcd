"""Whether two texts reach a ratio of difflib's SequenceMatcher (no junk), decided without its quadratic dictionaries.

Matching blocks form a common subsequence, so grams and the longest common subsequence bound them from above. What is left is
matched block by block as difflib does, until enough is matched or too little can be.
"""

from __future__ import annotations

import heapq
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

#: Segments of at most so many cells (product of the lengths) go to difflib itself.
SMALL = 100_000
#: Length of the grams that are counted.
GRAM = 3


def needed(ratio: float, length: int) -> int:
    """The least number of matched characters that reaches the ratio in difflib's own arithmetic."""
    n = max(0, int(ratio * length / 2) - 1)
    while 2.0 * n / length < ratio:
        n += 1
    return n


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of an integer for each character of ``a``."""
    places: dict[str, int] = {}
    for c in set(a):
        marks = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(c)
        places[c] = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
    whole = (1 << len(a)) - 1
    v = whole
    for c in b:
        if (m := places.get(c)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


class Text:
    """A text with the counts of its characters and grams, made once for all comparisons."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self._codes = self._chars = self._grams = None

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            self._codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return self._codes

    @property
    def chars(self) -> Counter:
        if self._chars is None:
            self._chars = Counter(self.text)
        return self._chars

    @property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        if self._grams is None:
            c, key = self.codes, np.zeros(max(0, self.n - GRAM + 1), np.int64)
            for k in range(GRAM):
                key = (key << 21) + c[k : k + len(key)]
            self._grams = np.unique(key, return_counts=True)
        return self._grams


def _shared_grams(a: Text, b: Text) -> int:
    (ka, na), (kb, nb) = a.grams, b.grams
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum())


class _Blocks:
    """Longest common blocks of parts of two texts; windows of 2 ** k characters have equal ranks if they are equal."""

    def __init__(self, a: Text, b: Text):
        self.a, self.b = a.text, b.text
        self.ranks = [(a.codes, b.codes)]

    def _rank(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.ranks) <= k:
            half = 1 << (len(self.ranks) - 1)
            top = max(int(r.max()) for r in self.ranks[-1]) + 1
            keys = [r[: len(r) - half] * top + r[half:] for r in self.ranks[-1]]
            inverse = np.unique(np.concatenate(keys), return_inverse=True)[1].astype(np.int64)
            self.ranks.append((inverse[: len(keys[0])], inverse[len(keys[0]) :]))
        return self.ranks[k]

    def _windows(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[np.ndarray, np.ndarray]:
        k = size.bit_length() - 1
        ra, rb = self._rank(k)
        top, more = max(int(ra.max()), int(rb.max())) + 1, size - (1 << k)
        of = lambda r, lo, hi: r[lo : hi - size + 1] * top + r[lo + more : hi - size + 1 + more]
        return of(ra, alo, ahi), of(rb, blo, bhi)

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(start in a, start in b, size) of the longest block, the first in a and then in b, as difflib's."""
        if (ahi - alo) * (bhi - blo) <= SMALL:
            m = SequenceMatcher(None, self.a[alo:ahi], self.b[blo:bhi], autojunk=False).find_longest_match()
            return m.a + alo, m.b + blo, m.size
        low, high, best = 0, min(ahi - alo, bhi - blo), None
        while low < high:  # a block of some size holds blocks of all smaller ones
            size = (low + high + 1) // 2
            wa, wb = self._windows(size, alo, ahi, blo, bhi)
            if (there := np.isin(wa, wb)).any():
                low, i = size, int(np.argmax(there))
                best = (i + alo, int(np.argmax(wb == wa[i])) + blo, size)
            else:
                high = size - 1
        return best or (alo, blo, 0)


def reaches(a: Text, b: Text, ratio: float) -> bool:
    """Whether SequenceMatcher(None, a, b, autojunk=False).ratio() is at least ``ratio`` (above 0)."""
    if not a.n + b.n:
        return ratio <= 1.0
    need = needed(ratio, a.n + b.n)
    if min(a.n, b.n) < need:
        return False
    if a.text == b.text:
        return True
    if sum(min(n, b.chars[c]) for c, n in a.chars.items()) < need:
        return False
    # a character of a without partner breaks GRAM grams of a at most, one of b those that span its place
    out_a, out_b = a.n - need, b.n - need
    if _shared_grams(a, b) < a.n - GRAM + 1 - GRAM * out_a - (GRAM - 1) * out_b:
        return False
    if common_subsequence(a.text, b.text) < need:
        return False
    blocks, matched, possible, parts = _Blocks(a, b), 0, min(a.n, b.n), [(-min(a.n, b.n), 0, a.n, 0, b.n)]
    while parts and matched < need <= possible:
        most, alo, ahi, blo, bhi = heapq.heappop(parts)
        i, j, size = blocks.longest(alo, ahi, blo, bhi)
        matched, possible = matched + size, possible + most + size
        if size:
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if able := min(part[1] - part[0], part[3] - part[2]):
                    heapq.heappush(parts, (-able, *part))
                    possible += able
    return matched >= need
