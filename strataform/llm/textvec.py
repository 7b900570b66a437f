"""Words and word n-grams of many texts at once, as 64-bit hashes from prefix sums modulo 2**64.

A word is a maximal run of a-z, 0-9 and bytes from 0x80 on, after A-Z are lower-cased. Equal words get equal hashes;
callers that need certainty compare the bytes of what the hashes found."""

from __future__ import annotations

import numpy as np

_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of text that are hashed at once.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _powers[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def spans(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """For each i the polynomial in base with coefficients values[first[i]..last[i]], modulo 2**64."""
    if not len(first):
        return np.zeros(0, np.uint64)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[last + 1] - total[first]) * powers(_inverse(base), len(values))[first]


class Words:
    """start, end: byte ranges in low, the lower-cased bytes; doc: index of the text; hash; first: for each text its first word (and a last entry)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        starts, ends, hashes, at, n = [], [], [], 0, len(data)
        while at < n:
            to = min(n, at + PIECE)
            if to < n:  # a piece ends between words
                inside = IS_WORD[self.low[at:to]]
                back = np.flatnonzero(~inside)
                while not len(back) and to < n:
                    more = np.flatnonzero(~IS_WORD[self.low[to : to + PIECE]])
                    back, to = (np.array([to - at + more[0]]), to) if len(more) else (back, min(n, to + PIECE))
                to = at + int(back[-1]) + 1 if len(back) else n
            s, e, h = self._piece(at, to, offsets)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = to
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = whole(starts, np.int64), whole(ends, np.int64), whole(hashes, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def _piece(self, at: int, to: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = self.low[at:to]
        inside = IS_WORD[low]
        edge = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at  # a text starts here
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[edge] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[edge[edge > 0] - 1] = False
        start, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
        return start, last + 1, mix(spans(low.astype(np.uint64) + np.uint64(1), start, last, _BASE))

    def grams(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every n words in a row within a text; with short, also the whole of a text of fewer words."""
        at = np.arange(max(0, len(self.doc) - n + 1))
        at = at[self.doc[at] == self.doc[at + n - 1]]
        last = at + n - 1
        if short:
            count = np.diff(self.first)
            few = np.flatnonzero((count > 0) & (count < n))
            if len(few):
                at, last = np.concatenate([at, self.first[few]]), np.concatenate([last, self.first[few + 1] - 1])
                order = np.argsort(at, kind="stable")
                at, last = at[order], last[order]
        return at, mix(spans(self.hash, at, last, _GRAM) + (last - at + 1).astype(np.uint64))

    def joined(self, first: int, n: int) -> bytes:
        """n words from the first on, one space between them."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[first : first + n], self.end[first : first + n]))
