"""Words of many texts at once, as numpy arrays.

A word is a run of letters and digits, case ignored. Command names (a backslash and the letters after it)
are no words; every other character only separates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

_ODD = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}]")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("a") : ord("z") + 1] = True
_IS_WORD = _IS_LETTER.copy()
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: 64-bit hashes, the text each is in, and its bytes in ``data``."""

    def __init__(self, texts: list[str]) -> None:
        folded = [t.lower() if t.isascii() else _ODD.sub(" ", t.lower()) for t in texts]
        parts = [t.encode("utf-8", "replace") for t in folded]
        self.data = b"\n".join(parts)
        b = np.frombuffer(self.data, np.uint8)
        ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) if parts else np.zeros(0, np.int64)
        w = _IS_WORD[b]
        slashes = np.flatnonzero(b == 92)
        if len(slashes):
            first = np.r_[True, np.diff(slashes) != 1]
            nth = np.arange(len(slashes)) - np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))
            at = slashes[nth % 2 == 0] + 1
            letter = _IS_LETTER[b]
            at = at[at < len(b)]
            at = at[letter[at]]
            stops = np.flatnonzero(~letter)
            k = np.searchsorted(stops, at)
            upto = np.where(k < len(stops), stops[np.minimum(k, max(len(stops) - 1, 0))], len(b)) if len(stops) else np.full(len(at), len(b))
            edge = np.zeros(len(b) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, upto, -1)
            w &= np.cumsum(edge[:-1]) == 0
        edge = np.flatnonzero(np.diff(np.r_[False, w, False].view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        powers = np.full(len(b), _BASE)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(len(b), _BASE_INVERSE)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(np.where(w, b, 0).astype(np.uint64) * powers, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start] if len(self.start) else np.zeros(0, np.uint64))
        self.text = np.searchsorted(ends, self.start, side="right")

    def spell(self, i: int, n: int) -> str:
        return " ".join(self.data[self.start[k] : self.end[k]].decode() for k in range(i, i + n))


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of chunks of about ``limit`` characters; a longer text is a chunk of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]
