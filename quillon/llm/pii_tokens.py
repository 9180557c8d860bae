"""Tokens of a text for the tagger: every character but white space lies in one, and each token has a row of features.

A token is a run of letters, a number, a command, an escaped character or a run of one other character. The white
space in front belongs to it as a feature. Features are rows of one table of embeddings: white space, shape, the word if
training saw it often, and its beginning and end.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

_SPACE = " \\t\\r\\n\\f\\v~\\u00a0\\u2000-\\u200a\\u202f\\u3000"
_LETTERS = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u02af\\u0386-\\u03ff\\u0400-\\u0481\\u048a-\\u052f"
TOKEN = re.compile(rf"[{_SPACE}]*(?:[{_LETTERS}]+|[0-9]+(?:\.[0-9]+)*|\\(?:[A-Za-z]+\{{?|[^A-Za-z])|[_^]\{{|\}}+|\{{+|-+|\.+|\$+|_+|=+|%+|\*+|&+|[^\W\d_{_LETTERS}]+|\d+|[^{_SPACE}])")
_GAP = re.compile(rf"[{_SPACE}]*")
_DIGIT = re.compile(r"\d")
#: Texts are cut into tokens in pieces of so many characters, so that few of their strings live at once.
PIECE = 1 << 20
#: Distinct tokens whose features are kept.
KEPT = 150_000

_GAPS, _SHAPES, _EDGE = 6, 320, 1024
_WORDS_AT = _GAPS + _SHAPES + 4 * _EDGE
FEATURES = 7


def rows(vocabulary: int) -> int:
    """Rows of the table of embeddings; the first stands for no feature."""
    return 1 + _WORDS_AT + vocabulary


def _parts(token: str) -> tuple[str, str, str]:
    """White space in front, the rest, and that in small letters, shortened where it is very long."""
    at = _GAP.match(token).end()
    word = token[at:]
    return token[:at], word, (word if len(word) <= 64 else word[:32] + word[-32:]).lower()


def _checksum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _key(low: str) -> int:
    return _checksum(_DIGIT.sub("9", low) if low[0].isdigit() else low)


def word_key(token: str) -> int:
    """What a vocabulary holds of a token: a checksum of the word in small letters, or of a number's form."""
    return _key(_parts(token)[2])


def _gap(gap: str) -> int:
    if not gap:
        return 0
    lines = gap.count("\n")
    return 4 if lines > 1 else 3 if lines else 2 if gap.strip(" \t") else 1


def _shape(word: str) -> int:
    """Below _SHAPES. Letters: capitals and length; digits: length; else the character."""
    first = word[0]
    if first.isalpha():
        n = len(word)
        size = 0 if n == 1 else 1 if n < 4 else 2 if n < 8 else 3
        case = 0 if word.islower() else 1 if word[1:].islower() or n == 1 else 2 if word.isupper() else 3
        return 4 * case + size
    if first.isdigit():
        return 16 + min(len(word), 15)
    if first == "\\" and len(word) > 1:
        return 32 if word[1].isalpha() else 192 + min(ord(word[1]), 127)
    return 33 + min(ord(first), 127)


def _features(token: str, vocabulary: dict[int, int]) -> tuple[int, ...]:
    gap, word, low = _parts(token)
    at = 1 + _GAPS + _SHAPES
    out = [1 + _gap(gap), 1 + _GAPS + _shape(word)]
    if word[0].isalnum() or (word[0] == "\\" and word[1:2].isalpha()):
        out += [at + k * _EDGE + _checksum(part) % _EDGE for k, part in enumerate((low[:2], low[:3], low[-2:], low[-3:]))]
        known = vocabulary.get(_key(low))
        out.append(0 if known is None else 1 + _WORDS_AT + known)
    return (*out, *[0] * (FEATURES - len(out)))


class Types(dict):
    """Numbers of distinct tokens from 1, made as tokens are met, and their features."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        super().__init__()
        self.vocabulary = {int(k): i for i, k in enumerate(vocabulary)}
        self.known: list[tuple[int, ...]] = [(0,) * FEATURES]
        #: Characters, and those of white space in front.
        self.sizes = [(0, 0)]

    def __missing__(self, token: str) -> int:
        self[token] = k = len(self.known)
        self.known.append(_features(token, self.vocabulary))
        self.sizes.append((len(token), _GAP.match(token).end()))
        return k

    def sizes_of(self, types: np.ndarray) -> np.ndarray:
        return np.array([self.sizes[k] for k in types.tolist()], np.int64).reshape(-1, 2)



    def features(self, types: np.ndarray) -> np.ndarray:
        return np.array([self.known[k] for k in types.tolist()], np.int32).reshape(-1, FEATURES)

    def trim(self) -> None:
        """Forgets all tokens when they are too many; numbers given before are void then."""
        if len(self) > KEPT:
            self.clear()
            del self.known[1:], self.sizes[1:]


def tokens(text: str, types: Types) -> np.ndarray:
    """Type of each token of a text. Together they are the whole text but white space at its end."""
    ids = []
    at, size = 0, PIECE
    while at < len(text):
        stop = min(len(text), at + size)
        found = TOKEN.findall(text, at, stop)
        if stop < len(text):
            # The last token may go on behind the piece, and white space there belong to the next one.
            if len(found) < 2:
                size *= 2
                continue
            found.pop()
        ids.append(np.fromiter(map(types.__getitem__, found), np.int32, len(found)))
        if stop == len(text):
            break
        at, size = at + sum(map(len, found)), PIECE
    return np.concatenate(ids) if ids else np.zeros(0, np.int32)
