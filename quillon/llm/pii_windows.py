"""Windows over the whole of every text for the tagger, and the reconciliation of overlapping ones.

Every token of every text lies in a window. Windows overlap, and each token takes the tag of the window in
which it lies farther from an edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

from quillon.llm.pii_tokens import Types, tokens
from quillon.llm.tagger import KINDS, PAD

#: Tokens of a window, and those it shares with the next one.
LENGTH, OVERLAP = 512, 32

BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}(.*?)(?:\\end\{thebibliography\}|\Z)", re.S)


#: Pages, with the year behind: in bibliographies no phone and no number of a person.
PAGES = re.compile(r"\(?\d{1,5}--\d{1,5}(?:[ ~\n]?\(?\d{4}\)?)?")


def in_entry(text: str, at: int, lists: list[tuple[int, int]]) -> bool:
    """Whether a place lies in a bibliography, comments there apart."""
    return any(x <= at < y for x, y in lists) and not text[text.rfind("\n", 0, at) + 1 : at].lstrip().startswith("%")


#: What a group of mailboxes may hold: words and at least one separator.
_LISTED, _SEPARATOR = re.compile(r"[\w.,;|/+\-'’~%\s\\{}]+"), re.compile(r"[,;|/\s]")


def group(text: str, a: int) -> int:
    """Where the braced list of mailboxes starts that ends before an at sign at a, however long it is; a itself where there is none."""
    end = a
    while end and (text[end - 1].isspace() or text[end - 1] in "%~\\"):
        end -= 1
    if text.endswith("\\string", 0, a):
        end = a - 7
    if not end or text[end - 1] != "}":
        return a
    if text.endswith("\\}", 0, end):
        start = text.rfind("\\{", 0, end)
        inner = text[start + 2 : end - 2]
    else:
        start, depth = end - 1, 1
        while depth and start > 0:
            cut = max(text.rfind("{", 0, start), text.rfind("}", 0, start))
            if cut < 0:
                return a
            start, depth = cut, depth + (1 if text[cut] == "}" else -1)
        if depth:
            return a
        inner = text[start + 1 : end - 1]
    return start if start >= 0 and _LISTED.fullmatch(inner) and _SEPARATOR.search(inner) else a


def cuts(a: int, b: int) -> Iterable[tuple[int, int]]:
    """Windows of at most LENGTH over (a, b), of like length, overlapping by OVERLAP at least."""
    if b - a <= LENGTH:
        return [(a, b)]
    n = -(-(b - a - OVERLAP) // (LENGTH - OVERLAP))
    size = -(-(b - a + (n - 1) * OVERLAP) // n)
    step = (b - a - size) / (n - 1)
    return [(s := a + int(i * step), b if i == n - 1 else s + size) for i in range(n)]


class Windows(NamedTuple):
    """Tokens of some texts one behind the other, and windows over all of them."""

    #: Places of the tokens in their texts, and the first token of each text (and the end).
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    #: The distinct types, the most frequent first, and which of them each token is, from 1.
    types: np.ndarray
    numbers: np.ndarray
    #: (N, LENGTH) numbers of the tokens of each window, padded at the end.
    symbols: np.ndarray
    #: (text, first token, end) of each window.
    places: list[tuple[int, int, int]]


def cut(texts: list[str], types: Types) -> Windows:
    read = [tokens(text, types) for text in texts]
    ids = np.concatenate([np.zeros(0, np.int32), *read])
    first = np.cumsum([0, *map(len, read)])
    counts = np.bincount(ids, minlength=1)
    used = np.flatnonzero(counts)
    used = used[np.argsort(-counts[used], kind="stable")]
    number = np.zeros(len(counts), np.int32)
    number[used] = np.arange(1, len(used) + 1)
    numbers = number[ids]
    length, gap = np.concatenate([np.zeros((1, 2), np.int64), types.sizes_of(used)])[numbers].T
    ends = np.cumsum(length)
    ends -= np.repeat(np.r_[0, ends][first[:-1]], np.diff(first))
    starts = ends - length + gap
    places = [(k, s, e) for k in range(len(texts)) if first[k] < first[k + 1] for s, e in cuts(int(first[k]), int(first[k + 1]))]
    symbols = np.full((len(places), LENGTH), PAD, np.int32)
    for row, (_, s, e) in zip(symbols, places, strict=True):
        row[: e - s] = numbers[s:e]
    return Windows(starts, ends, first, used, numbers, symbols, places)


def windows(texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(N, LENGTH) symbols, padded at the end, and (text, start, end) of each in characters."""
    w = cut(texts, Types(np.zeros(0, np.uint32)))
    return w.symbols, [(k, int(w.starts[s]), int(w.ends[e - 1])) for k, s, e in w.places]


def reconcile(path: np.ndarray, w: Windows) -> list[tuple[int, int, int, str]]:
    """(text, start, end, kind) from the tags (N, LENGTH) of windows in order of place."""
    tags = np.zeros(len(w.starts), np.int8)
    at = 0
    for i, (k, s, e) in enumerate(w.places):
        last = i + 1 == len(w.places) or w.places[i + 1][0] != k
        # Of what two windows share each gives the half that is nearer to its middle.
        upto = e if last else (w.places[i + 1][1] + e) // 2
        tags[at:upto] = path[i, at - s : upto - s]
        at = upto
    kinds = (tags + 1) // 2
    before = np.r_[0, kinds[:-1]]
    begins = kinds != before
    begins |= (tags > 0) & (tags % 2 == 1)
    begins[w.first[w.first < len(tags)]] = True
    edges = np.flatnonzero(begins)
    text = np.searchsorted(w.first, edges, side="right") - 1
    return [
        (int(k), int(w.starts[a]), int(w.ends[b - 1]), KINDS[kinds[a] - 1])
        for k, a, b in zip(text.tolist(), edges.tolist(), [*edges[1:].tolist(), len(tags)], strict=True)
        if kinds[a]
    ]
