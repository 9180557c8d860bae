"""Personal information inside free text: found by the tagger, replaced by typed placeholders.

One narrow stage: windows over the whole of each text are decoded in large batches, overlapping windows are
reconciled over the text, and a plain check of each kind follows. Nothing is shuffled.
"""

from __future__ import annotations

import ctypes
import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import tagger
from quillon.llm.pii_train import WEIGHTS
from quillon.llm.pii_tokens import Types
from quillon.llm.pii_windows import BIBLIOGRAPHY, PAGES, Windows, cut, group, in_entry, reconcile
from quillon.llm.words import chunks
from quillon.session import spread

#: Windows decoded at once: what a step works on stays inside a core's cache.
BATCH = 512
SPANS = "doc_id long, line_no int, start_at int, end_at int, pii_type string, found string"
_SKIP = re.compile(r"(?:\s|%|~|\\[,; ]|[({\[,;:]|\}(?=.*[A-Z@]))+")


def _one_thread() -> None:
    """Each task has a core of its own; a matrix library that starts threads for small products only gets in the way."""
    tagger.keep_memory()
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line and ".so" in line}
        for path in paths:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
    except OSError:
        pass


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, np.ndarray], Types]:
    """The network, and the types of tokens met so far."""
    _one_thread()
    # By way of the package, which may lie in an archive.
    with np.load(io.BytesIO(pkgutil.get_data("quillon.llm", WEIGHTS.name))) as f:
        return {k: f[k].astype(np.float32) for k in f.files if k != "words"}, Types(f["words"])


def tag_windows(w: Windows) -> np.ndarray:
    """Tags (N, LENGTH) of windows; batches hold windows of like length."""
    p, types = weights()
    p, _ = tagger.tables(p, types.features(w.types))
    out = np.zeros(w.symbols.shape, np.int8)
    lengths = np.array([b - a for _, a, b in w.places])
    order = np.argsort(lengths, kind="stable")
    for i in range(0, len(order), BATCH):
        rows = order[i : i + BATCH]
        most = int(lengths[rows[-1]])
        out[rows, :most] = tagger.decode(p, np.ascontiguousarray(w.symbols[rows, :most].T)).T
    return out


def _sound(kind: str, found: str) -> bool:
    digits = sum(c.isdigit() for c in found)
    if kind == "email":
        return bool(re.search(r"@|[\[({]\s*at\s*[\])}]|\bat\b", found)) and len(found) > 5
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return digits >= 1 and bool(re.search(r"[A-ZÀ-Þ][a-zß-ÿ]{2}", found))
    return sum(c.isupper() and not before.isalpha() for before, c in zip(" " + found, found)) >= 2


def _whole_group(text: str, a: int, b: int) -> int:
    """The start of a mailbox, moved to the head of its group: a window sees but a part of a long list."""
    at = re.search(r"@|[\[({]\s*at\s*[\])}]|\bat\b", text[a:b])
    head = group(text, a + at.start()) if at else a
    return a if not at or head == a + at.start() else head


def spans(texts: list[str]) -> list[tuple[int, int, int, str]]:
    """(text, start, end, kind) of all texts, in order."""
    _, types = weights()
    types.trim()
    read = cut(texts, types)
    if not read.places:
        return []
    out, listed = [], {}
    for k, a, b, kind in reconcile(tag_windows(read), read):
        text = texts[k]
        lead = _SKIP.match(text, a, b) if kind not in ("phone", "email") else re.compile(r"(?:\s|%|~)+").match(text, a, b)
        a = lead.end() if lead else a
        while b > a and (text[b - 1].isspace() or text[b - 1] in "%~,;"):
            b -= 1
        if kind == "name" or (kind in ("phone", "id_number") and PAGES.fullmatch(text, a, b)):
            # Neither names nor pages are cases in entries of bibliographies.
            if k not in listed:
                listed = {k: [m.span(1) for m in BIBLIOGRAPHY.finditer(text)]}
            if in_entry(text, a, listed[k]):
                continue
        if b > a and _sound(kind, text[a:b]):
            if kind == "email":
                a = _whole_group(text, a, b)
                while out and out[-1][0] == k and out[-1][2] > a:
                    _, x, y, other = out.pop()
                    while y > x and (y > a or text[y - 1].isspace()):
                        y -= 1
                    if y > x and _sound(other, text[x:y]):
                        out.append((k, x, y, other))
                        break
            out.append((k, a, b, kind))
    return out


def find(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, start_at, end_at, pii_type, found): every item with its place, line_no from 1.

    Null and empty texts have none; rows with a null id come out with a null id; a text's length is no
    limit. Extra columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["d"].tolist()
            for at, texts in chunks(frame["t"].tolist(), 1 << 22):
                rows = [(ids[at + k], texts[k].count("\n", 0, a) + 1, a, b, kind, texts[k][a:b]) for k, a, b, kind in spans(texts)]
                if rows:
                    out = pd.DataFrame(rows, columns=["doc_id", "line_no", "start_at", "end_at", "pii_type", "found"])
                    yield out.astype({"doc_id": "Int64"})

    chosen = docs.select(F.col(doc_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("t is not null and t != ''")
    return spread(chosen).mapInPandas(run, SPANS)


def _placeholder(kind: str, found: str) -> str:
    """The placeholder, and the line breaks the item spanned, so that comment signs and line counts stay."""
    return f"[{kind.upper()}]" + "".join(re.findall(r"\r?\n[ \t]*%*", found))


def mask_texts(texts: list[str]) -> list[str]:
    pieces: dict[int, list[tuple[int, int, str]]] = {}
    for k, a, b, kind in spans(texts):
        pieces.setdefault(k, []).append((a, b, kind))
    out = list(texts)
    for k, items in pieces.items():
        text, done, at = texts[k], [], 0
        for a, b, kind in items:
            done += [text[at:a], _placeholder(kind, text[a:b])]
            at = b
        out[k] = "".join([*done, text[at:]])
    return out


def mask(docs: DataFrame, text_col: str = "text", out_col: str = "masked_text") -> DataFrame:
    """The input with ``out_col``: the text with each item replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    All else is left byte for byte. Null stays null. An existing column of that name is replaced.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        whole = texts.fillna("").tolist()
        done: list[str] = []
        for _, part in chunks(whole, 1 << 22):
            done += mask_texts(part)
        return pd.Series(done, index=texts.index).where(texts.notna(), None)

    return spread(docs).withColumn(out_col, run(F.col(text_col)))
