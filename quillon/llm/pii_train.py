"""python -m quillon.llm.pii_train DOCUMENTS.parquet [STEPS]: trains the tagger and writes its weights beside this file.

The sample is bounded: SAMPLE texts, each once as it is and once with other names and towns, and MADE passages
of made-up sentences. All of each text is trained on, windows without items less often than those with some.
Weights are stored as half floats (about 400 kB).
"""

from __future__ import annotations

import collections
import multiprocessing
import os
import random
import sys
from pathlib import Path

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import numpy as np
import pyarrow.parquet as pq

from quillon.llm import pii_made, pii_spans, pii_tokens, pii_windows, tagger

SAMPLE, MADE, HIDDEN, STEPS = 3000, 90_000, 32, 2000
#: Words of the vocabulary: those met in so many passages and texts, the most frequent first.
WORDS, LEAST = 4000, 12
#: Tokens of a window of the training, and the share of windows without items that is kept.
LENGTH, KEEP = 128, 0.5
WEIGHTS = Path(__file__).with_name("pii_tagger.npz")


Labelled = tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]


def vocabulary(labelled: list[Labelled]) -> np.ndarray:
    """Checksums of the words met most often."""
    met: collections.Counter[int] = collections.Counter()
    for text, _, _ in labelled:
        met.update({pii_tokens.word_key(t) for t in set(pii_tokens.TOKEN.findall(text)) if t[-1].isalnum()})
    return np.array([k for k, n in met.most_common(WORDS) if n >= LEAST], np.uint32)


def tagged_windows(labelled: list[Labelled], types: pii_tokens.Types, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(N, LENGTH) types and tags of windows of labelled texts; windows over unsure places are left out."""
    rng = random.Random(seed)
    all_types, all_tags = [], []
    for text, spans, unsure in labelled:
        w = pii_windows.cut([text], types)
        n = len(w.starts)
        if not n:
            continue
        ids, tags, sure = np.r_[0, w.types][w.numbers], np.zeros(n, np.int8), np.ones(n, bool)
        for a, b, kind in spans:
            x, y = np.searchsorted(w.ends, a, side="right"), np.searchsorted(w.starts, b, side="left")
            tags[x:y] = 2 * tagger.KINDS.index(kind) + 2
            if x < y:
                tags[x] -= 1
        for a, b in unsure:
            sure[np.searchsorted(w.ends, a, side="right") : np.searchsorted(w.starts, b, side="left")] = False
        at = -rng.randrange(LENGTH) if n > LENGTH else 0
        for s in range(at, n, LENGTH):
            x, y = max(0, s), min(n, s + LENGTH)
            if sure[x:y].all() and (tags[x:y].any() or rng.random() < KEEP):
                all_types.append(np.pad(ids[x:y], (0, LENGTH - y + x)))
                all_tags.append(np.pad(tags[x:y], (0, LENGTH - y + x)))
    return np.array(all_types, np.int32), np.array(all_tags, np.int8)


def _of_text(text: str) -> list[Labelled]:
    spans, unsure = pii_spans.label(text, _COMMON)
    return [(text, spans, unsure), *([pii_spans.varied(text, spans, unsure, random.Random(len(text)))] if spans else [])]


_COMMON: set[str] = set()


def of_texts(texts: list[str]) -> list[Labelled]:
    """The sampled texts, as they are and varied."""
    _COMMON.update(pii_spans.common_words(texts))
    with multiprocessing.get_context("fork").Pool(min(8, os.cpu_count() or 1)) as pool:
        return [x for done in pool.imap(_of_text, texts, 50) for x in done]


def _made(seed: int) -> list[Labelled]:
    rng = random.Random(seed)
    return [(*pii_made.passage(rng), []) for _ in range(500)]


def made_up(passages: int, seed: int = 11) -> list[Labelled]:
    with multiprocessing.get_context("fork").Pool(min(8, os.cpu_count() or 1)) as pool:
        return [x for done in pool.imap(_made, range(seed * 1000, seed * 1000 + passages // 500)) for x in done]


def main() -> None:
    table = pq.read_table(sys.argv[1], columns=["doc_id", "text"]).sort_by("doc_id")
    texts = [t for t in table.column("text").to_pylist() if t]
    texts = random.Random(1).sample(texts, min(SAMPLE, len(texts)))
    steps = int(sys.argv[2]) if len(sys.argv) > 2 else STEPS
    labelled = [of_texts(texts), made_up(MADE)]
    words = vocabulary([x for part in labelled for x in part])
    types = pii_tokens.Types(words)
    parts = [tagged_windows(part, types) for part in labelled]
    print("windows of texts", parts[0][0].shape, "made", parts[1][0].shape, "types", len(types), "words", len(words), flush=True)
    # As many windows of the one as of the other.
    rng = np.random.default_rng(2)
    least = min(len(part[0]) for part in parts)
    picks = [rng.permutation(len(part[0]))[: 2 * least] for part in parts]
    symbols, tags = (np.concatenate([part[k][pick] for part, pick in zip(parts, picks, strict=True)]) for k in (0, 1))
    features = types.features(np.arange(len(types) + 1))

    def save(p: dict[str, np.ndarray]) -> None:
        np.savez_compressed(WEIGHTS, words=words, **{k: v.astype(np.float16) for k, v in p.items()})

    def say(step: int, loss: float, p: dict[str, np.ndarray]) -> None:
        print(step, round(loss, 4), flush=True)
        if step % 500 == 0:
            save(p)

    save(tagger.train(tagger.start_tokens(HIDDEN, len(words)), features, symbols, tags, steps, say=say, workers=min(8, os.cpu_count() or 1)))


if __name__ == "__main__":
    main()
