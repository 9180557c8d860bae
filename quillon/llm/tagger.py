"""A bidirectional LSTM over tokens with CRF transitions, in numpy.

Tags are 0 (outside) and two for each kind of personal information: its first token and the further ones. The
forward pass and the decoder work on many windows at once; training is full back-propagation through the
embeddings, both directions and the CRF.
"""

from __future__ import annotations

import ctypes
import multiprocessing

import numpy as np

from quillon.llm import pii_tokens

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = 2 * len(KINDS) + 1
PAD = 0
#: Columns of the embeddings; rows of the tables of a network that reads numbers as they are.
WIDTH, SYMBOLS = 32, 101
#: Share of the distinct words of a batch that training hides, so that words never seen are judged by their shape.
HIDDEN_WORDS = 0.25
#: A score that no path with a further token of another kind gets over.
_NEVER = -60.0


def start(hidden: int, seed: int = 3) -> dict[str, np.ndarray]:
    """A network that reads numbers below SYMBOLS by a table of each direction."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.15, (SYMBOLS, 4 * hidden))
        p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)) * 0.7
        p[f"b{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
    p["e"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS))
    p["eb"] = np.zeros(TAGS)
    p["t"] = np.eye(TAGS) * 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def start_tokens(hidden: int, vocabulary: int, seed: int = 3) -> dict[str, np.ndarray]:
    """A network that reads tokens by the sum of their features' embeddings. A further token follows its own kind only."""
    rng = np.random.default_rng(seed)
    p = start(hidden, seed)
    for d in "fb":
        del p[f"x{d}"]
        p[f"m{d}"] = rng.normal(0, 0.5 / np.sqrt(WIDTH), (WIDTH, 4 * hidden)).astype(np.float32)
    p["w"] = rng.normal(0, 0.3, (pii_tokens.rows(vocabulary), WIDTH)).astype(np.float32)
    p["w"][0] = 0
    for k in range(len(KINDS)):
        others = [x for x in range(TAGS) if x not in (2 * k + 1, 2 * k + 2)]
        p["t"][others, 2 * k + 2] = _NEVER
        p["t"][2 * k + 1, 2 * k + 2] = 1.0
    return p


def tables(p: dict[str, np.ndarray], features: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The network with tables for the tokens of these features, numbered from 1, and the tokens' embeddings."""
    read = np.zeros((len(features) + 1, p["w"].shape[1]), np.float32)
    for column in features.T:
        read[1:] += p["w"][column]
    return p | {"xf": read @ p["mf"], "xb": read @ p["mb"]}, read


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(p: dict[str, np.ndarray], symbols: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, N, H) of one direction; ``keep`` stores what the backward pass needs. Gates: i, f, o, candidate."""
    t_len, n = symbols.shape
    hidden = p[f"u{d}"].shape[0]
    table = p[f"x{d}"] + p[f"b{d}"]
    u = p[f"u{d}"]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    out, kept = np.empty((t_len, n, hidden), np.float32), []
    for t in range(t_len) if d == "f" else range(t_len - 1, -1, -1):
        g = h @ u
        g += table[symbols[t]]
        g[:, : 3 * hidden] *= 0.5
        np.tanh(g, out=g)
        g[:, : 3 * hidden] *= 0.5
        g[:, : 3 * hidden] += 0.5
        i, f, o, z = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden : 3 * hidden], g[:, 3 * hidden :]
        new = f * c
        new += i * z
        # Padding resets the state, so that a window does not feel how much padding it has.
        live = (symbols[t] != PAD).astype(np.float32)[:, None]
        new *= live
        tc = np.tanh(new)
        if keep:
            kept.append((t, h, c, g, tc, live))
        h = o * tc
        h *= live
        c = new
        out[t] = h
    return out, kept


def _states(p: dict[str, np.ndarray], symbols: np.ndarray, d: str) -> np.ndarray:
    """Twice the states of _run, for reading only: all products go into buffers that are kept, and the halves of the sigmoid into the weights."""
    t_len, n = symbols.shape
    hidden = p[f"u{d}"].shape[0]
    half = np.r_[np.full(3 * hidden, 0.5), np.ones(hidden)].astype(np.float32)
    table, u = (p[f"x{d}"] + p[f"b{d}"]) * half, p[f"u{d}"] * (0.5 * half)
    g, read, part = np.empty((n, 4 * hidden), np.float32), np.empty((n, 4 * hidden), np.float32), np.empty((n, hidden), np.float32)
    # A gate is half of one more than these.
    i, f, o, z = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden : 3 * hidden], g[:, 3 * hidden :]
    out, h, c = np.empty((t_len, n, hidden), np.float32), np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    live = symbols != PAD
    whole = live.all(axis=1)
    for t in range(t_len) if d == "f" else range(t_len - 1, -1, -1):
        np.matmul(h, u, out=g)
        np.take(table, symbols[t], axis=0, out=read, mode="clip")
        g += read
        np.tanh(g, out=g)
        np.multiply(f, c, out=part)
        c += part
        np.multiply(i, z, out=part)
        c += part
        c += z
        c *= 0.5
        if not whole[t]:
            c *= live[t][:, None]
        h = out[t]
        np.tanh(c, out=part)
        np.multiply(o, part, out=h)
        h += part
    return out


def emissions(p: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """(T, N, TAGS) scores of symbols (T, N)."""
    f, b = _states(p, symbols, "f"), _states(p, symbols, "b")
    hidden = f.shape[2]
    scores = (f.reshape(-1, hidden) @ (0.5 * p["e"][:hidden])).reshape(*symbols.shape, -1)
    scores += (b.reshape(-1, hidden) @ (0.5 * p["e"][hidden:])).reshape(*symbols.shape, -1)
    scores += p["eb"]
    return scores


def decode(p: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """Best tag paths (T, N) by Viterbi."""
    e = np.ascontiguousarray(emissions(p, symbols).transpose(0, 2, 1))
    t_len, k, n = e.shape
    steps = np.ascontiguousarray(p["t"])
    # e becomes the score of the best path that ends in each tag; the way back looks again which tag it came by.
    reach, best = np.empty((k, k, n), np.float32), np.empty((k, n), np.float32)
    for t in range(1, t_len):
        np.add(e[t - 1][:, None], steps[:, :, None], out=reach)
        np.max(reach, axis=0, out=best)
        e[t] += best
    path = np.empty((t_len, n), np.int8)
    path[-1] = e[-1].argmax(axis=0)
    into = np.empty((k, n), np.float32)
    for t in range(t_len - 1, 0, -1):
        np.take(steps, path[t], axis=1, out=into, mode="clip")
        into += e[t - 1]
        path[t - 1] = into.argmax(axis=0)
    return path


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(p: dict[str, np.ndarray], symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood by window, and its gradient."""
    t_len, n = symbols.shape
    hf, kf = _run(p, symbols, "f", True)
    hb, kb = _run(p, symbols, "b", True)
    hidden = hf.shape[2]
    both = np.concatenate([hf, hb], axis=2)
    e = both @ p["e"] + p["eb"]
    trans = p["t"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_len):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(t_len - 2, -1, -1):
        beta[t] = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsumexp(alpha[-1], 1)
    rows = np.arange(n)
    gold = np.zeros(n)
    for t in range(t_len):
        gold += e[t, rows, tags[t]]
        if t:
            gold += trans[tags[t - 1], tags[t]]
    de = np.exp(alpha + beta - z[:, None])
    for t in range(t_len):
        de[t, rows, tags[t]] -= 1
    dt = np.zeros_like(trans)
    for t in range(1, t_len):
        dt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dt, (tags[t - 1], tags[t]), -1)
    de /= n
    grad = {"t": dt / n, "e": np.einsum("tnh,tnk->hk", both, de), "eb": de.sum(axis=(0, 1))}
    dh_all = de @ p["e"].T
    for d, kept, part in (("f", kf, slice(0, hidden)), ("b", kb, slice(hidden, None))):
        u = p[f"u{d}"]
        du, steps = np.zeros_like(u), []
        dh_next, dc_next = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        for t, h_before, c_before, g, tc, live in reversed(kept):
            i, f, o, cand = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden : 3 * hidden], g[:, 3 * hidden :]
            dh = (dh_all[t][:, part] + dh_next) * live
            dc = (dc_next + dh * o * (1 - tc * tc)) * live
            dg = np.concatenate([dc * cand * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
            du += h_before.T @ dg
            steps.append((symbols[t], dg))
            dh_next, dc_next = dg @ u.T, dc * f
        dx = np.zeros_like(p[f"x{d}"])
        read, moved = np.concatenate([a for a, _ in steps]), np.concatenate([g for _, g in steps])
        order = np.argsort(read, kind="stable")
        kinds, first = np.unique(read[order], return_index=True)
        dx[kinds] = np.add.reduceat(moved[order], first, axis=0)
        grad[f"x{d}"], grad[f"u{d}"], grad[f"b{d}"] = dx, du, dx.sum(axis=0)
    return float((z - gold).mean()), grad


def token_loss(p: dict[str, np.ndarray], features: np.ndarray, types: np.ndarray, tags: np.ndarray, rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
    """As loss_and_gradient for windows of tokens. features: of each type from 1; types, tags: (T, N)."""
    used, symbols = np.unique(types, return_inverse=True)
    own = features[used]
    if used[0] != PAD:
        symbols, own = symbols + 1, np.concatenate([features[:1], own])
    own = own[1:].copy()
    own[rng.random(len(own)) < HIDDEN_WORDS, -1] = 0
    q, read = tables(p, own)
    loss, grad = loss_and_gradient(q, symbols.reshape(types.shape), tags)
    back = np.zeros_like(read)
    for d in "fb":
        x = grad.pop(f"x{d}")
        grad[f"m{d}"] = read.T @ x
        back += x @ p[f"m{d}"].T
    grad["w"] = np.zeros_like(p["w"])
    for column in own.T:
        np.add.at(grad["w"], column, back[1:])
    grad["w"][0] = 0
    return loss, grad


def train(p: dict[str, np.ndarray], features: np.ndarray, windows: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.006, seed: int = 5, say=None, workers: int = 1) -> dict[str, np.ndarray]:
    """Adam with a linearly falling rate. windows, tags: (N, T). A step takes ``batch`` windows from each of ``workers`` processes."""
    with _Team(features, windows, tags, batch, seed, workers) as team:
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(x) for k, x in p.items()}
        average = 0.0
        for step in range(1, steps + 1):
            loss, grad = team.gradient(p)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            now = rate * min(1.0, step / 100) * max(0.02, 1 - step / steps)
            for k in p:
                g = grad[k].astype(np.float32) * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            average = loss if step == 1 else 0.98 * average + 0.02 * loss
            if say and step % 100 == 0:
                say(step, average, p)
    return p


def keep_memory() -> None:
    """Has the allocator keep freed memory: handing it back and fetching it anew at every product costs more than the products."""
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-1, 1 << 30), (-2, 1 << 27), (-3, 1 << 25)):
            libc.mallopt(option, value)
    except (OSError, AttributeError):
        pass


class _Team:
    """Processes that each take the gradient over windows of their own; one worker stays in this process."""

    def __init__(self, features: np.ndarray, windows: np.ndarray, tags: np.ndarray, batch: int, seed: int, workers: int) -> None:
        keep_memory()
        self.work = (features, windows, tags, batch)
        self.rng = np.random.default_rng(seed)
        self.pipes, self.others = [], []
        context = multiprocessing.get_context("fork")
        for k in range(workers - 1):
            mine, theirs = context.Pipe()
            other = context.Process(target=self._serve, args=(theirs, np.random.default_rng(seed + 1 + k)), daemon=True)
            other.start()
            self.pipes.append(mine)
            self.others.append(other)

    def _part(self, p: dict[str, np.ndarray], rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
        features, windows, tags, batch = self.work
        pick = rng.integers(0, len(windows), batch)
        longest = int((windows[pick] != PAD).sum(axis=1).max())
        return token_loss(p, features, windows[pick, :longest].T.copy(), tags[pick, :longest].T.copy(), rng)

    def _serve(self, pipe, rng: np.random.Generator) -> None:
        while (p := pipe.recv()) is not None:
            pipe.send(self._part(p, rng))

    def gradient(self, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        for pipe in self.pipes:
            pipe.send(p)
        parts = [self._part(p, self.rng), *(pipe.recv() for pipe in self.pipes)]
        n = len(parts)
        return sum(loss for loss, _ in parts) / n, {k: sum(g[k] for _, g in parts) / n for k in p}

    def __enter__(self) -> _Team:
        return self

    def __exit__(self, *_: object) -> None:
        for pipe, other in zip(self.pipes, self.others, strict=True):
            pipe.send(None)
            other.join()
