"""A gated recurrent language model in numpy, with truncated backpropagation and a class-factored softmax.

Tokens are small integers. The output is the probability of the token's class times that of the token
within its class; class c holds the tokens bounds[c] .. bounds[c + 1] - 1. Texts run in lanes, window by
window; a lane carries its state from window to window and starts the next text from zero when one ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

EMBED, HIDDEN = 16, 16
#: Steps of a window, and lanes in scoring and in training.
WINDOW, LANES, TRAIN_LANES = 32, 512, 256


@dataclass(frozen=True)
class Shape:
    """``bounds`` of the classes."""

    bounds: tuple[int, ...]

    @property
    def size(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1

    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes), np.diff(self.bounds)).astype(np.uint16)


def fresh(shape: Shape, counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters that begin at the counts' frequencies. Input ``size`` stands for the start of a text."""
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    mass, kinds = np.maximum(counts.astype(np.float64), 0.5), shape.class_of()
    by_class = np.bincount(kinds, mass, shape.classes)
    return {
        "embed": rng.standard_normal((shape.size + 1, EMBED)).astype(np.float32) * np.float32(0.3),
        "w": f(EMBED, 3 * HIDDEN),
        "u": f(HIDDEN, 3 * HIDDEN),
        "b": np.r_[np.full(HIDDEN, 1.0), np.zeros(2 * HIDDEN)].astype(np.float32),  # the state is kept at first
        "class_w": f(HIDDEN, shape.classes) * np.float32(0.1),
        "class_b": np.log(by_class / by_class.sum()).astype(np.float32),
        "word_w": f(HIDDEN, shape.size) * np.float32(0.1),
        "word_b": np.log(mass / by_class[kinds]).astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parts of ``v``, as views where it is single precision."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out


def windows(texts: list[np.ndarray], lanes: int, steps: int, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of steps x lanes: inputs, targets, the text of each place (-1: none), lanes in use, lanes that begin a text.

    The longest texts go first, so that few lanes are idle at the end; idle lanes are dropped.
    """
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")[: int((size > 0).sum())]
    pos, doc, lane, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    free = np.arange(lanes)
    begin = np.r_[0, np.cumsum(size)]
    tokens = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
    before = np.r_[start, tokens[:-1]].astype(tokens.dtype) if len(tokens) else tokens
    before[begin[:-1][size > 0]] = start
    while True:
        n = min(len(free), len(order) - taken)
        if n:
            doc, lane, pos = np.r_[doc, order[taken : taken + n]], np.r_[lane, free[:n]], np.r_[pos, np.zeros(n, np.int64)]
            free, taken = free[n:], taken + n
        if not len(doc):
            return
        at = pos + np.arange(steps)[:, None]
        ok = at < size[doc]
        place = np.where(ok, begin[doc] + at, 0)
        yield before[place], tokens[place], np.where(ok, doc, -1), lane, pos == 0
        pos = pos + steps
        done = pos >= size[doc]
        free = np.r_[free, lane[done]]
        doc, lane, pos = doc[~done], lane[~done], pos[~done]


def _states(p: dict, table: np.ndarray, inputs: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """States after each step; ``table`` holds each input's part of the gates, ``keep`` gets z, r, c and the state's part of c."""
    out, u, n = np.empty((len(inputs), *h.shape), np.float32), p["u"], HIDDEN
    for t, x in enumerate(inputs):
        a, v = np.take(table, x, axis=0), h @ u
        zr = a[:, : 2 * n] + v[:, : 2 * n]
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r, past = zr[:, :n], zr[:, n:], v[:, 2 * n :]
        c = r * past
        c += a[:, 2 * n :]
        np.tanh(c, c)
        new = np.subtract(h, c, out=out[t])
        new *= z
        new += c
        if keep is not None:
            keep[0, t], keep[1, t], keep[2, t], keep[3, t] = z, r, c, past
        h = new
    return out


def _softmax(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials and their sums by row, and the log-softmax of each row at one place.

    States lie within 1, so logits rarely need their maximum off.
    """
    own = logits[np.arange(len(at)), at].astype(np.float64)
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        whole = e @ np.ones(logits.shape[1], e.dtype)
    if not (np.isfinite(whole).all() and (whole > 1e-20).all()):
        top = logits.max(axis=1)
        e = np.exp(logits - top[:, None])
        whole, own = e.sum(axis=1), own - top
    return e, whole, own - np.log(whole)


def _runs(kinds: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each class that occurs in sorted ``kinds``, with its place."""
    cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True]) if len(kinds) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(kinds[a]), slice(a, b)


def score(p: dict, shape: Shape, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole text."""
    total, kinds_of, bounds = np.zeros(len(texts)), shape.class_of(), shape.bounds
    table = p["embed"] @ p["w"] + p["b"]
    state = np.zeros((LANES, HIDDEN), np.float32)
    for inputs, targets, doc, lane, begins in windows(texts, LANES, WINDOW, shape.size):
        h = np.where(begins[:, None], np.float32(0), state[lane])
        hs = _states(p, table, inputs, h)
        state[lane] = hs[-1]
        used = doc >= 0
        y = targets[used]
        order = np.argsort(kinds_of[y], kind="stable")
        x, y, d = hs[used][order], y[order], doc[used][order]
        kinds = kinds_of[y]
        got = _softmax(x @ p["class_w"] + p["class_b"], kinds)[2]
        for c, rows in _runs(kinds):
            a, b = bounds[c], bounds[c + 1]
            if b - a > 1:
                got[rows] += _softmax(x[rows] @ p["word_w"][:, a:b] + p["word_b"][a:b], y[rows] - a)[2]
        total += np.bincount(d, got, len(texts))
    return total


def gradients(p: dict, shape: Shape, kinds_of: np.ndarray, table: np.ndarray, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, h: np.ndarray, g: dict | None = None) -> tuple[float, dict, np.ndarray]:
    """Mean loss over the used places of a window, its gradients, and the state at the window's end.

    Backpropagation stops at the window's first step; the state that it began with is taken as given.
    """
    n, keep = HIDDEN, np.empty((4, *inputs.shape, HIDDEN), np.float32)
    hs = _states(p, table, inputs, h, keep)
    y = targets[used]
    order = np.argsort(kinds_of[y], kind="stable")
    x, y = hs[used][order], y[order]
    count, kinds = len(y), kinds_of[y]
    g = {k: np.empty_like(v) for k, v in p.items()} if g is None else g
    g["embed"][:], g["word_w"][:], g["word_b"][:] = 0, 0, 0

    def step(logits: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        d, whole, logp = _softmax(logits, at)
        d *= (1 / (whole * count)).astype(d.dtype)[:, None]
        d[np.arange(len(at)), at] -= d.dtype.type(1 / count)
        return -float(logp.sum()), d

    loss, d = step(x @ p["class_w"] + p["class_b"], kinds)
    g["class_w"][:], g["class_b"][:] = x.T @ d, d.sum(axis=0)
    dx = d @ p["class_w"].T
    for c, rows in _runs(kinds):
        a, b = shape.bounds[c], shape.bounds[c + 1]
        if b - a > 1:
            own, w = x[rows], p["word_w"][:, a:b]
            more, d = step(own @ w + p["word_b"][a:b], y[rows] - a)
            loss += more
            g["word_w"][:, a:b], g["word_b"][a:b] = own.T @ d, d.sum(axis=0)
            dx[rows] += d @ w.T
    dhs = np.zeros(hs.shape, hs.dtype)
    sorted_back = np.empty_like(dx)
    sorted_back[order] = dx
    dhs[used] = sorted_back
    z, r, c, past = keep
    before = np.concatenate([h[None].astype(np.float32), hs[:-1]])
    to_a, to_z, to_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), past * r * (1 - r)
    back, through, ut = np.zeros(h.shape, np.float32), np.empty((*inputs.shape, 3 * n), np.float32), np.ascontiguousarray(p["u"].T)
    das = np.empty(hs.shape, np.float32)
    for t in range(len(inputs) - 1, -1, -1):
        dh, own = dhs[t], through[t]
        dh += back
        da = np.multiply(dh, to_a[t], out=das[t])
        np.multiply(dh, to_z[t], out=own[:, :n])
        np.multiply(da, to_r[t], out=own[:, n : 2 * n])
        np.multiply(da, r[t], out=own[:, 2 * n :])
        back = own @ ut
        dh *= z[t]
        back += dh
    g["u"][:] = before.reshape(-1, n).T @ through.reshape(-1, 3 * n)
    through[:, :, 2 * n :] = das
    flat_gates, flat_inputs = through.reshape(-1, 3 * n), inputs.reshape(-1)
    g["b"][:] = flat_gates.sum(axis=0)
    by_input = np.argsort(flat_inputs.astype(np.uint16), kind="stable")
    tokens = flat_inputs[by_input]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    summed, tokens = np.add.reduceat(flat_gates[by_input], first, axis=0), tokens[first]
    g["w"][:] = p["embed"][tokens].T @ summed
    g["embed"][tokens] = summed @ p["w"].T
    return loss / count, g, hs[-1]


def train(p: dict, shape: Shape, texts: list[np.ndarray], rate: float = 0.01, lanes: int = TRAIN_LANES, steps: int = WINDOW, passes: int = 1) -> tuple[dict, int, float]:
    """Passes of Adam over the texts: new parameters, tokens seen and their summed loss."""
    kinds_of, all_p = shape.class_of(), flat(p).astype(np.float32)
    p, all_g = unflat(all_p, p), np.empty_like(all_p)  # the parameters and gradients are views of one vector
    g, m, v = unflat(all_g, p), np.zeros_like(all_p), np.zeros_like(all_p)
    state, seen, total, step = np.zeros((lanes, HIDDEN), np.float32), 0, 0.0, 0
    for _ in range(passes):
        for inputs, targets, doc, lane, begins in windows(texts, lanes, steps, shape.size):
            h = np.where(begins[:, None], np.float32(0), state[lane])
            used = doc >= 0
            loss, _, state[lane] = gradients(p, shape, kinds_of, p["embed"] @ p["w"] + p["b"], inputs, targets, used, h, g)
            k = int(used.sum())
            seen, total, step = seen + k, total + loss * k, step + 1
            norm = float(np.sqrt(all_g @ all_g))
            if norm > 1:
                all_g *= np.float32(1 / norm)
            m *= np.float32(0.9)
            m += np.float32(0.1) * all_g
            v *= np.float32(0.99)
            np.multiply(all_g, all_g, out=all_g)
            all_g *= np.float32(0.01)
            v += all_g
            np.sqrt(v, out=all_g)
            all_g *= np.float32((1 - 0.99**step) ** -0.5)
            all_g += np.float32(1e-8)
            np.divide(m, all_g, out=all_g)
            all_g *= np.float32(rate / (1 - 0.9**step))
            all_p -= all_g
    return p, seen, total
