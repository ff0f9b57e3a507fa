"""A small gated recurrent language model in numpy, with a class-factored output softmax.

The vocabulary is a list of frequent words, of which the first is the end of a text, and TAILS tail classes that stand for
all other words by their looks. Frequent words lie in groups by frequency, of GROUP or of the square root of their number;
the network predicts a group or a tail class from its state, and then the word within the group. Weights start so that the model is the unigram model of the
counts; truncated backpropagation then fits the rest.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

from catalens.llm.common import ship_with_tasks

ship_with_tasks(__name__)

HIDDEN = 32
#: Least words of a group.
GROUP = 32
TAILS = 8
#: Steps of a window: of truncated backpropagation, and between output layers when scoring.
TRAIN_STEPS, SCORE_STEPS = 24, 64
#: Texts trained or scored side by side.
TRAIN_LANES, SCORE_LANES = 64, 256
RATE, PASSES, SEED = 0.01, 3, 7
#: Rows of the output layer that are worked on at a time.
OUTPUT_ROWS = 2048
#: Rows of a sum, up to which it is made together with others.
SHORT_SUM = 16
_SYMBOLS = frozenset(b"!%&*$#|@<>=+/\\^~_[]{}()")
#: Of every byte: 1 a symbol, 2 a digit, 4 beyond ASCII, 8 a closing mark.
_MARKS = np.array([(c in _SYMBOLS) + 2 * (48 <= c <= 57) + 4 * (c > 127) + 8 * (c in b".,;:?\"'") for c in range(256)], np.uint8)


def tail_class(word: bytes) -> int:
    """Looks of a word: letters beyond ASCII or not, times plain, closing mark, symbols, digits."""
    if any(c in _SYMBOLS for c in word):
        kind = 2
    elif any(48 <= c <= 57 for c in word):
        kind = 3
    else:
        kind = int(word[-1] in b".,;:?\"'")
    return kind + 4 * (not word.isascii())


def tail_classes(edges: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """tail_class of many words: word i is letters[edges[i]:edges[i + 1]], none is empty."""
    if len(edges) < 2:
        return np.empty(0, np.int64)
    marks = np.bitwise_or.reduceat(_MARKS[letters[:edges[-1]]], edges[:-1])
    last = _MARKS[letters[edges[1:] - 1]] & 8 > 0
    return np.where(marks & 1, 2, np.where(marks & 2, 3, last)) + (marks & 4)


def initial(counts: np.ndarray, tail_mass: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the unigram model: counts of the frequent words (the end first), mass of the tail classes."""
    rng, n = np.random.default_rng(SEED), len(counts)
    width = max(GROUP, int(np.ceil(np.sqrt(n))))
    groups = -(-n // width)
    word_bias = np.full(groups * width, -1e9)
    word_bias[:n] = np.log(counts + 0.5)
    word_bias = word_bias.reshape(groups, width)
    group_mass = np.log(np.exp(word_bias).sum(axis=1))
    f = np.float32
    return {
        "E": (rng.normal(0, 0.1, (n + TAILS + 1, 3 * HIDDEN))).astype(f),
        "U": (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
        "Wc": np.zeros((HIDDEN, groups + TAILS), f), "bc": np.concatenate((group_mass, np.log(tail_mass))).astype(f),
        "Ww": np.zeros((groups, HIDDEN, width), f), "bw": word_bias.astype(f)}


def _by_gate(p: dict) -> np.ndarray:
    """Weights of the state by gate (update, reset, new), so that every gate's numbers lie together; the first two negated."""
    u = np.ascontiguousarray(p["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
    np.negative(u[:2], out=u[:2])
    return u


def _gates(p: dict, x: np.ndarray) -> np.ndarray:
    """Inputs of the gates for symbols, the gates first."""
    return p["E"].take(x, axis=0).reshape(len(x), 3, HIDDEN).transpose(1, 0, 2)


def _step(u: np.ndarray, gate: np.ndarray, h: np.ndarray, out: np.ndarray, a: np.ndarray | None = None, n: np.ndarray | None = None):
    """Writes the state after h to out; u: weights by gate.

    a and n, if given, get both gates and what the reset gate multiplies, and the new part.
    """
    a = np.matmul(h, u, out=a)
    zr, un = a[:2], a[2]
    zr -= gate[:2]
    np.exp(zr, out=zr)
    zr += 1.0
    np.reciprocal(zr, out=zr)
    n = np.multiply(zr[1], un, out=n)
    n += gate[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[0]
    out += n


def _softmax(x: np.ndarray, picked: np.ndarray, keep: bool) -> np.ndarray:
    """Natural-log probability of the picked row of each column; x becomes the probabilities less 1 there, if kept."""
    at = picked * x.shape[1] + np.arange(x.shape[1])
    x -= x.max(axis=0)
    out = x.take(at)
    np.exp(x, out=x)
    total = np.ones(len(x), np.float32) @ x
    out -= np.log(total)
    if keep:
        x *= np.reciprocal(total)
        x.reshape(-1)[at] -= 1.0
    return out


def _output(p: dict, states: np.ndarray, target: np.ndarray, grad: dict | None = None):
    """Natural-log probability of each target after its state; with grad, adds the loss's gradients and returns the states'.

    Rows are taken OUTPUT_ROWS at a time, which stay in the processor's cache. A softmax holds a column for each, so that it is
    worked on by long rows; a state ends with a one, which the bias multiplies.
    """
    (groups, _, width), frequent = p["Ww"].shape, p["E"].shape[0] - TAILS - 1
    cls = np.where(target < frequent, target // width, target - frequent + groups)
    out, ds = np.empty(len(target)), None if grad is None else np.empty_like(states)
    biased = np.ones((len(states), HIDDEN + 1), np.float32)
    biased[:, :HIDDEN] = states
    wct, gc = np.ascontiguousarray(np.vstack((p["Wc"], p["bc"])).T), 0.0
    for lo in range(0, len(target), OUTPUT_ROWS):
        s, c = biased[lo:lo + OUTPUT_ROWS], cls[lo:lo + OUTPUT_ROWS]
        x = wct @ s.T
        out[lo:lo + OUTPUT_ROWS] = _softmax(x, c, grad is not None)
        if grad is not None:
            gc += x @ s
            np.matmul(x.T, wct[:, :HIDDEN], out=ds[lo:lo + OUTPUT_ROWS])
    order = np.argsort(cls.astype(np.int16 if groups < 30_000 else np.int64), kind="stable")
    edges = np.searchsorted(cls[order], np.arange(groups + 1)).tolist()
    order = order[:edges[-1]]
    ww = np.concatenate((p["Ww"], p["bw"][:, None]), axis=1).transpose(0, 2, 1)
    gw = None if grad is None else np.zeros((groups, width, HIDDEN + 1), np.float32)
    first = 0
    while first < groups:
        # Groups of a few rows share one softmax; a group of many rows is one by itself.
        last = max(first + 1, bisect_right(edges, edges[first] + OUTPUT_ROWS) - 1)
        lo, hi = edges[first], edges[last]
        if hi > lo:
            rows = order[lo:hi]
            s, x = biased.take(rows, axis=0), np.empty((width, hi - lo), np.float32)
            parts = [(g, slice(edges[g] - lo, edges[g + 1] - lo)) for g in range(first, last) if edges[g + 1] > edges[g]]
            for g, at in parts:
                np.matmul(ww[g], s[at].T, out=x[:, at])
            out[rows] += _softmax(x, target[rows] - cls[rows] * width, grad is not None)
            if grad is not None:
                d = np.empty((hi - lo, HIDDEN), np.float32)
                for g, at in parts:
                    np.matmul(x[:, at], s[at], out=gw[g])
                    np.matmul(x[:, at].T, p["Ww"][g].T, out=d[at])
                ds[rows] += d
        first = last
    if grad is None:
        return out
    if len(target):
        grad["Wc"] += gc[:, :HIDDEN].T
        grad["bc"] += gc[:, HIDDEN]
    grad["Ww"] += gw[:, :, :HIDDEN].transpose(0, 2, 1)
    grad["bw"] += gw[:, :, HIDDEN]
    return out, ds


def _sums(rows: np.ndarray, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows order[edges[i]:edges[i + 1]] for every i; the last row of rows holds zeros.

    Short sums of like length are made together, filled up with zeros; a long one by itself.
    """
    sizes = np.diff(edges, append=len(order))
    out = np.empty((len(edges), rows.shape[1]), rows.dtype)
    few, many = 0, 1
    while few < SHORT_SUM:
        picked = np.flatnonzero((sizes > few) & (sizes <= many))
        at, place = np.arange(many), edges[picked, None]
        place = np.where(at < sizes[picked, None], order.take(place + at, mode="clip"), len(rows) - 1)
        part = rows.take(place[:, 0], axis=0)
        for column in range(1, many):
            part += rows.take(place[:, column], axis=0)
        out[picked] = part
        few, many = many, 2 * many
    for i in np.flatnonzero(sizes > few).tolist():
        part = rows.take(order[edges[i]:edges[i] + sizes[i]], axis=0)
        out[i] = np.ones(len(part), rows.dtype) @ part
    return out


def log_probabilities(p: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Natural-log probability of each whole text, given as symbols with the end symbol last.

    Texts run side by side, longest first; a text's state goes on from window to window until its end.
    """
    out, start = np.zeros(len(texts)), p["E"].shape[0] - 1
    u, sizes = _by_gate(p), np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), SCORE_LANES):
        lanes = order[lo:lo + SCORE_LANES]
        h, last = np.zeros((len(lanes), HIDDEN), np.float32), np.full(len(lanes), start)
        for t0 in range(0, int(sizes[lanes[0]]), SCORE_STEPS):
            live = int((sizes[lanes] > t0).sum())
            width = int(min(SCORE_STEPS, sizes[lanes[0]] - t0))
            y = np.full((width, live), -1)
            for i in range(live):
                part = texts[lanes[i]][t0:t0 + width]
                y[:len(part), i] = part
            x = np.vstack((last[None, :live], np.where(y[:-1] >= 0, y[:-1], 0)))
            h = h[:live]
            states = np.empty((width, live, HIDDEN), np.float32)
            for t in range(width):
                _step(u, _gates(p, x[t]), h, states[t])
                h = states[t]
            last = np.where(y[-1] >= 0, y[-1], 0)
            rows, cols = np.nonzero(y >= 0)
            out[lanes[:live]] += np.bincount(cols, _output(p, states[rows, cols], y[rows, cols]), live)
    return out


def train(p: dict, texts: list[np.ndarray], passes: int = PASSES, rate: float = RATE,
          most_lanes: int = TRAIN_LANES) -> dict[str, np.ndarray]:
    """Truncated backpropagation with Adam over the texts one after the other; states start anew at every text.

    Rows of E move only in the steps that read them, so a step's work does not follow the number of words.
    """
    p = {k: v.copy() for k, v in p.items()}
    if not texts:
        return p
    flat = np.concatenate(texts)
    before = np.concatenate(([p["E"].shape[0] - 1], flat[:-1]))
    before = np.where(before == 0, p["E"].shape[0] - 1, before)  # after an end comes a start
    lanes = int(max(1, min(most_lanes, len(flat) // (4 * TRAIN_STEPS))))
    length = len(flat) // lanes
    xs, ys = (a[:lanes * length].reshape(lanes, length).T for a in (before, flat))
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    n, total, start = 0, passes * -(-length // TRAIN_STEPS), p["E"].shape[0] - 1
    # The memory of a window serves the next one.
    states, seen, new = (np.empty((TRAIN_STEPS, lanes, HIDDEN), np.float32) for _ in range(3))
    gates, by_symbol = np.empty((TRAIN_STEPS, 3, lanes, HIDDEN), np.float32), np.empty((TRAIN_STEPS * lanes + 1, 3 * HIDDEN), np.float32)
    d, (dh, dn, part, rest) = np.empty((lanes, 3 * HIDDEN), np.float32), np.empty((4, lanes, HIDDEN), np.float32)
    dz, dr, dun = (d[:, g * HIDDEN:(g + 1) * HIDDEN] for g in range(3))
    small = np.int16 if len(p["E"]) < 30_000 else np.int64
    for _ in range(passes):
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t0 in range(0, length, TRAIN_STEPS):
            x, y = xs[t0:t0 + TRAIN_STEPS], ys[t0:t0 + TRAIN_STEPS]
            grad, u, steps = {k: np.zeros_like(w) for k, w in p.items() if k != "E"}, _by_gate(p), len(x)
            starts = [np.flatnonzero(row) for row in x == start]
            for t in range(steps):
                seen[t] = h
                seen[t][starts[t]] = 0
                _step(u, _gates(p, x[t]), seen[t], states[t], gates[t], new[t])
                h = states[t]
            _, ds = _output(p, states[:steps].reshape(-1, HIDDEN), y.reshape(-1), grad)
            ds, ut = ds.reshape(steps, lanes, HIDDEN), np.ascontiguousarray(p["U"].T)
            by_symbol[steps * lanes], dh[...] = 0, 0
            for t in range(steps - 1, -1, -1):
                z, r, un = gates[t]
                dh += ds[t]
                np.subtract(1.0, z, out=rest)
                rest *= dh
                np.subtract(seen[t], new[t], out=part)
                part *= z
                np.multiply(part, rest, out=dz)
                np.multiply(new[t], new[t], out=dn)
                np.subtract(1.0, dn, out=dn)
                dn *= rest
                np.multiply(dn, r, out=part)
                dun[...] = part
                part *= un
                np.subtract(1.0, r, out=rest)
                np.multiply(part, rest, out=dr)
                at = by_symbol[t * lanes:(t + 1) * lanes]
                at[...] = d
                at[:, 2 * HIDDEN:] = dn
                grad["U"] += seen[t].T @ d
                dh *= z
                dh += np.matmul(d, ut, out=part)
                dh[starts[t]] = 0
            by_row = np.argsort(x.astype(small), axis=None, kind="stable")
            symbols = x.reshape(-1)[by_row]
            edges = np.flatnonzero(np.diff(symbols, prepend=-1))
            used, grad["E"] = symbols[edges], _sums(by_symbol[:steps * lanes + 1], by_row, edges)
            n += 1
            step = float(rate * (1 - n / (total + 1)) * np.sqrt(1 - 0.999 ** n) / (1 - 0.9 ** n))
            scale = 1.0 / x.size
            for k in p:
                g, at = grad[k], used if k == "E" else ...
                g *= scale
                mk, vk = (w[k].take(used, axis=0) if k == "E" else w[k] for w in (m, v))
                mk += 0.1 * (g - mk)
                g *= g
                g -= vk
                g *= 0.001
                vk += g
                if k == "E":
                    m[k][at], v[k][at] = mk, vk
                np.sqrt(vk, out=g)
                g += 1e-8
                np.divide(mk, g, out=g)
                g *= step
                p[k][at] -= g
    return p


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
