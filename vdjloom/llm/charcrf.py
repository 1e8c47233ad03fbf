"""A character-level bidirectional LSTM with a CRF on top, trained and run with numpy.

Gates and cells are piecewise linear (clipped to 0..1 and to -1..1), so a step
costs additions and comparisons only.  Both directions are computed as one
array of shape (2, windows, hidden), the second on reversed characters.
"""

from __future__ import annotations

import numpy as np

#: Characters are told apart by their first UTF-8 byte; 0 pads a window.
SYMBOLS = 256


def initial(hidden: int, tags: int, seed: int) -> dict[str, np.ndarray]:
    """Gates come in the order forget, input, output, cell."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (2, SYMBOLS, 4 * hidden))
    table[:, :, :hidden] += 1  # remember, to begin with
    return {k: v.astype(np.float32) for k, v in {
        "table": table, "inner": rng.normal(0, 0.5 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
        "out": rng.normal(0, 0.3, (2, hidden, tags)), "bias": np.zeros(tags),
        "step": np.zeros((tags, tags)), "first": np.zeros(tags), "last": np.zeros(tags)}.items()}


def _run(p: dict, chars: np.ndarray, keep: bool = False):
    """Tag scores (length, windows, tags) of ``chars`` (windows, length); with ``keep`` also what a backward pass needs."""
    n, length = chars.shape
    hidden, tags = p["inner"].shape[1], p["bias"].size
    at = [np.ascontiguousarray(chars.T), np.ascontiguousarray(chars[:, ::-1].T)]
    h = np.zeros((2, n, hidden), np.float32)
    c = np.zeros((2, n, hidden), np.float32)
    z = np.empty((2, n, 4 * hidden), np.float32)
    scores = np.empty((2, length, n, tags), np.float32)
    saved = []
    for t in range(length):
        np.matmul(h, p["inner"], out=z)
        for d in (0, 1):
            z[d] += p["table"][d].take(at[d][t], axis=0)
        np.clip(z, -1, 1, out=z)
        gate = z[:, :, :3 * hidden]
        gate += 1
        gate *= 0.5
        forget, let, show, new = (z[:, :, k * hidden:(k + 1) * hidden] for k in range(4))
        before, hb = c, h
        c = forget * c
        c += let * new
        bounded = np.clip(c, -1, 1)
        h = show * bounded
        np.matmul(h, p["out"], out=scores[:, t])
        if keep:
            saved.append((z.copy(), before, c, bounded, hb, h))
    total = scores[0] + scores[1, ::-1] + p["bias"]
    return (total, at, saved) if keep else total


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_slopes(p: dict, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of ``tags`` (windows, length), and its gradient."""
    total, at, saved = _run(p, chars, keep=True)
    length, n, k = total.shape
    hidden = p["inner"].shape[1]
    e = total.astype(np.float64)
    step, first, last = (p[v].astype(np.float64) for v in ("step", "first", "last"))
    y, rows = tags.T, np.arange(n)
    ahead = [first + e[0]]
    for t in range(1, length):
        ahead.append(_log_sum(ahead[-1][:, :, None] + step, 1) + e[t])
    whole = _log_sum(ahead[-1] + last, 1)
    behind = [np.broadcast_to(last, (n, k))]
    for t in range(length - 1, 0, -1):
        behind.append(_log_sum(step + (e[t] + behind[-1])[:, None, :], 2))
    behind.reverse()
    path = first[y[0]] + last[y[-1]] + sum(e[t][rows, y[t]] for t in range(length)) + sum(step[y[t - 1], y[t]] for t in range(1, length))
    loss = float((whole - path).mean())
    g = {v: np.zeros_like(p[v], dtype=np.float64) for v in p}
    de = np.empty((length, n, k))
    for t in range(length):
        de[t] = np.exp(ahead[t] + behind[t] - whole[:, None])
        if t:
            pair = np.exp(ahead[t - 1][:, :, None] + step + (e[t] + behind[t])[:, None, :] - whole[:, None, None])
            g["step"] += pair.sum(axis=0)
            np.add.at(g["step"], (y[t - 1], y[t]), -1)
        de[t][rows, y[t]] -= 1
    g["first"], g["last"] = de[0].sum(axis=0), de[-1].sum(axis=0)
    g["bias"] = de.sum(axis=(0, 1))
    # Back through both directions at once.
    d_out = np.stack([de, de[::-1]]).astype(np.float32)
    dh_next = np.zeros((2, n, hidden), np.float32)
    dc = np.zeros((2, n, hidden), np.float32)
    d_table = np.zeros_like(p["table"])
    inner_back, out_back = p["inner"].transpose(0, 2, 1), p["out"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        z, before, c, bounded, hb, h = saved[t]
        forget, let, show, new = (z[:, :, j * hidden:(j + 1) * hidden] for j in range(4))
        g["out"] += h.transpose(0, 2, 1) @ d_out[:, t]
        dh = d_out[:, t] @ out_back + dh_next
        dc = dc + dh * show * (np.abs(c) < 1)
        dz = np.concatenate([dc * before, dc * new, dh * bounded, dc * let], axis=2)
        gates = z[:, :, :3 * hidden]
        dz[:, :, :3 * hidden] *= 0.5 * ((gates > 0) & (gates < 1))
        dz[:, :, 3 * hidden:] *= np.abs(new) < 1
        g["inner"] += hb.transpose(0, 2, 1) @ dz
        for d in (0, 1):
            order = np.argsort(at[d][t], kind="stable")
            symbols, start = np.unique(at[d][t][order], return_index=True)
            d_table[d][symbols] += np.add.reduceat(dz[d][order], start, axis=0)
        dh_next = dz @ inner_back
        dc = dc * forget
    g["table"] = d_table
    return loss, {v: (x / n).astype(np.float32) for v, x in g.items()}


def train(p: dict, batches, rate: float = 0.01) -> list[float]:
    """Adam over ``batches`` of (chars, tags), in place; returns the losses."""
    first, second = ({v: np.zeros_like(x) for v, x in p.items()} for _ in range(2))
    losses = []
    batches = list(batches)
    for i, (chars, tags) in enumerate(batches, 1):
        loss, g = loss_and_slopes(p, chars, tags)
        losses.append(loss)
        size = np.sqrt(sum(float((x ** 2).sum()) for x in g.values()))
        now = rate * min(1.0, 2 * (1 - i / (len(batches) + 1)))
        for v, x in g.items():
            x = x * min(1.0, 5 / (size + 1e-9))
            first[v] = 0.9 * first[v] + 0.1 * x
            second[v] = 0.999 * second[v] + 0.001 * x * x
            p[v] -= now * (first[v] / (1 - 0.9 ** i)) / (np.sqrt(second[v] / (1 - 0.999 ** i)) + 1e-8)
    return losses


def prepared(p: dict) -> dict[str, np.ndarray]:
    """``p`` for ``decode``: the shift of the gates and the halves are moved into the weights, tags come before windows."""
    hidden = p["inner"].shape[1]
    table = p["table"].copy()
    table[:, :, :3 * hidden] += 1  # gates are now twice as large and clipped to 0..2
    return {"table": table, "inner": p["inner"] / 2, "out": np.ascontiguousarray(p["out"].transpose(0, 2, 1)) / 2,
            **{v: p[v] for v in ("bias", "step", "first", "last")}}


def tag_scores(q: dict, chars: np.ndarray) -> np.ndarray:
    """Tag scores (length, tags, windows) by the weights of ``prepared``."""
    n, length = chars.shape
    hidden, tags = q["inner"].shape[1], q["bias"].size
    at = [np.ascontiguousarray(chars.T), np.ascontiguousarray(chars[:, ::-1].T)]
    h, c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
    z, new = np.empty((2, n, 4 * hidden), np.float32), np.empty((2, n, hidden), np.float32)
    scores = np.empty((2, length, tags, n), np.float32)
    for t in range(length):
        np.matmul(h, q["inner"], out=z)
        for d in (0, 1):
            z[d] += q["table"][d].take(at[d][t], axis=0)
        gates = z[:, :, :3 * hidden]
        np.clip(gates, 0, 2, out=gates)
        np.clip(z[:, :, 3 * hidden:], -1, 1, out=new)
        c *= gates[:, :, :hidden]
        new *= gates[:, :, hidden:2 * hidden]
        c += new
        c *= 0.5
        np.clip(c, -1, 1, out=h)
        h *= gates[:, :, 2 * hidden:]
        np.matmul(q["out"], h.transpose(0, 2, 1), out=scores[:, t])
    total = scores[0]
    total += scores[1, ::-1]
    total += q["bias"][:, None]
    return total


def decode(q: dict, chars: np.ndarray) -> np.ndarray:
    """Best tags (windows, length) by Viterbi, with the weights of ``prepared``; of equal paths the one of smaller tags."""
    e = tag_scores(q, chars)
    length, tags, n = e.shape
    step = q["step"]
    value = np.empty_like(e)
    value[0] = e[0] + q["first"][:, None]
    for t in range(1, length):
        for j in range(tags):
            best = value[t, j]
            np.add(value[t - 1, 0], step[0, j], out=best)
            for i in range(1, tags):
                np.maximum(best, value[t - 1, i] + step[i, j], out=best)
        value[t] += e[t]
    final = value[-1] + q["last"][:, None]
    # The path of zeros alone, added up in the same order: where it is as good as the best, it is the best.
    zeros = value[0, 0].copy()
    for t in range(1, length):
        zeros += step[0, 0]
        zeros += e[t, 0]
    marked = np.flatnonzero(final.max(axis=0) > zeros + q["last"][0])
    out = np.zeros((n, length), np.uint8)
    tag = final[:, marked].argmax(axis=0)
    out[marked, -1] = tag
    for t in range(length - 1, 0, -1) if len(marked) else ():
        tag = (value[t - 1][:, marked] + step[:, tag]).argmax(axis=0)
        out[marked, t - 1] = tag
    return out
