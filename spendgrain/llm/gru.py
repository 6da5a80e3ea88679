"""A bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of equal length. Each window is read in both
directions; both states together label every position. Gates use x / (1 + |x|)
in place of the logistic function and the hyperbolic tangent. Arrays are laid
out with the windows of a batch last, so each step works on long rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FILL = 256  # the symbol after the end of a text


@dataclass(frozen=True)
class Network:
    """table: what each byte adds to the gates (update, reset, candidate) of each direction; gates: what the state adds; head, bias: states to labels."""

    table: np.ndarray  # 2, 3h, 257
    gates: np.ndarray  # 2, 3h, h
    head: np.ndarray  # 2, labels, h
    bias: np.ndarray  # labels
    window: int


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _soft_into(x: np.ndarray, room: np.ndarray) -> None:
    np.abs(x, out=room)
    room += 1
    x /= room


def position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities (position, label, window) for windows of symbols (position, window)."""
    steps, n = windows.shape
    h = net.gates.shape[2]
    state, sums, drive = np.zeros((2, h, n), np.float32), np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
    room, wide, part = np.empty((2, h, n), np.float32), np.empty((2, 2 * h, n), np.float32), np.empty((2, len(net.bias), n), np.float32)
    out = np.broadcast_to(net.bias[:, None], (steps, len(net.bias), n)).copy()
    both = drive[:, : 2 * h], drive[:, 2 * h :]
    for t in range(steps):
        for d, at in ((0, t), (1, steps - 1 - t)):
            np.take(net.table[d], windows[at], axis=1, out=drive[d], mode="clip")
        np.matmul(net.gates, state, out=sums)
        gate, new = both
        gate += sums[:, : 2 * h]
        _soft_into(gate, wide)
        gate += 1
        gate *= 0.5
        np.multiply(gate[:, h:], sums[:, 2 * h :], out=room)
        new += room
        _soft_into(new, room)
        state -= new
        state *= gate[:, :h]
        state += new
        np.matmul(net.head, state, out=part)
        out[t] += part[0]
        out[steps - 1 - t] += part[1]
    out -= out.max(1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(1, keepdims=True)
    return out


def _loss_and_gradients(w: list[np.ndarray], windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions but filling ones, and its gradients by backpropagation through time."""
    table, gates, head, bias = w
    steps, n = windows.shape
    h = gates.shape[2]
    states = np.zeros((steps + 1, 2, h, n), np.float32)
    z, r, new, inner = (np.empty((steps, 2, h, n), np.float32) for _ in range(4))
    slopes = np.empty((steps, 2, 3 * h, n), np.float32)
    seen = np.stack([windows, windows[::-1]], 1)
    logits = np.broadcast_to(bias[:, None], (steps, len(bias), n)).copy()
    for t in range(steps):
        drive = np.stack([table[d][:, seen[t, d]] for d in range(2)])
        sums = gates @ states[t]
        a = drive[:, : 2 * h] + sums[:, : 2 * h]
        g = (1 + _soft(a)) / 2
        z[t], r[t], inner[t] = g[:, :h], g[:, h:], sums[:, 2 * h :]
        c = drive[:, 2 * h :] + r[t] * inner[t]
        new[t] = _soft(c)
        slopes[t, :, : 2 * h] = 0.5 / (1 + np.abs(a)) ** 2
        slopes[t, :, 2 * h :] = 1 / (1 + np.abs(c)) ** 2
        states[t + 1] = new[t] + z[t] * (states[t] - new[t])
        part = head @ states[t + 1]
        logits[t] += part[0]
        logits[steps - 1 - t] += part[1]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    real = (windows != FILL).astype(np.float32)
    weight = real / max(1.0, real.sum())
    own = np.take_along_axis(p, np.broadcast_to(labels, (steps, 1, n)), 1)[:, 0]
    loss = float(-(np.log(np.maximum(own, 1e-9)) * weight).sum())
    np.put_along_axis(p, np.broadcast_to(labels, (steps, 1, n)), (own - 1)[:, None], 1)
    p *= weight[:, None]
    g_table, g_gates, g_head = np.zeros_like(table), np.zeros_like(gates), np.zeros_like(head)
    back = np.zeros((2, h, n), np.float32)
    for t in range(steps - 1, -1, -1):
        error = np.stack([p[t], p[steps - 1 - t]])
        g_head += error @ states[t + 1].transpose(0, 2, 1)
        back = back + head.transpose(0, 2, 1) @ error
        dz = back * (states[t] - new[t])
        dnew = back * (1 - z[t]) * slopes[t, :, 2 * h :]
        da = np.concatenate([dz * slopes[t, :, :h], dnew * inner[t] * slopes[t, :, h : 2 * h]], 1)
        dsums = np.concatenate([da, dnew * r[t]], 1)
        drive = np.concatenate([da, dnew], 1)
        g_gates += dsums @ states[t].transpose(0, 2, 1)
        for d in range(2):
            order = np.argsort(seen[t, d], kind="stable")
            symbols, first = np.unique(seen[t, d][order], return_index=True)
            g_table[d][:, symbols] += np.add.reduceat(drive[d][:, order], first, axis=1)
        back = back * z[t] + gates.transpose(0, 2, 1) @ dsums
    return loss, [g_table, g_gates, g_head, p.sum((0, 2))]


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, hidden: int = 8, rounds: int = 150, batch: int = 192, rate: float = 0.03, seed: int = 0) -> Network:
    """Fit to windows (window, position) of symbols with a label each, by Adam with a falling rate. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    w = [
        rng.normal(0, 0.3, (2, 3 * hidden, 257)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32),
        rng.normal(0, 0.3, (2, n_labels, hidden)).astype(np.float32),
        np.zeros(n_labels, np.float32),
    ]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for k in range(1, rounds + 1):
        chosen = rng.integers(0, len(windows), batch)
        _, gradients = _loss_and_gradients(w, np.ascontiguousarray(windows[chosen].T), labels[chosen])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g**2).sum() for g in gradients)))))
        now = rate * min(1.0, k / 10) * (1 - 0.95 * k / rounds)
        for x, g, m, v in zip(w, gradients, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Network(*w, windows.shape[1])


def cut(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows (window, position) of texts laid end to end, and the text of each."""
    count = -(-np.diff(offsets) // window)
    owner = np.repeat(np.arange(len(count)), count)
    at = offsets[:-1][owner] + window * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    where = at[:, None] + np.arange(window)
    out = np.where(where < offsets[1:][owner][:, None], data[np.minimum(where, max(0, len(data) - 1))] if len(data) else 0, FILL)
    return out, owner
