"""Small bidirectional recurrent layers in numpy: training by backpropagation through time, and lean inference.

Gates are piecewise linear (a clipped line instead of a sigmoid or tanh), which numpy computes ten times faster than
exponentials; the gradient outside a GRU gate's range is a small leak (in an LSTM, whose cell adds up, it would explode). Inputs come as rows of a table, already multiplied
by the input weights: a symbol's row is looked up, so a step costs one product of the state with the recurrent
weights. Arrays are (time, batch, features).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

LEAK = 0.05
#: Bound of the gradient that goes back from step to step.
LIMIT = np.float32(1.0)
#: What padding adds to gates: the state stays as it is.
_HOLD = 1e4


def _clip(x: np.ndarray, low: float, high: float, leak: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    y = np.clip(x, low, high)
    return y, np.where(y == x, np.float32(1), np.float32(leak))


def _split(weights: np.ndarray, gates: int, shifts: tuple = (0, 0, 0, 0)) -> list[np.ndarray]:
    """Each gate's columns as an array of its own: steps on whole rows are several times faster than on parts of rows."""
    hid = weights.shape[1] // gates
    return [np.ascontiguousarray(weights[:, k * hid : (k + 1) * hid]) + np.float32(shifts[k]) for k in range(gates)]


class Gru:
    gates = 3

    @staticmethod
    def hold_row(hidden: int) -> np.ndarray:
        row = np.zeros(3 * hidden, np.float32)
        row[:hidden] = _HOLD
        return row

    @staticmethod
    def train(a: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, Callable]:
        """States of all steps, and a function from their gradient to those of ``a`` and ``u``."""
        steps, batch, _ = a.shape
        hid = u.shape[0]
        out, kept = np.empty((steps, batch, hid), np.float32), []
        h = np.zeros((batch, hid), np.float32)
        for t in range(steps):
            g = h @ u
            zr, m_zr = _clip(a[t, :, : 2 * hid] + g[:, : 2 * hid] + np.float32(0.5), 0, 1, LEAK)
            z, r = zr[:, :hid], zr[:, hid:]
            n, m_n = _clip(a[t, :, 2 * hid :] + r * g[:, 2 * hid :], -1, 1, LEAK)
            kept.append((h, z, r, n, g[:, 2 * hid :], m_zr, m_n))
            h = n + z * (h - n)
            out[t] = h

        def back(d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            da, du, dh = np.empty_like(a), np.zeros_like(u), np.zeros((batch, hid), np.float32)
            for t in range(steps - 1, -1, -1):
                before, z, r, n, gn, m_zr, m_n = kept[t]
                dh = dh + d_out[t]
                dn = dh * (1 - z) * m_n
                d = np.concatenate((dh * (before - n), dn * gn), 1) * m_zr
                da[t, :, : 2 * hid], da[t, :, 2 * hid :] = d, dn
                dg = np.concatenate((d, dn * r), 1)
                du += before.T @ dg
                dh = np.clip(dh * z + dg @ u.T, -LIMIT, LIMIT)
            return da, du

        return out, back

    @staticmethod
    def states(table: np.ndarray, u: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The state after every step of ``ids`` (time, batch); the array is reused."""
        z, r, n = _split(table, 3, (0.5, 0.5, 0))
        uz, ur, un = _split(u, 3)
        h, az, ar, an, g = (np.zeros((ids.shape[1], u.shape[0]), np.float32) for _ in range(5))
        for row in ids:
            for part, own, weights in ((z, az, uz), (r, ar, ur)):
                np.take(part, row, axis=0, out=own, mode="clip")
                np.matmul(h, weights, out=g)
                own += g
                np.clip(own, 0, 1, out=own)
            np.take(n, row, axis=0, out=an, mode="clip")
            np.matmul(h, un, out=g)
            g *= ar
            an += g
            np.clip(an, -1, 1, out=an)
            h -= an
            h *= az
            h += an
            yield h


class Lstm:
    gates = 4  # in, forget, out, cell

    @staticmethod
    def hold_row(hidden: int) -> np.ndarray:
        row = np.zeros(4 * hidden, np.float32)
        row[:hidden], row[hidden : 2 * hidden] = -_HOLD, _HOLD
        return row

    @staticmethod
    def train(a: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, Callable]:
        steps, batch, _ = a.shape
        hid = u.shape[0]
        out, kept = np.empty((steps, batch, hid), np.float32), []
        h, c = (np.zeros((batch, hid), np.float32) for _ in range(2))
        for t in range(steps):
            g = a[t] + h @ u
            ifo, m_ifo = _clip(g[:, : 3 * hid] + np.float32(0.5), 0, 1)
            n, m_n = _clip(g[:, 3 * hid :], -1, 1)
            i, f, o = ifo[:, :hid], ifo[:, hid : 2 * hid], ifo[:, 2 * hid :]
            before = h, c
            c = f * c + i * n
            shown, m_c = _clip(c, -1, 1)
            h = o * shown
            kept.append((*before, i, f, o, n, shown, m_ifo, m_n, m_c))
            out[t] = h

        def back(d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            da, du = np.empty_like(a), np.zeros_like(u)
            dh, dc = (np.zeros((batch, hid), np.float32) for _ in range(2))
            for t in range(steps - 1, -1, -1):
                h0, c0, i, f, o, n, shown, m_ifo, m_n, m_c = kept[t]
                dh = dh + d_out[t]
                dc = dc + dh * o * m_c
                d = np.concatenate((dc * n, dc * c0, dh * shown), 1) * m_ifo
                da[t] = np.concatenate((d, dc * i * m_n), 1)
                du += h0.T @ da[t]
                dh, dc = np.clip(da[t] @ u.T, -LIMIT, LIMIT), np.clip(dc * f, -LIMIT, LIMIT)
            return da, du

        return out, back

    @staticmethod
    def states(table: np.ndarray, u: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        tables, weights = _split(table, 4, (0.5, 0.5, 0.5, 0)), _split(u, 4)
        h, c, i, f, o, n, g = (np.zeros((ids.shape[1], u.shape[0]), np.float32) for _ in range(7))
        gates = list(zip(tables, weights, (i, f, o, n), (0, 0, 0, -1)))
        for row in ids:
            for part, w, own, low in gates:
                np.take(part, row, axis=0, out=own, mode="clip")
                np.matmul(h, w, out=g)
                own += g
                np.clip(own, low, 1, out=own)
            c *= f
            n *= i
            c += n
            np.clip(c, -1, 1, out=h)
            h *= o
            yield h


def emissions(cell, tables: tuple, recurrent: tuple, heads: tuple, bias: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(time, batch, classes): both directions' states through their output weights. ``ids``: (time, batch)."""
    out = np.empty((*ids.shape, heads[0].shape[1]), np.float32)
    for t, h in enumerate(cell.states(tables[0], recurrent[0], ids)):
        np.matmul(h, heads[0], out=out[t])
    add = np.empty(out.shape[1:], np.float32)
    for t, h in enumerate(cell.states(tables[1], recurrent[1], ids[::-1])):
        np.matmul(h, heads[1], out=add)
        out[len(ids) - 1 - t] += add
    return out + bias


class Bidirectional:
    """Parameters and training of two directions over a table of symbols; the last symbol is padding."""

    def __init__(self, cell, symbols: int, hidden: int, rng: np.random.Generator):
        self.cell, self.hidden, self.symbols = cell, hidden, symbols
        width = cell.gates * hidden
        self.weights = {}
        for side in "fb":
            table = rng.normal(0, 0.3, (symbols + 1, width)).astype(np.float32)
            table[-1] = cell.hold_row(hidden)
            self.weights[f"table_{side}"] = table
            self.weights[f"u_{side}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, width)).astype(np.float32)

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, Callable]:
        """States (time, batch, 2 * hidden), and a function from their gradient to the gradients of the weights."""
        w = self.weights
        ahead, back_f = self.cell.train(w["table_f"][ids], w["u_f"])
        behind, back_b = self.cell.train(w["table_b"][ids[::-1]], w["u_b"])

        def back(d: np.ndarray) -> dict[str, np.ndarray]:
            grads = {}
            for side, run, own, at in (("f", back_f, d[..., : self.hidden], ids), ("b", back_b, d[::-1, :, self.hidden :], ids[::-1])):
                da, grads[f"u_{side}"] = run(own)
                grads[f"table_{side}"] = row_sums(at.ravel(), da.reshape(-1, da.shape[-1]), self.symbols + 1)
                grads[f"table_{side}"][-1] = 0
            return grads

        return np.concatenate((ahead, behind[::-1]), 2), back

    def tables(self) -> tuple:
        return self.weights["table_f"], self.weights["table_b"]

    def recurrent(self) -> tuple:
        return self.weights["u_f"], self.weights["u_b"]


def row_sums(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sum of the values of every row number."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(rows) else np.empty(0, np.int64)
    out = np.zeros((count, values.shape[1]), np.float32)
    if len(rows):
        out[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], limit: float = 5.0) -> None:
        self.turn += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, limit / max(size, 1e-12)))
        for k, g in grads.items():
            m, v = self.state[k]
            g = g * scale
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            fixed_m, fixed_v = m / (1 - 0.9**self.turn), v / (1 - 0.999**self.turn)
            self.weights[k] -= (self.rate * fixed_m / (np.sqrt(fixed_v) + 1e-8)).astype(np.float32)


def windows(lengths: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of windows of ``size`` units that overlap by ``overlap``; empty documents have none."""
    step = size - overlap
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - size) // step)), 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = nth * step
    return doc, start, np.minimum(size, lengths[doc] - start)


def padded(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """(time, batch) symbols of slices of ``flat``."""
    at = np.arange(int(lengths.max()))[:, None]
    ids = flat[np.minimum(begins[None, :] + at, len(flat) - 1)].astype(np.int32)  # bytes could not hold the padding
    return np.where(at < lengths[None, :], ids, np.int32(pad))


def by_length(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices of windows of similar length, at most ``most`` at a time."""
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), most):
        yield order[at : at + most]


def gradient_gap(cell, seed: int = 0) -> float:
    """Largest difference between the computed and the numeric gradient of a small layer, for tests."""
    rng = np.random.default_rng(seed)
    net = Bidirectional(cell, 5, 3, rng)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    ids, aim = rng.integers(0, 6, (4, 2)), rng.normal(0, 0.1, (4, 2, 6))
    out, back = net.forward(ids)
    grads, worst = back(aim.astype(np.float32)), 0.0
    for name, w in net.weights.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(12)]:
            if name.startswith("table") and at[0] == 5:
                continue
            old, e = w[at], 1e-3
            w[at] = old + e
            up = (net.forward(ids)[0] * aim).sum()
            w[at] = old - e
            down = (net.forward(ids)[0] * aim).sum()
            w[at] = old
            worst = max(worst, abs(float((up - down) / (2 * e) - grads[name][at])))
    return worst
