"""A bidirectional gated recurrent network with attention pooling, in numpy.

Sequences are rows of a table, named by index; a row holds an input already multiplied
by the gates' weights.  Sequences are worked on in order of falling length, so that those
still running are a prefix and nothing is masked.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def running(lengths: np.ndarray) -> np.ndarray:
    """How many sequences (longest first) have a step t, for each t."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")


def scan(table: np.ndarray, ids: np.ndarray, active: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [step, sequence, h] of one direction; ``ids`` is [step, sequence], ``u`` is h x 3h."""
    h = u.shape[0]
    states = np.zeros((len(active), ids.shape[1], h), F32)
    before = np.zeros((ids.shape[1], h), F32)
    for t, n in enumerate(active.tolist()):
        x = table[ids[t, :n]]
        last = before[:n]
        own = last @ u
        gates = sigmoid(x[:, : 2 * h] + own[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * own[:, 2 * h :])
        before = states[t]
        before[:n] = new + z * (last - new)
        if keep is not None:
            keep.append((last, own[:, 2 * h :], z, r, new))
    return states


def scan_back(grad: np.ndarray, ids: np.ndarray, active: np.ndarray, u: np.ndarray, kept: list, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table (``rows`` rows) and of ``u`` from those of the states."""
    h = u.shape[0]
    du, flow = np.zeros_like(u), np.zeros(grad.shape[1:], F32)
    moved, where = [], []
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        last, own, z, r, new = kept[t]
        d = grad[t, :n] + flow[:n]
        dn = d * (1 - z) * (1 - new * new)
        dz = d * (last - new) * z * (1 - z)
        dr = dn * own * r * (1 - r)
        dx = np.concatenate((dz, dr, dn), axis=1)
        dh = np.concatenate((dz, dr, dn * r), axis=1)
        du += last.T @ dh
        flow[:n] = d * z + dh @ u.T
        moved.append(dx)
        where.append(ids[t, :n])
    return summed(np.concatenate(moved), np.concatenate(where), rows) if moved else np.zeros((rows, 3 * h), F32), du


def summed(values: np.ndarray, where: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the values that go to each row."""
    order = np.argsort(where, kind="stable")
    place = where[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    out = np.zeros((rows, values.shape[1]), F32)
    if len(first):
        out[place[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def turned(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sequences read from their ends."""
    step = lengths[None, :] - 1 - np.arange(len(ids))[:, None]
    return np.take_along_axis(ids, np.maximum(step, 0), axis=0)


class Layer:
    """Two directions over one table each, and attention over both together: [sequence, 2h]."""

    def __init__(self, weights: dict[str, np.ndarray], name: str):
        self.u = [weights[f"{name}_u0"], weights[f"{name}_u1"]]
        self.v, self.name = weights[f"{name}_v"], name

    def pool(self, tables: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Sequences longest first, ``ids`` as [step, sequence]; a sequence without a step pools to zeros."""
        active, h = running(lengths), self.u[0].shape[0]
        kept: list[list | None] = [[], []] if keep is not None else [None, None]
        back = turned(ids, lengths)
        ahead = scan(tables[0], ids, active, self.u[0], kept[0])
        behind = scan(tables[1], back, active, self.u[1], kept[1])
        # The second direction's states stand at the place that they have in the text.
        step = np.maximum(lengths[None, :] - 1 - np.arange(len(ids))[:, None], 0)[: len(active)]
        behind = np.take_along_axis(behind, step[:, :, None], axis=0)
        live = np.arange(len(active))[:, None] < lengths[None, :]
        weight = np.where(live, np.exp(np.tanh(ahead @ self.v[:h] + behind @ self.v[h:]) * F32(4)), F32(0))
        total = np.maximum(weight.sum(axis=0), F32(1e-9))
        share = weight / total
        out = np.concatenate((np.einsum("ts,tsh->sh", share, ahead), np.einsum("ts,tsh->sh", share, behind)), axis=1)
        if keep is not None:
            keep.update(ids=ids, back=back, active=active, kept=kept, ahead=ahead, behind=behind, step=step, share=share, live=live, out=out)
        return out

    def back(self, d: np.ndarray, kept: dict, rows: list[int], grads: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Adds to ``grads``; returns the gradients of both tables."""
        h = self.u[0].shape[0]
        ahead, behind, share = kept["ahead"], kept["behind"], kept["share"]
        centred = np.einsum("tsh,sh->ts", ahead, d[:, :h]) + np.einsum("tsh,sh->ts", behind, d[:, h:]) - (kept["out"] * d).sum(axis=1)
        bent = np.tanh(ahead @ self.v[:h] + behind @ self.v[h:])
        ds = share * centred * F32(4) * (1 - bent * bent)
        grads[f"{self.name}_v"] += np.concatenate((np.einsum("ts,tsh->h", ds, ahead), np.einsum("ts,tsh->h", ds, behind)))
        d_ahead = share[:, :, None] * d[None, :, :h] + ds[:, :, None] * self.v[:h]
        d_behind = share[:, :, None] * d[None, :, h:] + ds[:, :, None] * self.v[h:]
        d_behind = np.where(kept["live"][:, :, None], np.take_along_axis(d_behind, kept["step"][:, :, None], axis=0), F32(0))
        out = []
        for k, (grad, ids) in enumerate(((d_ahead, kept["ids"]), (d_behind, kept["back"]))):
            table, du = scan_back(grad, ids, kept["active"], self.u[k], kept["kept"][k], rows[k])
            grads[f"{self.name}_u{k}"] += du
            out.append(table)
        return out
