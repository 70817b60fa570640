"""A bidirectional gated recurrent network over bytes in numpy.

Every position of a byte sequence gets a distribution over labels from the
states of a forward and a backward network; training is backpropagation
through time with Adam."""

from __future__ import annotations

import numpy as np

PAD = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class ByteGRU:
    def __init__(self, labels: int, embed: int = 12, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.embed, self.hidden = labels, embed, hidden
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"E": (rng.standard_normal((256, embed)) * 0.3).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(embed, 3 * hidden), f"U{d}": init(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"V": init(2 * hidden, labels), "v": np.zeros(labels, np.float32)}

    def _run(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, n, hidden) of one direction; ids (n, T), padded at the end."""
        p, h = self.p, self.hidden
        n, steps = ids.shape
        gates = (p["E"] @ p[f"W{d}"] + p[f"c{d}"])[ids]  # (n, T, 3h): the embedding's share, by table
        state = np.zeros((n, h), np.float32)
        states = np.zeros((steps, n, h), np.float32)
        tape: list = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            live = (ids[:, t] != PAD)[:, None]
            x = gates[:, t]
            u = state @ p[f"U{d}"][:, : 2 * h]
            zr = _sigmoid(x[:, : 2 * h] + u)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * state) @ p[f"U{d}"][:, 2 * h :])
            new = np.where(live, z * state + (1 - z) * c, state)
            if keep:
                tape.append((t, live, state, z, r, c))
            state = new
            states[t] = state
        return states, tape

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """(n, T, labels)"""
        f, _ = self._run(ids, "f", False)
        b, _ = self._run(ids, "b", False)
        out = np.concatenate([f, b], axis=2) @ self.p["V"] + self.p["v"]
        return out.transpose(1, 0, 2)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """(n, labels): the mean over the positions of their log probabilities."""
        x = self.logits(ids)
        x = x - x.max(axis=2, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=2, keepdims=True))
        live = (ids != PAD)[:, :, None]
        return (x * live).sum(axis=1) / np.maximum(live.sum(axis=1), 1)

    def train(self, ids: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            x = ids[pick]
            x = x[:, : max(1, int((x != PAD).sum(axis=1).max()))]
            g = self._gradient(x, y[pick])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)) + 0.02)
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradient(self, ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden
        f, tape_f = self._run(ids, "f", True)
        b, tape_b = self._run(ids, "b", True)
        both = np.concatenate([f, b], axis=2)  # (T, n, 2h)
        out = both @ p["V"] + p["v"]
        out = np.exp(out - out.max(axis=2, keepdims=True))
        out /= out.sum(axis=2, keepdims=True)
        live = (ids != PAD).T[:, :, None]
        out[:, np.arange(len(y)), y] -= 1
        out *= live / (live.sum(axis=0, keepdims=True) * len(y))
        g = {"V": np.einsum("tnh,tnl->hl", both, out), "v": out.sum(axis=(0, 1)), "E": np.zeros_like(p["E"])}
        back = out @ p["V"].T
        for d, tape, part in (("f", tape_f, back[:, :, :h]), ("b", tape_b, back[:, :, h:])):
            u = p[f"U{d}"]
            dx = np.zeros((*ids.shape, 3 * h), np.float32)
            du = np.zeros_like(u)
            carry = np.zeros((len(y), h), np.float32)
            for t, on, state, z, r, c in reversed(tape):
                ds = (part[t] + carry) * on
                through = (part[t] + carry) * ~on
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (state - c) * z * (1 - z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                dx[:, t, : 2 * h], dx[:, t, 2 * h :] = dzr, dc
                du[:, : 2 * h] += state.T @ dzr
                du[:, 2 * h :] += (r * state).T @ dc
                carry = ds * z + through + dzr @ u[:, : 2 * h].T + drs * r
            flat, at = dx.reshape(-1, 3 * h), ids.ravel()
            sums = np.zeros((256, 3 * h), np.float32)
            np.add.at(sums, at, flat)
            sums[PAD] = 0
            g[f"W{d}"], g[f"c{d}"], g[f"U{d}"] = p["E"].T @ sums, sums.sum(axis=0), du
            g["E"] += sums @ p[f"W{d}"].T
        return g
